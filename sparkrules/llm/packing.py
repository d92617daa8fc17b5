"""Packing into optimal length buckets.

A dynamic programme over the global histogram of lengths picks the bucket boundaries with the least padding; inside each
bucket, batches of a token budget are formed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_within


#: Rows that one task numbers, and the bins that a bucket is dealt to at least and at most.
BIN_ROWS, FEWEST_BINS, MOST_BINS = 1 << 20, 64, 4096
TOKEN = r"[^ \t\n\r\f\x0B]+"


@dataclass(frozen=True)
class Settings:
    """max_len bounds the histogram: longer texts are cut into pieces of max_len tokens and a rest, none is dropped."""

    buckets: int = 16
    max_len: int = 4096
    batch_tokens: int = 65536


def n_tokens(text: Column) -> Column:
    """Tokens are runs of non-blank characters, counted as the blanks (or the begin) before them; null has none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), TOKEN, "x")
    return F.octet_length(F.translate(marked, " \t\n\r\f\u000b", "")).cast("int")


def words(text: Column) -> Column:
    """The tokens that n_tokens() counts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def boundaries(counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """counts[l]: how many pieces have length l. Upper bounds of at most ``buckets`` buckets, and the padding they need.

    best[j] after k rounds is the least padding of lengths up to the j-th with k buckets; the cost of one bucket over
    lengths i+1..j is its upper length times its count, less its tokens.
    """
    lengths = np.nonzero(counts)[0]
    if not len(lengths):
        return [], 0
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    tokens = int((counts[lengths] * lengths).sum())
    m = len(lengths)
    best = np.concatenate([[0.0], lengths * n[1:]])  # bytes with one bucket
    came = [np.zeros(m + 1, np.int64)]
    for _ in range(1, min(buckets, m)):
        nxt, arg = best.copy(), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j])
            arg[j] = cost.argmin()
            nxt[j] = cost[arg[j]]
        best = nxt
        came.append(arg)
    out, j = [], m
    for arg in reversed(came):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
    return out[::-1], int(best[m]) - tokens


def pack(df: DataFrame, settings: Settings = Settings(), text: str = "text", id_col: str = "doc_id", tokens: Column | None = None, sequences: Column | None = None) -> DataFrame:
    """One row per piece: the id, piece (0 ..), begin (token), n_tokens, bucket, bucket_len, batch, slot and padding.

    Pieces of a bucket are padded to bucket_len; a batch takes max(1, batch_tokens // bucket_len) of them, and only the last
    batch of a bucket may be smaller. batch counts from 0 in each bucket, slot from 0 in each batch. A text without
    tokens (also null) is one piece of length 0, padded like any other. Rows of a null id stay. An empty table gives an
    empty result. ``tokens`` may give another count of tokens than the number of non-blank runs. ``sequences``, an array of
    all tokens of a row (of any type, such as words() or ids from a tokenizer), is counted instead, and each piece then comes
    with its own ``tokens`` and ``text_hash``: the pieces of a row, in order of ``piece``, are the row's whole array again.
    """
    scratch = Scratch(df.sparkSession, "pack")
    if sequences is not None:
        tokens = F.when(sequences.isNotNull(), F.size(sequences))
    count = (n_tokens(F.col(text)) if tokens is None else tokens).cast("bigint")
    size = settings.max_len
    docs = df.select(F.col(id_col), F.coalesce(count, F.lit(0)).alias("n"), F.xxhash64(text).alias("h"), *([] if sequences is None else [sequences.alias("all")]))
    whole = F.greatest(F.ceil(F.col("n") / size).cast("int"), F.lit(1))
    carried = [] if sequences is None else ["all"]
    pieces = docs.select(id_col, "n", "h", *carried, F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    begin = (F.col("piece") * F.lit(size)).cast("bigint")
    pieces = pieces.select(id_col, "piece", begin.alias("begin"), F.least(F.col("n") - begin, F.lit(size)).cast("int").alias("n_tokens"), "h", *[F.slice("all", F.col("begin") + 1, size).alias("tokens") for _ in carried])
    pieces = scratch.table(pieces)

    histogram = np.zeros(size + 1, np.int64)
    for length, k in pieces.groupBy("n_tokens").count().collect():  # max_len + 1 rows at most
        histogram[length] = k
    bounds, _ = boundaries(histogram, settings.buckets)
    of = np.searchsorted(bounds, np.arange(size + 1)).tolist()
    lens = F.from_json(F.lit(json.dumps(bounds)), "array<int>")
    pieces = pieces.withColumn("bucket", F.element_at(F.from_json(F.lit(json.dumps(of)), "array<int>"), F.col("n_tokens") + 1))
    key = F.xxhash64(id_col, "piece", "h")
    bins = min(max(int(histogram.max()) // BIN_ROWS, int(histogram.sum()) // BIN_ROWS // settings.buckets, FEWEST_BINS), MOST_BINS)
    numbered = number_within(pieces, "bucket", key, [key, F.col(id_col), F.col("piece"), F.col("h")], "nth", bins)
    bucket_len = F.element_at(lens, F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(settings.batch_tokens) / F.greatest(bucket_len, F.lit(1))), F.lit(1))
    return numbered.select(
        id_col,
        "piece",
        "begin",
        "n_tokens",
        "bucket",
        bucket_len.alias("bucket_len"),
        F.floor(F.col("nth") / room).alias("batch"),
        F.pmod(F.col("nth"), room).cast("int").alias("slot"),
        (bucket_len - F.col("n_tokens")).alias("padding"),
        *([] if sequences is None else [F.coalesce("tokens", F.array().cast(numbered.schema["tokens"].dataType)).alias("tokens"), F.col("h").alias("text_hash")]),
    )
