"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mix64, small_batches, text_slices

#: A token is a run of letters and digits, case kept, or a run of other characters.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")


REPEATS = (1, 2, 3)


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows that the model is fitted on; everything else covers all rows."""

    sample_rows: int = 8192
    bits: int = 20
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def repeats(h: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Where the last k tokens are the k tokens before them, in one text."""
    if len(h) < 2 * k:
        return np.zeros(0, np.int64)
    same = (h[k:] == h[:-k]) & (text[k:] == text[:-k])
    whole = np.lib.stride_tricks.sliding_window_view(same, k).all(axis=1)
    return np.nonzero(whole)[0] + 2 * k - 1


def features(texts: list[bytes | None], hashes: WordHash, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text: 1 + ln(count) of n-grams, each text scaled to length 1.

    N-grams are unigrams, bigrams, and repeats: 2k tokens of which the second half is the first once more are one feature
    for each k in REPEATS, whatever the tokens are.
    Feature 0 is the constant; it is in every text, also in empty ones, with value 1.
    """
    words, lengths = [], []
    for t in texts:
        found = TOKEN.findall(t) if t else []
        words += found
        lengths.append(len(found))
    h = hashes.array(words)
    n = len(texts)
    text = np.repeat(np.arange(n), lengths)
    two = mix64(h[:-1] * np.uint64(3) + h[1:])[text[:-1] == text[1:]] if len(h) else h
    text2 = text[1:][text[:-1] == text[1:]] if len(h) else text
    cut = np.uint64(64 - bits)
    owners, parts = [text, text2], [h >> cut, two >> cut]
    for k in REPEATS:
        at = repeats(h, text, k)
        owners.append(text[at])
        parts.append(np.full(len(at), mix64(np.array([k], np.uint64))[0] >> cut))
    key, count = np.unique((np.concatenate(owners) << bits) | np.maximum(np.concatenate(parts).astype(np.int64), 1), return_counts=True)
    owner, feature = key >> bits, key & ((1 << bits) - 1)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value /= norm[owner]
    at = np.searchsorted(owner, np.arange(n))
    return np.insert(owner, at, np.arange(n)), np.insert(feature, at, 0), np.insert(value, at, 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], s: Settings) -> np.ndarray:
    """Weights from (features, values, label) rows, taken in order, epoch after epoch."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i, x, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[i] = ni + g * g
    return weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", id_col: str = "doc_id", label: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows that are not held out: those ``sample_rows`` of lowest hash of the id.

    Null labels and ids are left out; of repeated labels of an id the smaller counts. Without any label all weights are 0,
    and every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label).cast("double").alias("__y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(settings.sample_rows))  # sample_rows rows
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text")).join(chosen, "__id")
    # repeated rows of an id: no more rows than asked for
    sample = sample.select(F.xxhash64("__id").alias("at"), "text", "__y").orderBy("at").limit(settings.sample_rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHash(), []
        for batch, texts in text_slices(batches):
            owner, feature, value = features(texts, hashes, settings.bits)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            ys = batch.column("__y").to_pylist()
            ats = batch.column("at").to_pylist()
            rows += list(zip(ats, np.split(feature, cuts), np.split(value, cuts), ys, strict=True))
        rows.sort(key=lambda r: (r[0], len(r[1])))
        w = ftrl([r[1:] for r in rows], settings)
        i = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(w[i])], names=["i", "w"])

    found = sample.coalesce(1).mapInArrow(train, "i int, w double").toArrow()
    w = np.zeros(1 << settings.bits)
    w[found.column("i").to_numpy()] = found.column("w").to_numpy()
    return w


def score(df: DataFrame, weights: np.ndarray, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """df with ``score`` (0 to 1, higher: good text likelier) and ``predicted``; columns of these names are replaced.

    Null and empty texts get the constant's score. Only texts go to Python and only scores come back.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, hashes = sent.value, WordHash()
        for column in texts:
            out = [np.zeros(0)]
            for _, part in text_slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
                owner, feature, value = features(part, hashes, settings.bits)
                logit = np.bincount(owner, w[feature] * value, len(part))
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.array(np.concatenate(out))

    return df.withColumn("score", run(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
