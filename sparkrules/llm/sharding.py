"""Sharding by histogram sort, with DataFrame functions only.

Every row gets a 63-bit key: the high bits are a hash of its text, so that equal texts lie together, the low bits a hash
of the whole row, so that a text that a third of all rows share can still be cut. Cutting points between shards are
found as in histogram sort: the exact bytes below each of a few probes are counted over all partitions, and the interval
that holds a wanted cut is probed again, more finely, until every cut is within tolerance. Then rows are exchanged once.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, all_columns_hash

KEY_BITS = 63
#: Low bits of the key that come from the whole row: one text may fill eight million key values.
ROW_BITS = 23
FIRST_BITS = 12
NEXT_BITS = 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus one; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_key(text: str = "text") -> Column:
    """From the text and the column __hash, a hash of the whole row."""
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 64 - (KEY_BITS - ROW_BITS))
    by_row = F.shiftrightunsigned(F.col("__hash"), 64 - ROW_BITS)
    return F.shiftleft(by_text, ROW_BITS).bitwiseOR(by_row)


@dataclass
class Splitters:
    """cuts: keys that begin bins 1, 2, ...; a shard is ``per_shard`` bins."""

    cuts: list[int]
    per_shard: int
    total_bytes: int
    rounds: int
    errors: list[float] = field(default_factory=list)


def find_splitters(keys: DataFrame, shards: int, bins_per_shard: int, tolerance: float) -> Splitters:
    """keys: columns key and size. Probes until each cut is within ``tolerance`` of a bin's bytes (of a shard's bytes for the
    cuts between shards), or until an interval is a single key.

    At most 2**FIRST_BITS sums come back in the first round, and bins x 2**NEXT_BITS in each later one, whatever the input.
    """
    n = shards * bins_per_shard
    # known[i]: exact bytes below probes[i]
    probes, known = [0, 1 << KEY_BITS], [0, 0]
    open_at, bits, rounds = {0: 0}, FIRST_BITS, 0  # prefix of the interval -> bytes below it
    shift = KEY_BITS
    total = None
    while open_at:
        rounds += 1
        before, shift = shift, max(0, shift - bits)
        rows = keys if before == KEY_BITS else keys.where(F.shiftrightunsigned("key", before).isin(list(open_at)))
        sums = rows.groupBy(F.shiftrightunsigned("key", shift).alias("p")).agg(F.sum("size").alias("s")).collect()
        by_parent: dict[int, list] = {}
        for p, s in sums:
            by_parent.setdefault(p >> (before - shift), []).append((p, s))
        if total is None:
            total = sum(s for _, s in sums)
            known[1] = total
            if not total:
                break
        found = []
        for parent, below in open_at.items():
            for p, s in sorted(by_parent.get(parent, [])):
                found.append((p << shift, below))
                below += s
                found.append(((p + 1) << shift, below))
        merged = dict(zip(probes, known, strict=True)) | dict(found)
        probes = sorted(merged)
        known = [merged[p] for p in probes]
        wanted = {}
        for i in range(1, n):
            target = total * i / n
            slack = tolerance * total / (shards if i % bins_per_shard == 0 else n)
            at = bisect.bisect_left(known, target)
            near = min(abs(known[j] - target) for j in (at - 1, at) if 0 <= j < len(known))
            low = probes[at - 1] if at else 0
            if near > slack and shift and (low >> shift) << shift == low and probes[at] - low == 1 << shift:
                wanted[low >> shift] = known[at - 1]
        open_at, bits = wanted, NEXT_BITS
    cuts, errors = [], []
    for i in range(1, n):
        target = (total or 0) * i / n
        at = bisect.bisect_left(known, target)
        best = min((j for j in (at - 1, at) if 0 <= j < len(known)), key=lambda j: abs(known[j] - target))
        cuts.append(probes[best])
        if i % bins_per_shard == 0:
            errors.append(abs(known[best] - target))
    return Splitters(sorted(cuts), bins_per_shard, total or 0, rounds, errors)


def bin_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key: a look-up by the key's first bits, then a few comparisons."""
    base, inner, at = [], [], 0
    for p in range(1 << FIRST_BITS):
        end = (p + 1) << (KEY_BITS - FIRST_BITS)
        begin = at
        while at < len(cuts) and cuts[at] < end:
            at += 1
        base.append(begin)
        inner.append(cuts[begin:at])
    prefix = (F.shiftrightunsigned(key, KEY_BITS - FIRST_BITS) + 1).cast("int")
    bases = F.from_json(F.lit(json.dumps(base)), "array<int>")
    inners = F.from_json(F.lit(json.dumps(inner)), "array<array<bigint>>")
    return (F.element_at(bases, prefix) + F.size(F.filter(F.element_at(inners, prefix), lambda c: c <= key))).cast("int")


def shard(df: DataFrame, shards: int = 8, tolerance: float = 0.001, bins_per_shard: int = 32, text: str = "text") -> DataFrame:
    """All rows and columns of df with ``size``, ``shard`` (0 ..) and ``slot`` (0 .. without gaps in each shard).

    Shards hold nearly equal bytes: each cut is within ``tolerance`` of a shard's bytes, as long as no single row is larger
    than that. Rows of one text follow each other in (shard, slot) order; texts whose hashes share their first 40 bits are told
    apart by all 64, and only where one of the cuts between bins falls among such texts are both on both sides of it. Null texts count as empty. Rows that are equal
    in every column are interchangeable; they share a key and stay in one bin. An empty table gives an empty result.
    Columns named size, shard or slot are replaced. Columns that the caller does not select later are not exchanged.
    """
    spark = df.sparkSession
    hashed = df.withColumn("__hash", all_columns_hash(df))
    whole_text = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = hashed.withColumns({"__key": shard_key(text), "__text": whole_text, "size": size_of(F.col(text))})
    scratch = Scratch(spark, "shard")
    # texts are read once here and once for the exchange; the rounds read 12 bytes a row
    keys = scratch.table(keyed.select(F.col("__key").alias("key"), "size"))
    found = find_splitters(keys, shards, bins_per_shard, tolerance)
    counts = dict(tuple(r) for r in keys.groupBy(bin_of(F.col("key"), found.cuts).alias("b")).count().collect())
    scratch.drop(keys)
    starts, shard_no = [], -1
    for b in range(shards * bins_per_shard):
        if b // bins_per_shard != shard_no:
            shard_no, at = b // bins_per_shard, 0
        starts.append(at)
        at += counts.get(b, 0)
    first = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    nth = F.row_number().over(W.partitionBy("__bin").orderBy(F.shiftright("__key", ROW_BITS), "__text", "__key", "__hash"))
    return (
        keyed.withColumn("__bin", bin_of(F.col("__key"), found.cuts))
        .withColumns(
            {
                "shard": F.floor(F.col("__bin") / bins_per_shard).cast("int"),
                "slot": (F.element_at(first, F.col("__bin") + 1) + nth - 1).cast("bigint"),
            }
        )
        .drop("__key", "__text", "__hash", "__bin")
    )
