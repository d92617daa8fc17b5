"""Near-duplicate detection with ProbMinHash.

A text is the set of its word shingles, all of weight 1, as links are verified on sets: weights by counts would let repeats move
a pair out of its bands. Every shingle is a Poisson process of arrivals whose rate is its weight; each arrival falls into one
of m registers, and a register keeps the shingle that arrived first. Two texts agree in a register with their probability
Jaccard similarity, which for equal weights is the Jaccard similarity of the sets. Arrivals are generated only up to the time
by which all registers are taken, which ends the work after about m ln m arrivals a text. Bands of registers give
candidates, and each link is verified by the exact Jaccard similarity of the texts' shingle sets.

Links are found without listing the pairs of a bucket. First each bucket's members are compared with the one that meets
most other texts, and connected texts are joined. Then only buckets whose members are still in several classes matter. In
these, texts that share a rare shingle are compared; for all other pairs the common shingles bound the overlap, and those whose
sizes still allow the similarity are compared as well. So the classes are those that all candidate pairs would give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, give_back, mix64, small_batches, text_slices, words_of

SET_BITS = np.uint64(48)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SALT = np.uint64(0xD6E8FEB86659FD93)
#: Shingles that at most so many texts of open buckets share lead to pairs directly.
RARE = 16
#: Nodes of more links than this are made the centres of their components; a text is linked to one leader a band at most.
HUB = 128
#: Added to a hub's number, which is at least 0, to bring it before all other numbers.
FIRST = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    """With 25 bands of 4 registers a pair of similarity 0.8 is missed with probability 2e-6."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 4


def shingles(texts: list[bytes | None], hashes: WordHash, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count): distinct shingles, sorted, as 48-bit hashes; fewer than k words are one shingle."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = words_of(t)
        lengths[i] = len(own)
        words += own
    h = hashes.array(words)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * GOLDEN + h[j : j + n]
    whole = owner[:n] == owner[k - 1 :] if n else np.zeros(0, bool)
    rolled, of = mix64(rolled[whole]), owner[:n][whole]
    short = np.nonzero((lengths > 0) & (lengths < k))[0]
    few = np.zeros(len(short), np.uint64)
    for x, i in enumerate(short):
        value = h[ends[i] - lengths[i] : ends[i]]
        few[x] = mix64(value + np.arange(1, len(value) + 1, dtype=np.uint64) * SALT).sum(dtype=np.uint64)
    key = np.concatenate([(of.astype(np.uint64) << SET_BITS) | (rolled >> (64 - SET_BITS)), (short.astype(np.uint64) << SET_BITS) | (mix64(few) >> (64 - SET_BITS))])
    key, count = np.unique(key, return_counts=True)
    return (key >> SET_BITS).astype(np.int64), key & ((np.uint64(1) << SET_BITS) - np.uint64(1)), count


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m: in each register of each text the element that arrived first; texts without elements stay 0."""
    out = np.zeros((n, m), np.uint64)
    sizes = np.bincount(owner, minlength=n)
    one = sizes[owner] == 1
    out[owner[one]] = element[one][:, None]
    total = np.bincount(owner, weight, n)
    todo = sizes > 1
    limit = np.zeros(n)
    limit[todo] = m * (math.log(m) + 3) / total[todo]
    while todo.any():
        own = todo[owner]
        o, e, w = owner[own], element[own], weight[own]
        t, seen, nth = np.zeros(len(o)), [], 0
        first = np.full(n * m, np.inf)
        while len(o):
            random = mix64(e * GOLDEN + np.uint64(nth * int(SALT) % 2**64))
            t = t - np.log(((random >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / w
            live = t <= limit[o]
            o, e, w, t = o[live], e[live], w[live], t[live]
            slot = o * m + (mix64(random[live] ^ SALT) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, slot, t)
            seen.append((slot, t, e))
            nth += 1
        for slot, t, e in seen:
            won = t == first[slot]
            out.reshape(-1)[slot[won]] = e[won]
        todo &= np.isinf(first.reshape(n, m)).any(axis=1)
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, m = signature.shape
    parts = signature.reshape(n, bands, m // bands)
    key = mix64(np.arange(bands, dtype=np.uint64) + SALT)[None, :].repeat(n, 0)
    for i in range(m // bands):
        key = mix64((key ^ parts[:, :, i]) * GOLDEN)
    return key.view(np.int64)


def _slices(column: pa.Array) -> Iterator[list[bytes | None]]:
    for _, part in text_slices([pa.RecordBatch.from_arrays([column], names=["text"])]):
        yield part


def bands_of(text: Column, s: Settings) -> Column:
    @F.arrow_udf("array<bigint>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHash()
        for column in columns:
            out = [pa.array([], pa.list_(pa.int64()))]
            for part in _slices(column):
                owner, element, _ = shingles(part, hashes, s.shingle)
                keys = band_keys(signatures(owner, element, np.ones(len(owner)), len(part), s.bands * s.rows), s.bands)
                some = np.bincount(owner, minlength=len(part)) > 0
                offsets = np.concatenate([[0], np.cumsum(some * s.bands)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1))))
            yield pa.concat_arrays(out)

    return run(text)


def set_of(text: Column, s: Settings, sha: Column | None = None, wanted=None) -> Column:
    """Sorted distinct shingles as bytes of 64-bit integers; null for texts that the bitmap ``wanted`` rules out by their sha."""

    @F.arrow_udf("binary")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHash()
        for column, keys in columns:
            mask = np.ones(len(column), bool) if wanted is None else may_hold(wanted.value, keys)
            sets: list[bytes] = []
            for part in _slices(column.filter(pa.array(mask))):
                owner, element, _ = shingles(part, hashes, s.shingle)
                cuts = np.searchsorted(owner, np.arange(1, len(part)))
                sets += [x.tobytes() for x in np.split(element, cuts)]
            out = np.full(len(column), None, object)
            out[mask] = sets
            yield pa.array(out, pa.binary())

    return run(text, F.lit(None).cast("binary") if sha is None else sha)


def jaccard(x: bytes, y: bytes) -> float:
    """Of two sets from set_of()."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / max(1, len(p) + len(q) - both)


def jaccard_of(a: str, b: str) -> Column:
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = pa.array([jaccard(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], pa.float64())
        give_back()
        return out

    return run(F.col(a), F.col(b))


def _hubs_first(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges with nodes of over HUB links renamed to negative numbers, so that they come before all others; see _named()."""
    ends = edges.select(F.col("a").alias("x")).union(edges.select(F.col("b").alias("x")))
    hubs = scratch.table(ends.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("x"))
    if hubs.isEmpty():
        return edges
    for end in ("a", "b"):
        known = hubs.select(F.col("x").alias(end), F.lit(True).alias("hub"))
        edges = edges.join(known, end, "left").withColumn(end, F.when(F.col("hub"), F.col(end) + FIRST).otherwise(F.col(end))).drop("hub")
    return edges


def _named(node: Column) -> Column:
    return F.when(node < 0, node - FIRST).otherwise(node)


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp): one node of each node's component, for all nodes but that one; edges: columns a, b, not negative.

    Large-star and small-star steps alternate until every component is a star. A component's centre is its smallest node, where
    nodes of over HUB links count as smaller than all others: then a hub's links are already as they have to be, and no
    step gathers them by the hub. In the large star each link goes down to the smallest neighbour of its lower end, which only
    lower ends that are no centres have; these are few, and are joined from a table, so that Spark can split a frequent end.
    """
    pairs = scratch.table(edges.select("a", "b").where("a != b").distinct())
    both = _hubs_first(pairs, scratch)
    e = scratch.table(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        low = scratch.table(e.groupBy("a").agg(F.min("b").alias("lo"), F.count("*").alias("n")))
        # a star has no node with two lower neighbours, and no lower end with a lower neighbour of its own
        centres = e.select("b").distinct().join(low.select(F.col("a").alias("b")), "b", "left_semi")
        if low.where("n > 1").isEmpty() and centres.isEmpty():
            return e.select(_named(F.col("a")).alias("id"), _named(F.col("b")).alias("comp"))
        down = low.select(F.col("a").alias("b"), "lo")
        large = scratch.table(e.join(down, "b", "left").select("a", F.coalesce("lo", "b").alias("b")).distinct())
        low = scratch.table(large.groupBy("a").agg(F.min("b").alias("lo")))
        small = large.join(low, "a").where("b != lo").select(F.col("b").alias("a"), F.col("lo").alias("b")).union(low.select("a", F.col("lo").alias("b")))
        before, e = e, scratch.table(small.distinct())
        scratch.drop(before, large)


def _prefix(sha: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("bigint"), 32 - bits)


def bitmap_of(wanted: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits that say which shas may be wanted: true for all wanted ones and few others."""
    at = _prefix(F.col("sha"), bits)
    one = wanted.select(F.shiftright(at, 6).alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b"))
    found = one.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return words


def may_hold(words: np.ndarray, shas: pa.Array) -> np.ndarray:
    bits = len(words).bit_length() + 5
    p = np.array([int.from_bytes(x[:4], "big") >> (32 - bits) for x in shas.to_pylist()], np.int64)
    return (words[p >> 6] >> (p & 63)) & 1 == 1


def _joined(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after further links: those that are known are stars, so few steps are left."""
    if links.isEmpty():
        return comps
    return connected(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links), scratch)


def _with_comps(df: DataFrame, comps: DataFrame) -> DataFrame:
    return df.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def elements_of(column: str) -> Column:
    """A set from set_of() as an array."""

    @F.arrow_udf("array<bigint>")
    def run(sets: pa.Array) -> pa.Array:
        parts = [np.frombuffer(x.as_py(), np.int64) for x in sets]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    return run(F.col(column))


def _rare(ids: DataFrame, comps: DataFrame, sets: DataFrame, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of different classes that share a rare shingle, and what the overlap of all other pairs can be at most.

    A shingle is rare if at most RARE of ``ids`` have it. A pair that shares none of them overlaps in the other shingles only:
    ``most`` is the largest size of a partner with which that can still reach the similarity.
    """
    postings = scratch.table(sets.join(ids, "id").select("id", F.explode(elements_of("elements")).alias("g")))
    rare = postings.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    held = scratch.table(postings.join(rare, "g"))
    scratch.drop(postings)
    several = _with_comps(held.where("df > 1"), comps).select("g", "id", "comp")
    one = several.select("g", F.col("id").alias("a"), F.col("comp").alias("ca"))
    two = several.select("g", F.col("id").alias("b"), F.col("comp").alias("cb"))
    shared = one.join(two, "g").where("a < b and ca != cb").select("a", "b").distinct()
    sizes = sets.join(ids, "id").select("id", (F.octet_length("elements") / 8).cast("bigint").alias("size"))
    counts = held.groupBy("id").agg(F.count("*").alias("rare"))
    common = F.col("size") - F.coalesce("rare", F.lit(0))
    most = (1 + s.similarity) / s.similarity * common - F.col("size") + 1e-6
    return shared, scratch.table(sizes.join(counts, "id", "left").select("id", "size", most.alias("most")))


def _possible(still: DataFrame, comps: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pairs of different classes in one bucket that may be similar without a rare shingle in common.

    Each one's size must be within the other's ``most``, so one of the two has a ``most`` that is not below its own size.
    """
    known = _with_comps(still, comps).join(bounds, "id")
    light = known.where("most >= size").select("key", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("sa"), F.col("most").alias("ma"))
    every = known.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("sb"), F.col("most").alias("mb"))
    met = light.join(every, "key").where("ca != cb and sb <= ma and sa <= mb and (mb < sb or a < b)")
    return met.select("a", "b").distinct()


def _rows(df: DataFrame, scratch: Scratch, s: Settings, text: str, id_col: str) -> DataFrame:
    """row, id, sha and class: the row number of one row of the class, for every row of df."""
    small_batches(df.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    sha = F.unhex(F.sha2(value, 256))
    signed = scratch.table(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), sha.alias("sha"), bands_of(value, s).alias("bands")))
    # copies go first: one row stands for each text
    copies = scratch.table(signed.groupBy("sha").agg(F.min("row").alias("rep"), F.count("*").alias("n")).where("n > 1").select("sha", "rep"))
    rows = scratch.table(signed.select("row", "id", "sha").join(copies, "sha", "left").withColumn("rep", F.coalesce("rep", "row")))
    buckets = signed.join(rows.where("row = rep").select("row"), "row").select(F.explode("bands").alias("key"), F.col("row").alias("id"))
    many = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.table(buckets.join(many, "key"))
    scratch.drop(signed, copies)
    if members.isEmpty():
        return rows.withColumn("class", F.col("rep"))

    needed = scratch.table(members.select("id").distinct().join(rows.select(F.col("row").alias("id"), "sha"), "id"))
    bits = min(27, max(16, math.ceil(math.log2(16 * needed.count()))))
    wanted = df.sparkSession.sparkContext.broadcast(bitmap_of(needed, bits))
    some = df.select(sha.alias("sha"), set_of(value, s, sha, wanted).alias("elements")).where("elements is not null")
    sets = some.join(needed, "sha")
    sets = scratch.table(sets.groupBy("id").agg(F.first("elements").alias("elements")))

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
        two = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
        met = pairs.join(one, "a").join(two, "b")
        return met.where(jaccard_of("x", "y") >= s.similarity).select("a", "b")

    # the text that meets most others leads its buckets; a third of all texts may be near it and not near each other
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("top")).select("key", (-F.col("top.id")).alias("b"))
    links = scratch.table(verified(members.select("key", F.col("id").alias("a")).join(leaders, "key").where("a != b").select("a", "b").distinct()))
    comps = connected(links, scratch)
    own = _with_comps(members, comps).select("key", "id", "n", "comp")
    left = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n")).where("n > 2 and lo != hi")
    still = scratch.table(own.join(left.select("key"), "key").select("key", "id"))
    if not still.isEmpty():
        ids = scratch.table(still.select("id").distinct())
        shared, bounds = _rare(ids, comps, sets, s, scratch)
        comps = _joined(comps, scratch.table(verified(shared)), scratch)
        comps = _joined(comps, scratch.table(verified(_possible(still, comps, bounds))), scratch)
    found = rows.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("comp", "rep"))
    return found.select("row", "id", "sha", "class")


def _classed(df: DataFrame, scratch: Scratch, s: Settings, text: str, id_col: str) -> DataFrame:
    """row, id, sha, class_id, class_size and kept, for every row of df."""
    rows = scratch.table(_rows(df, scratch, s, text, id_col).select("row", "id", "sha", "class"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    # only classes of several rows are joined back, from a table, so that a hot class's rows can be split
    groups = scratch.table(rows.groupBy("class").agg(F.count("*").alias("class_size"), best).where("class_size > 1"))
    alone = F.col("class_size").isNull()
    return rows.join(groups, "class", "left").select(
        "row",
        "id",
        "sha",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
    )


def classes(df: DataFrame, settings: Settings = Settings(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: the id, class_id (smallest id of its class), class_size and kept.

    A class is connected by links of similarity ``settings.similarity`` or more; equal texts (null counts as empty) are always in
    one class, and texts without words are linked to nothing but equal texts. The row with the smallest id stays (null
    ids come last, of repeated ids one row stays). An empty table gives an empty result.
    """
    found = _classed(df, Scratch(df.sparkSession, "near"), settings, text, id_col)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def keep_one(df: DataFrame, settings: Settings = Settings(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df, all columns, that stay when each class keeps one row."""
    scratch = Scratch(df.sparkSession, "near")
    found = scratch.table(_classed(df, scratch, settings, text, id_col))
    keepers = found.where("kept").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    out = df.join(keepers, (sha == F.col("__sha")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    if found.groupBy("id", "sha").count().where("count > 1").isEmpty():
        return out
    return out.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha")
