"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments: each holds some documents whole, all their distinct words and, for every word, its
positions in the segment. Segments are rows of a stored table, so a search reads them in parallel without a shuffle and
no word's posting list is ever gathered in one place. A search takes the benchmark in blocks of bounded size; in each
segment it begins with the rarest words of an item, shifts their positions by the word's place in the item and
intersects them with the lists of the words around.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_slices, words_of

WINDOW = 10
#: Bytes of benchmark text that one search block may hold; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 16 << 20
SEGMENT = "segment bigint, ids array<string>, starts binary, terms binary, offsets binary, positions binary"
FOUND = "segment bigint, nth int, id string, n_words bigint, hits array<struct<begin:int,end:int>>, items array<string>"


def _segment(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """starts (one more than there are texts), terms, offsets and positions; a free position follows each text."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    starts = [0]
    at: list[np.ndarray] = []
    for t in texts:
        words = words_of(t)
        ids += [number.setdefault(w, len(number)) for w in words]
        at.append(np.arange(starts[-1], starts[-1] + len(words), dtype=np.int32))
        starts.append(starts[-1] + len(words) + 1)
    term = np.array(ids, np.int32)
    order = np.argsort(term, kind="stable")
    offsets = np.zeros(len(number) + 1, np.int32)
    np.cumsum(np.bincount(term, minlength=len(number)), out=offsets[1:])
    return np.array(starts, np.int32), list(number), offsets, np.concatenate(at)[order] if at else np.zeros(0, np.int32)


def build_index(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Segments of the positional index over every row and every word of df; null texts have no words."""
    kinds = pa.schema([("segment", pa.int64()), ("ids", pa.list_(pa.string())), ("starts", pa.binary()), ("terms", pa.binary()), ("offsets", pa.binary()), ("positions", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch, texts in text_slices(batches):
            starts, terms, offsets, positions = _segment(texts)
            row = [number, batch.column("id").to_pylist(), starts.tobytes(), b" ".join(terms), offsets.tobytes(), positions.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds, strict=True)], schema=kinds)
            number += 1

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(build, SEGMENT)


class _Segment:
    def __init__(self, row: dict, wanted: dict[bytes, int]):
        self.ids, self.number = row["ids"], row["segment"]
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.offsets, self.positions = np.frombuffer(row["offsets"], np.int32), np.frombuffer(row["positions"], np.int32)
        self.term = np.full(len(wanted), -1, np.int64)
        for i, w in enumerate(row["terms"].split(b" ")):
            if (q := wanted.get(w)) is not None:
                self.term[q] = i
        here = self.term >= 0
        self.count = np.zeros(len(wanted), np.int64)
        self.count[here] = np.diff(self.offsets)[self.term[here]]

    def postings(self, q: int) -> np.ndarray:
        t = self.term[q]
        return self.positions[self.offsets[t] : self.offsets[t + 1]] if t >= 0 else self.positions[:0]

    def holds(self, q: int, at: np.ndarray) -> np.ndarray:
        """Of each position, whether word q is there."""
        if not len(own := self.postings(q)) or not len(at):
            return np.zeros(len(at), bool)
        return own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at

    def phrases(self, item: np.ndarray, window: int) -> list[tuple[int, int]]:
        """Spans of the segment, as [begin, end), that hold at least ``window`` successive words of the item."""
        w = min(window, len(item))
        counts = self.count[item]
        alive = np.lib.stride_tricks.sliding_window_view(counts > 0, w).all(axis=1)
        if not alive.any():
            return []
        # the rarest word of each window that can occur; windows that share it are searched together
        rarest = np.lib.stride_tricks.sliding_window_view(counts, w).argmin(axis=1) + np.arange(len(alive))
        found = []
        for r in np.unique(rarest[alive]).tolist():
            base = self.postings(item[r]).astype(np.int64) - r
            if w > 1:
                near = np.zeros(len(base), bool)
                for j in (r - 1, r + 1):
                    if 0 <= j < len(item):
                        near |= self.holds(item[j], base + j)
                base = base[near]
            if not len(base):
                continue
            lo, hi = max(0, r - w + 1), min(len(item), r + w)
            same = np.stack([self.holds(item[j], base + j) for j in range(lo, hi)])
            full = np.lib.stride_tricks.sliding_window_view(same, w, axis=0).all(axis=-1)
            first, which = np.nonzero(full)
            found += [(b, b + w) for b in (base[which] + lo + first).tolist()]
        return found

    def near(self, item: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Spans of at most ``within`` words of one text that hold all the item's words, in any order; from each rarest word."""
        words = np.unique(item)
        if not (self.count[words] > 0).all():
            return []
        words = words[np.argsort(self.count[words], kind="stable")]
        out = []
        for p in self.postings(words[0]).tolist():
            text = bisect_right(self.starts.tolist(), p) - 1 if len(self.starts) < 64 else int(np.searchsorted(self.starts, p, "right")) - 1
            lo, hi = max(p - within + 1, int(self.starts[text])), min(p + within, int(self.starts[text + 1]) - 1)
            hits = []
            for k, q in enumerate(words):
                own = self.postings(q)
                part = own[np.searchsorted(own, lo) : np.searchsorted(own, hi)]
                if not len(part):
                    break
                hits += [(x, k) for x in part.tolist()]
            else:
                hits.sort()
                need, have, left = len(words), {}, 0
                for x, k in hits:
                    have[k] = have.get(k, 0) + 1
                    while len(have) == need:
                        y, j = hits[left]
                        if x - y < within and y <= p <= x:
                            out.append((y, x + 1))
                        have[j] -= 1
                        if not have[j]:
                            del have[j]
                        left += 1
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _search_block(index: DataFrame, items: list[tuple[str, bytes]], window: int, within: int | None) -> DataFrame:
    wanted: dict[bytes, int] = {}
    coded = [(name, np.array([wanted.setdefault(w, len(wanted)) for w in words_of(t)], np.int64)) for name, t in items]
    coded = [(n, c) for n, c in coded if len(c)]
    sent = index.sparkSession.sparkContext.broadcast((wanted, coded))
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    kinds = pa.schema([("segment", pa.int64()), ("nth", pa.int32()), ("id", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, coded = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                s = _Segment(batch.slice(i, 1).to_pylist()[0], wanted)
                spans: dict[int, list] = {}
                names: dict[int, set] = {}
                for name, item in coded:
                    for b, e in s.phrases(item, window) if within is None else s.near(item, within):
                        d = int(np.searchsorted(s.starts, b, "right")) - 1
                        spans.setdefault(d, []).append((b, e))
                        names.setdefault(d, set()).add(name)
                n = len(s.ids)
                hits = [[{"begin": b - int(s.starts[d]), "end": e - int(s.starts[d])} for b, e in merged(spans[d])] if d in spans else [] for d in range(n)]
                columns = [[s.number] * n, range(n), s.ids, np.diff(s.starts).astype(np.int64) - 1, hits, [sorted(names.get(d, ())) for d in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return index.mapInArrow(search, FOUND)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None, text: str = "text", id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per indexed document: id (string), n_words, hits (merged word spans) and items (the ids that occur, sorted).

    Exact phrases: an item occurs where ``window`` successive words of it stand in the document in a row; an item of fewer
    words, but not none, must stand there whole. With ``within``: where all its words stand within so many words.
    Items without words never occur; a null item id counts as an empty string, and repeated ids as one item. Items go
    to the tasks in blocks of about ``block_bytes`` of text at most, each searched on its own.
    """
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        parts.append(_search_block(index, [(r["id"], r["text"].encode()) for r in own.collect()], window, within))
    if blocks == 1:
        return parts[0].drop("segment", "nth")
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    together = union.groupBy("segment", "nth").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.expr("cast(array() AS array<struct<begin:int,end:int>>)")

    def join(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return together.select("id", "n_words", F.aggregate("all", start, join).alias("hits"), "items")


def n_hit(hits: str = "hits"):
    """Words inside the spans."""
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
