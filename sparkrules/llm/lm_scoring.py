"""Masked pseudo-likelihood scoring with a small bidirectional network, trained in numpy over the whole corpus.

The network predicts every token from the tokens on both sides: position-wise embeddings of the neighbours are summed and
squashed, a first softmax gives the token's class and a second one the token within its class, which together normalise over
the whole vocabulary. A word outside the vocabulary is a bucket of many words for the network; its probability within the
bucket comes from the stored counts of all words, which grow with the corpus and are joined, never collected. A document's
score is the sum of its tokens' conditional log-probabilities.

Word counts cover every document. Documents are dealt by a hash of their rows to groups of about equal size, whatever files
they come from. In each of a few rounds some groups train, each on all of its tokens, from the averages of the round before;
every group trains once. Averages, of weights and of Adagrad's sums, are weighted by tokens.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, all_columns_hash, give_back, small_batches, text_slices

CHUNK = 4096
#: Every word counts so much more than it was seen, and each bucket has as many unseen words as seen ones.
EXTRA = 0.5
#: Words' logarithms are added in whole units, so that their order makes no difference.
UNIT = 2.0**-24
#: Texts are scored in groups of about so many different words outside the vocabulary, texts, and tokens outside it.
GROUP_WORDS, GROUP_TEXTS, GROUP_TOKENS = 300_000, 50_000, 2_000_000
SCORED = np.dtype([("sha", "V32"), ("n", "<i8"), ("s", "<f8")])


@dataclass(frozen=True)
class Settings:
    """Token 0 stands outside a document; then come the frequent words, then ``rare`` buckets that other words share."""

    classes: int = 16
    per_class: int = 64
    rare: int = 64
    width: int = 16
    side: int = 2
    batch: int = 8192
    rate: float = 0.1
    seed: int = 7
    group_tokens: int = 1 << 19
    rounds: int = 4

    @property
    def vocabulary(self) -> int:
        return self.classes * self.per_class

    @property
    def frequent(self) -> int:
        return self.vocabulary - 1 - self.rare


def word_array(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, as words_of() finds them, in one Arrow array without an object a word, and how many each text has."""
    data = np.frombuffer(b" ".join([b"", *(t or b"" for t in texts), b""]).translate(WORD_BYTES), np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # words begin and end by turns
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    borders = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return words, np.diff(np.searchsorted(begins, borders, "right"))


def bytes_of(words: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; its own to_pylist() makes a scalar object of each first."""
    _, ends, data = words.buffers()
    raw = data.to_pybytes() if data else b""
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    return [raw[i:j] for i, j in zip(ends, ends[1:])]  # noqa: B905


class Coder:
    """Word to token; words outside the vocabulary go to buckets by a hash."""

    def __init__(self, words: list[bytes], s: Settings):
        self._words, self._first, self._rare = pa.array(words, pa.binary()), s.vocabulary - s.rare, s.rare

    def __getitem__(self, word: bytes) -> int:
        return int(self.numbers(pa.array([word], pa.binary()))[0])

    def buckets(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        return (h % np.uint64(self._rare)).astype(np.int32) + self._first

    def other(self, words: list[bytes]) -> np.ndarray:
        """Numbers of different words outside the vocabulary."""
        return self.buckets(words)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words."""
        found = pc.fill_null(pc.index_in(words, self._words), -1).to_numpy() + 1
        unknown = np.flatnonzero(found == 0)
        if len(unknown):
            found[unknown] = self.other(bytes_of(words.take(pa.array(unknown))))
        return found

    def windows(self, texts: list[bytes | None], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets, their 2 * side neighbours (stored by place) and the target's text; token 0 pads each text on both sides."""
        words, lengths = word_array(texts)
        coded = words.dictionary_encode()  # each word of a slice is looked up once
        token = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        of = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(token)) + side * (2 * of + 1)
        stream = np.zeros(len(token) + 2 * side * len(texts), np.int32)
        stream[at] = token
        return token, np.stack([stream[at + o] for o in range(-side, side + 1) if o]).T, of


class Group(Coder):
    """Texts that are scored together: words outside the vocabulary get numbers of their own, which lead to their buckets."""

    def __init__(self, words: list[bytes], s: Settings):
        super().__init__(words, s)
        self.vocabulary = s.vocabulary
        self.tokens, self.unknown = [np.arange(s.vocabulary, dtype=np.int32)], {}
        self.texts, self.word_at, self.text_at = [], [], []
        self.held = 0

    def other(self, words: list[bytes]) -> np.ndarray:
        known, before = self.unknown, len(self.unknown)
        place = [known.setdefault(w, len(known)) for w in words]
        if new := [w for w, n in zip(words, place, strict=True) if n >= before]:
            self.tokens.append(self.buckets(new))
        return np.array(place, np.int32) + self.vocabulary

    def take(self, texts: list[bytes | None], net: Network, within: np.ndarray) -> None:
        """Scores texts by the network and ``within``, which a token adds by its bucket; notes where unknown words stand."""
        s = net.s
        number, around, of = self.windows(texts, s.side)
        token = np.concatenate(self.tokens)
        self.tokens = [token]
        target, around = token[number], token[around]
        logs = [net.log_probs(target[i : i + s.batch], around[i : i + s.batch]) for i in range(0, len(target), s.batch)]
        done = np.zeros(len(texts), SCORED)
        for i, t in enumerate(texts):
            done["sha"][i] = np.void(hashlib.sha256(t or b"").digest())
        done["n"] = np.bincount(of, minlength=len(texts))
        done["s"] = np.bincount(of, np.concatenate(logs) + within[target] if logs else None, len(texts))
        own = number >= s.vocabulary
        self.word_at.append((number[own] - s.vocabulary).astype(np.int32))
        self.text_at.append((of[own] + sum(map(len, self.texts))).astype(np.int32))
        self.held += int(own.sum())
        self.texts.append(done)

    def full(self) -> bool:
        return len(self.unknown) > GROUP_WORDS or self.held > GROUP_TOKENS or sum(map(len, self.texts)) > GROUP_TEXTS

    def rows(self, group: int) -> Iterator[pa.RecordBatch]:
        """First a row without a word that holds the texts' scores; then a row for each unknown word with the numbers of its texts."""
        names = ["group", "word", "data"]
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([None], pa.binary()), pa.array([np.concatenate(self.texts).tobytes()])], names=names)
        at, text = np.concatenate(self.word_at), np.concatenate(self.text_at)
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.unknown)))]).astype(np.int32) * 4
        data = pa.Array.from_buffers(pa.binary(), len(self.unknown), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text[np.argsort(at, kind="stable")])])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), group)), pa.array(list(self.unknown), pa.binary()), data], names=names)


def _exp(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, less their row's maximum if any is large, their exponentials and the sums of rows."""
    if logit.max() > 60 or logit.min() < -60:
        logit -= logit.max(1, keepdims=True)
    e = np.exp(logit)
    return logit, e, e @ np.ones(logit.shape[1], logit.dtype)


class Network:
    """Parameters in one float32 vector, with named views."""

    def __init__(self, s: Settings, values: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.s = s
        v, d, c, k = s.vocabulary, s.width, s.classes, s.per_class
        shapes = {"E": (2 * s.side, v, d), "b": (d,), "C": (d, c), "c": (c,), "W": (c, d, k), "w": (c, k)}
        size = sum(int(np.prod(x)) for x in shapes.values())
        self.values = np.zeros(size, np.float32) if values is None else values.astype(np.float32).copy()
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.values[at : at + n].reshape(shape))
            at += n
        if values is None:
            rng = np.random.default_rng(s.seed)
            self.E[:] = rng.normal(0, 0.1, self.E.shape)
            self.C[:] = rng.normal(0, 0.1, self.C.shape)
            self.W[:] = rng.normal(0, 0.1, self.W.shape)
            if counts is not None:  # the start is the unigram model
                p = (counts.reshape(c, k) + 0.5) / (counts.sum() + 0.5 * v)
                self.c[:] = np.log(p.sum(1))
                self.w[:] = np.log(p / p.sum(1, keepdims=True))

    def _hidden(self, around: list[np.ndarray]) -> np.ndarray:
        h = self.E[0].take(around[0], axis=0)
        for o in range(1, len(around)):
            h += self.E[o].take(around[o], axis=0)
        h += self.b
        return np.tanh(h, out=h)

    def log_probs(self, target: np.ndarray, around: np.ndarray, grad: Network | None = None) -> np.ndarray:
        """ln p(target | both sides) of each row; with grad, its parameters get the mean gradient of the negative sum."""
        n, k = len(target), self.s.per_class
        # rows stand by class, so that each class is a slice
        order = np.argsort((target // k).astype(np.uint16), kind="stable")
        group, member = np.divmod(target[order], k)
        around = [around[order, o] for o in range(around.shape[1])]
        cuts = np.searchsorted(group, np.arange(self.s.classes + 1))
        h = self._hidden(around)
        logit, e, z = _exp(h @ self.C + self.c)
        rows = np.arange(n)
        found = logit[rows, group] - np.log(z)
        if grad is not None:
            p = e / z[:, None]
            p[rows, group] -= 1
            p /= n
            grad.C[:] = h.T @ p
            grad.c[:] = p.sum(0)
            dh = p @ self.C.T
            grad.W[:] = 0
            grad.w[:] = 0
        for g in range(self.s.classes):
            own = slice(cuts[g], cuts[g + 1])
            hg, m, r = h[own], member[own], rows[: cuts[g + 1] - cuts[g]]
            if not len(r):
                continue
            logit, e, z = _exp(hg @ self.W[g] + self.w[g])
            found[own] += logit[r, m] - np.log(z)
            if grad is not None:
                e *= (1 / (z * n))[:, None]
                e[r, m] -= 1 / n
                grad.W[g] = hg.T @ e
                grad.w[g] = e.sum(0)
                dh[own] += e @ self.W[g].T
        if grad is not None:
            dh *= 1 - h * h
            grad.b[:] = dh.sum(0)
            grad.E[:] = 0
            for o, column in enumerate(around):
                token = column.astype(np.uint16 if self.s.vocabulary < 1 << 16 else np.int64)
                by = np.argsort(token, kind="stable")
                token = token[by]
                first = np.concatenate([[0], np.nonzero(np.diff(token))[0] + 1])
                grad.E[o, token[first]] = np.add.reduceat(dh[by], first, axis=0)
        out = np.empty(n, found.dtype)
        out[order] = found
        return out


class Trainer:
    """Adagrad over batches of windows; ``state`` holds the parameters and then their sums of squares."""

    def __init__(self, s: Settings, state: np.ndarray):
        values, self.sum = np.split(state.astype(np.float32), 2)
        self.net, self.grad = Network(s, values), Network(s, np.zeros_like(values))
        self.seen, self.waiting = 0, []

    def learn(self, target: np.ndarray, around: np.ndarray, last: bool = False) -> None:
        """Whole batches only, however the windows arrive; the rest waits until ``last``."""
        self.waiting.append((target, around))
        b, n = self.net.s.batch, sum(len(t) for t, _ in self.waiting)
        if n < b and not last:
            return
        target, around = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        end = n if last else n - n % b
        for i in range(0, end, b):
            self.net.log_probs(target[i : min(i + b, end)], around[i : min(i + b, end)], self.grad)
            g = self.grad.values
            self.sum += g * g
            self.net.values -= self.net.s.rate * g / np.sqrt(self.sum)
        self.seen += end
        self.waiting = [(target[end:], around[end:])]

    def state(self) -> np.ndarray:
        return np.concatenate([self.net.values, self.sum])


def count_words(df: DataFrame, text: str = "text", keep: int = 100_000) -> DataFrame:
    """(word, n) over all texts; counts are combined in the tasks, in tables of at most ``keep`` words, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for _, texts in text_slices(batches):
            found = word_array(texts)[0].value_counts()
            for w, n in zip(bytes_of(found.field(0)), found.field(1).to_numpy().tolist(), strict=True):
                counts[w] += n
            if len(counts) > keep:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    each = df.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    settings: Settings
    words: list[bytes]
    values: np.ndarray
    tokens: int
    #: (word, n) of all words, and what each token adds by its bucket.
    counts: DataFrame
    within: np.ndarray


def token_of(words: list[bytes], s: Settings):
    @F.arrow_udf("int")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(words, s)
        for column in columns:
            yield pa.array(coder.numbers(column.cast(pa.binary())), pa.int32())

    return run(F.col("word"))


def _round(df: DataFrame, words: list[bytes], state: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """The state after every group of df has trained from ``state``, and the number of tokens; groups are whole and in order."""
    sent = df.sparkSession.sparkContext.broadcast((words, state))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, state = sent.value
        coder, trainer, now = Coder(words, s), Trainer(s, state), None

        def out() -> Iterator[pa.RecordBatch]:
            trainer.learn(np.zeros(0, np.int32), np.zeros((0, 2 * s.side), np.int32), last=True)
            if trainer.seen:
                new = trainer.state().astype(np.float64) * trainer.seen
                parts = [new[i : i + CHUNK].tobytes() for i in range(0, len(new), CHUNK)]
                columns = [pa.array(range(len(parts)), pa.int32()), pa.array([now] * len(parts), pa.int64()), pa.array([trainer.seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "group", "seen", "sums"])

        for batch, texts in text_slices(batches):
            of = batch.column("group").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(of))[0] + 1).tolist(), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if of[lo] != now:
                    yield from out()
                    trainer, now = Trainer(s, state), int(of[lo])
                target, around, _ = coder.windows(texts[lo:hi], s.side)
                trainer.learn(target, around)
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen: Counter = Counter()
        for b in batches:
            for chunk, n, raw in zip(*(b.column(i).to_pylist() for i in ("chunk", "seen", "sums")), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw)
                seen[chunk] += n
        columns = [pa.array(list(sums), pa.int32()), pa.array([seen[c] for c in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "seen", "sums"])

    learned = df.mapInArrow(learn, "chunk int, group bigint, seen bigint, sums binary")
    # added in the groups' order, so that sums are the same to the last bit
    added = learned.repartition("chunk").sortWithinPartitions("group").mapInArrow(add, "chunk int, seen bigint, sums binary")
    state, seen = state.copy(), 0
    for r in added.collect():  # one row a chunk
        at = r["chunk"] * CHUNK
        part = np.frombuffer(bytes(r["sums"])) / r["seen"]
        state[at : at + len(part)] = part
        seen = r["seen"]
    return state, seen


def train(df: DataFrame, settings: Settings = Settings(), text: str = "text") -> Model:
    """A network trained once over every token of df. Without any token it stays at its start."""
    s = settings
    small_batches(df.sparkSession)
    counts = Scratch(df.sparkSession, "lm").table(count_words(df, text))
    head = counts.orderBy(F.desc("n"), "word").limit(s.frequent).collect()  # s.frequent rows
    words = [bytes(r["word"]) for r in head]
    unigram, kinds = np.zeros(s.vocabulary), np.zeros(s.vocabulary)
    for r in counts.groupBy(token_of(words, s).alias("token")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # a row a token
        unigram[r["token"]], kinds[r["token"]] = r["n"], r["kinds"]
    first = s.vocabulary - s.rare
    within = np.zeros(s.vocabulary)
    within[first:] = -np.log(unigram[first:] + 2 * EXTRA * np.maximum(kinds[first:], 1))
    start = Network(s, counts=unigram).values
    state, seen = np.concatenate([start, np.full(len(start), 1e-8, np.float32)]), 0
    groups = max(1, math.ceil(unigram.sum() / s.group_tokens))
    rounds = min(s.rounds, groups)
    order = all_columns_hash(df)
    dealt = df.select(F.col(text).alias("text"), order.alias("order"), F.pmod(order, F.lit(groups)).alias("group"))
    for r in range(rounds):
        own = dealt.where(F.col("group") % rounds == r).repartition(math.ceil(groups / rounds), "group")
        state, n = _round(own.sortWithinPartitions("group", "order", "text"), words, state, s)
        seen += n
    values = state[: len(start)]
    return Model(s, words, values, seen, counts, within)


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, n, s) from rows of groups in order, each begun by its texts' scores; ``value`` is a word's logarithm in UNITs."""
    texts, sums = np.zeros(0, SCORED), np.zeros(0)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts["sha"]], pa.binary()), pa.array(texts["n"]), pa.array(texts["s"] + sums * UNIT)], names=["sha", "n", "s"])

    for b in batches:
        data = b.column("data").cast(pa.binary())
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset :]
        value = b.column("value").to_numpy(zero_copy_only=False)
        heads = np.nonzero(b.column("value").is_null().to_numpy(zero_copy_only=False))[0]
        cuts = [0, *heads.tolist(), b.num_rows]
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if k:
                if len(texts):
                    yield out()
                texts, lo = np.frombuffer(data[lo].as_py(), SCORED), lo + 1
                sums = np.zeros(len(texts))
            if lo < hi:
                at = np.frombuffer(data.buffers()[2], np.int32, (ends[hi] - ends[lo]) // 4, ends[lo])
                times = np.diff(ends[lo : hi + 1]) // 4
                sums += np.bincount(at, np.repeat(value[lo:hi], times), len(sums))
    if len(texts):
        yield out()
    give_back()


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``n_tokens``, ``sum_logprob`` and ``mean_logprob``; columns of these names are replaced.

    Texts without words (null, empty) have no tokens, the sum 0 and a null mean. A word outside the vocabulary counts as its
    bucket times its share in the bucket, (count + EXTRA) of the bucket's sum; a word that was never seen has the count 0.
    """
    small_batches(df.sparkSession)
    settings = model.settings
    sent = df.sparkSession.sparkContext.broadcast((model.words, model.values, model.within))
    scratch = Scratch(df.sparkSession, "lm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values, within = sent.value
        net, group = Network(settings, values), Group(words, settings)
        number = TaskContext.get().partitionId() << 32
        for _, texts in text_slices(batches):
            group.take(texts, net, within)
            if group.full():
                yield from group.rows(number)
                group, number = Group(words, settings), number + 1
        if group.texts:
            yield from group.rows(number)

    held = scratch.table(df.select(F.col(text).alias("text")).mapInArrow(run, "group bigint, word binary, data binary"))
    value = F.round(F.log(F.coalesce("n", F.lit(0)) + EXTRA) / UNIT).cast("bigint").alias("value")
    known = held.where("word is not null").join(model.counts, "word", "left").select("group", "data", value)
    every = held.where("word is null").select("group", "data", F.lit(None).cast("bigint").alias("value")).union(known)
    every = every.repartition("group").sortWithinPartitions("group", F.col("value").isNotNull())
    each = every.mapInArrow(_add_words, "sha binary, n bigint, s double")
    # equal texts get one score
    found = scratch.table(each.groupBy(F.col("sha").alias("__sha")).agg(F.max(F.struct("n", "s")).alias("__lm")))
    scratch.drop(held)
    scored = df.withColumn("__sha", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).join(found, "__sha", "left")
    out = {"n_tokens": F.col("__lm.n"), "sum_logprob": F.col("__lm.s"), "mean_logprob": F.try_divide(F.col("__lm.s"), F.col("__lm.n"))}
    return scored.withColumns(out).drop("__lm", "__sha")
