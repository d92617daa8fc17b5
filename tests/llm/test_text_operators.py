import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrules.llm import decontaminate, exact_dedup, line_dedup, lm_scoring, near_dedup, quality
from sparkrules.llm.common import Scratch, WordHash, number_within, words_of

from .conftest import edited, prose


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_words():
    assert words_of("The É-cole, x1_y".encode()) == ["the".encode(), "É".encode(), b"cole", b"x1", b"y"]
    assert words_of(None) == words_of(b"") == words_of(b" .,") == []


# --- exact deduplication ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_exact_dedup_against_grouping(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(150)] + ["abc" * 50, "abc" * 50, "abc" * 51, None, ""]
    got = {r.doc_id: r for r in exact_dedup.dedup(docs_of(spark, texts), block_bytes=block).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        own, r = groups[t or ""], got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), i == max(own))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_with_colliding_hashes(spark, monkeypatch):
    """With a hash that has two values only, names still follow the blocks."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(2)))
    texts = [f"{i % 7}" * 20 for i in range(40)]
    got = exact_dedup.dedup(docs_of(spark, texts), block_bytes=8).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(i, len([j for j in range(40) if j % 7 == i % 7])) for i in range(33, 40)}


def test_exact_dedup_odd(odd_documents, no_documents):
    got = exact_dedup.dedup(odd_documents).collect()
    assert len(got) == 9 and sum(r.kept for r in got) == 5
    same = [r for r in got if r.group_size == 3 and r.keep_id == 1]
    assert len(same) == 3 and sum(r.kept for r in same) == 1
    empty = [r for r in got if r.group_size == 3 and r.keep_id == 3]
    assert len(empty) == 3 and [r.doc_id for r in empty if r.kept] == [3]
    assert exact_dedup.dedup(no_documents).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def brute_classes(texts):
    sets = []
    for t in texts:
        w = words_of((t or "").encode())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) if sets[i] and sets[j] else (texts[i] or "") == (texts[j] or "")
            if alike:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 200))
        texts += [base] + [edited(rng, base, rng.choice([0.005, 0.01, 0.03, 0.1])) for _ in range(8)]
    chain = prose(rng, 120)
    for _ in range(15):  # each is near the one before, the ends are far apart
        chain = edited(rng, chain, 0.012)
        texts.append(chain)
    hub = prose(rng, 150)
    texts += [edited(rng, hub, rng.uniform(0.01, 0.06)) for _ in range(60)]
    texts += ["a b c", "a  B, c", "a b d", "", None, "!!", "!!", "word"] + texts[:5]
    got = {r.doc_id: r for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(got[i].class_size == sizes[w] and got[i].kept == (i == w) for i, w in enumerate(want))


def test_near_dedup_with_repeated_shingles(spark):
    """A footer that is repeated often leaves the set similarity at 0.806 or so; bands by counts lost half of such pairs."""
    rng = random.Random(12)
    texts = []
    for k in range(20):
        base = " ".join(f"b{k}x{i}" for i in range(104))
        footer = " ".join(f"f{k}x{rng.randrange(10**6)}" for _ in range(20))
        texts += [base, f"{base} {' '.join([footer] * 500)}"]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(40)] == brute_classes(texts) == [i - i % 2 for i in range(40)]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    m = 4000
    a, b = {k: float(rng.integers(1, 6)) for k in range(0, 60)}, {k: float(rng.integers(1, 6)) for k in range(20, 80)}
    owner = np.array([0] * len(a) + [1] * len(b))
    element = np.array([*a, *b], np.uint64) * np.uint64(7919) + np.uint64(1)
    s = near_dedup.signatures(owner, element, np.array([*a.values(), *b.values()]), 2, m)
    both = a.keys() & b.keys()
    want = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in a.keys() | b.keys()) for x in both)
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_one_element_and_texts_without_words():
    owner, element, count = near_dedup.shingles([b"one two", b"", None, b"a a a a a a"], WordHash(), 5)
    assert owner.tolist() == [0, 3] and count.tolist() == [1, 2]
    s = near_dedup.signatures(owner, element, 1 + np.log(count), 4, 20)
    assert (s[0] == element[0]).all() and (s[1] == 0).all()


def test_near_dedup_odd(odd_documents, no_documents):
    got = near_dedup.classes(odd_documents).collect()
    assert len(got) == 9 and sum(r.kept for r in got) == 5
    kept = near_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == 5
    assert near_dedup.classes(no_documents).count() == near_dedup.keep_one(no_documents).count() == 0


# --- lines ------------------------------------------------------------------------------------------------------------


def test_line_dedup_against_counting(spark):
    rng = random.Random(4)
    pages = [(i, rng.choice(["a", "a", "b", None]), "\n".join(rng.choice([f"u{i}-{k}", "menu ", "  menu", "foot", "rare", ""]) for k in range(rng.randrange(6)))) for i in range(80)]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    n, total = Counter(), Counter(s for _, s, _ in pages)
    for _, s, t in pages:
        n.update({(s, x.strip(" ")) for x in t.split("\n")} - {(s, "")})
    drop = {k for k, c in n.items() if c >= 5 and c > 0.3 * total[k[0]]}
    got = {r.doc_id: r for r in line_dedup.drop_lines(df, ratio=0.3).collect()}
    assert drop
    for i, s, t in pages:
        left = [x for x in t.split("\n") if (s, x.strip(" ")) not in drop]
        assert (got[i].text, got[i].n_dropped) == ("\n".join(left), len(t.split("\n")) - len(left))


def test_line_dedup_odd(odd_documents, no_documents):
    got = line_dedup.drop_lines(odd_documents, min_pages=2, ratio=0.5).collect()
    assert len(got) == 9 and set(got[0].asDict()) == set(odd_documents.columns)
    assert sorted(r.n_dropped for r in got) == [0] * 6 + [3] * 3
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert line_dedup.drop_lines(no_documents).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_hits(texts, items, window=10):
    out = []
    for t in texts:
        w = words_of((t or "").encode())
        hit, names = set(), set()
        for name, item in items:
            iw = words_of((item or "").encode())
            k = min(window, len(iw))
            for p in range(len(iw) - k + 1) if iw else ():
                for q in range(len(w) - k + 1):
                    if w[q : q + k] == iw[p : p + k]:
                        hit |= set(range(q, q + k))
                        names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([1, 4, 9, 10, 11, 40]), 30)) for i in range(25)] + [(98, ""), (99, None)]
    texts = [prose(rng, 60, 30) for _ in range(40)] + ["", None, "the"]
    for i in range(20):
        part = rng.choice(items[:25])[1].split()
        texts.append(" ".join([prose(rng, 20, 30), *part[: rng.choice([8, 9, 10, 25, 40])], prose(rng, 9, 30)]).upper())
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = Scratch(spark, "t").table(decontaminate.build_index(docs_of(spark, texts).repartition(3)))
    found = decontaminate.search(index, bench, block_bytes=block).withColumn("n_hit", decontaminate.n_hit())
    got = {int(r.id): (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)


def test_proximity(spark):
    docs = docs_of(spark, ["red fox and blue cat", "red " + "x " * 20 + "fox cat blue", "blue red cat fox", "red fox"])
    index = Scratch(spark, "t").table(decontaminate.build_index(docs))
    bench = spark.createDataFrame([(7, "fox red cat blue")], "item_id bigint, text string")
    got = {int(r.id): [(h.begin, h.end) for h in r.hits] for r in decontaminate.search(index, bench, within=5).collect()}
    assert got == {0: [(0, 5)], 1: [], 2: [(0, 4)], 3: []}


def test_decontamination_odd(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(None, "same line"), (2, None), (2, "b c d")], "item_id bigint, text string")
    index = Scratch(spark, "t").table(decontaminate.build_index(odd_documents))
    got = decontaminate.search(index, bench).collect()
    assert len(got) == 9 and [list(r["items"]) for r in got if r.id == "1"] == [["", "2"]] * 2
    assert decontaminate.search(index, bench.limit(0)).count() == 9
    assert decontaminate.search(Scratch(spark, "t").table(decontaminate.build_index(no_documents)), bench).count() == 0


# --- quality and language model ---------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) if i % 4 else " ".join(f"{w}{rng.choice(['***', '$$$'])}" for w in prose(rng, 60).split()) for i in range(240)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)], "doc_id bigint, quality int")
    kept = labels.where(~quality.held_out(F.col("doc_id")))
    # labels of held-out rows make no difference
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert (a == b).all() and (a != 0).any() and (quality.fit(docs, kept) == a).all()
    got = quality.score(docs, a).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert all(r.predicted == (r.doc_id % 4 > 0) and 0 <= r.score <= 1 for r in got)
    assert 40 < sum(r.held for r in got) < 120


def test_quality_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (4, 0)], "doc_id bigint, quality int")
    got = quality.score(odd_documents, quality.fit(odd_documents, labels)).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    none = quality.score(odd_documents, quality.fit(odd_documents, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(no_documents, quality.fit(no_documents, labels)).count() == 0


def test_network_gradient_and_normalisation():
    s = lm_scoring.Settings(classes=3, per_class=4, rare=2, width=5, side=1)
    rng = np.random.default_rng(2)
    net = lm_scoring.Network(s)
    around, target = rng.integers(0, 12, (7, 2)), rng.integers(0, 12, 7)
    total = sum(np.exp(net.log_probs(np.full(7, t), around)) for t in range(12))
    assert np.allclose(total, 1, atol=1e-5)
    grad = lm_scoring.Network(s, np.zeros_like(net.values))
    net.log_probs(target, around, grad)
    for i in rng.integers(0, len(net.values), 25):
        ends = []
        for step in (1e-2, -1e-2):
            other = lm_scoring.Network(s, net.values)
            other.values[i] += step
            ends.append(-other.log_probs(target, around).astype(np.float64).mean())
        assert abs((ends[0] - ends[1]) / 2e-2 - grad.values[i]) < 2e-3


def test_lm_prefers_order_it_has_seen(spark):
    rng = random.Random(9)
    cycle = [f"c{i}" for i in range(12)]
    ordered = [" ".join(cycle[(k + i) % 12] for i in range(80)) for k in range(150)]
    model = lm_scoring.train(docs_of(spark, ordered), lm_scoring.Settings(batch=256))
    probe = docs_of(spark, [ordered[0], " ".join(rng.sample(ordered[0].split(), 80)), "", None])
    got = {r.doc_id: r for r in lm_scoring.score(probe, model).collect()}
    assert got[0].mean_logprob > got[1].mean_logprob + 0.5 and got[0].n_tokens == 80
    assert (got[2].n_tokens, got[2].sum_logprob, got[2].mean_logprob) == (0, 0.0, None) == (got[3].n_tokens, got[3].sum_logprob, got[3].mean_logprob)
    assert model.tokens == 150 * 80


def test_lm_knows_every_word(spark):
    """Words outside the vocabulary count by their own counts, as in a sum over plain dictionaries; unseen words count least."""
    rng = random.Random(10)
    s = lm_scoring.Settings(classes=4, per_class=8, rare=4)
    texts = [prose(rng, 120) for _ in range(60)]
    model = lm_scoring.train(docs_of(spark, texts), s)
    unseen = " ".join(f"q{i}" for i in range(120))
    probe = [texts[0], unseen, texts[0].replace(" w", " ") + " w1 w1 w1", texts[0]]
    got = {r.doc_id: r for r in lm_scoring.score(docs_of(spark, probe), model).collect()}
    assert got[1].mean_logprob < min(got[0].mean_logprob, got[2].mean_logprob) - 0.5 and got[3].sum_logprob == got[0].sum_logprob
    counts = Counter(w for t in texts for w in words_of(t.encode()))
    coder, net = lm_scoring.Coder(model.words, s), lm_scoring.Network(s, model.values)
    size, kinds = Counter(), Counter()
    for w, n in counts.items():
        size[coder[w]] += n
        kinds[coder[w]] += 1
    for i, t in enumerate(probe):
        want = net.log_probs(*coder.windows([t.encode()], s.side)[:2]).astype(float).sum()
        for w in words_of(t.encode()):
            if w not in model.words:
                want += np.log((counts[w] + 0.5) / (size[coder[w]] + kinds[coder[w]]))
        assert got[i].sum_logprob == pytest.approx(want, abs=1e-2)


def test_lm_does_not_depend_on_partitions(spark):
    rng = random.Random(11)
    s = lm_scoring.Settings(classes=4, per_class=8, rare=4, batch=64, group_tokens=1500)
    docs = docs_of(spark, [prose(rng, rng.randrange(0, 120)) for _ in range(150)] + ["same text here"] * 40)
    one, many = (lm_scoring.train(docs.repartition(n), s) for n in (1, 37))
    assert one.tokens == many.tokens > 3 * 1500 and one.words == many.words
    assert (one.values == many.values).all()


def test_lm_odd(odd_documents, no_documents):
    model = lm_scoring.train(odd_documents)
    got = lm_scoring.score(odd_documents, model)
    assert got.count() == 9 and got.where("n_tokens = 60000").count() == 1
    empty = lm_scoring.train(no_documents)
    assert empty.tokens == 0 and lm_scoring.score(odd_documents, empty).count() == 9
    assert lm_scoring.score(no_documents, empty).count() == 0


def test_word_counts_cover_everything(spark):
    texts = ["a b a", "b c " * 100, None]
    got = {bytes(r.word): r.n for r in lm_scoring.count_words(docs_of(spark, texts), keep=1).collect()}
    assert got == {b"a": 2, b"b": 101, b"c": 100}


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).selectExpr("id", "IF(id < 300, null, id % 3) AS g")
    got = number_within(df, "g", F.xxhash64("id"), [F.col("id")], "nth", bins=7).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r.nth)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by[None]) == 300


def plain_shingles(text: str | None) -> set:
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_classes(rows: list[tuple], similarity: float = 0.8) -> set:
    """Components of all pairs of equal texts and of texts whose sets are similar; pairs without a common shingle are not."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first, sets, postings = {}, {}, {}
    for i, t in rows:
        if (j := first.setdefault(t or "", i)) != i:
            parent[root(i)] = root(j)
            continue
        sets[i], met = plain_shingles(t), {}
        for g in sets[i]:
            for j in postings.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            postings[g].append(i)
        for j, n in met.items():
            if n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    groups: dict = {}
    for i in parent:
        groups.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def found_classes(df) -> set:
    groups: dict = {}
    for r in near_dedup.classes(df).collect():
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_classes_where_texts_repeat_themselves(spark):
    """Texts whose first half stands in them up to 200 times, with edits and with footers that are repeated as often."""
    rng, rows = random.Random(8), []
    for _ in range(12):
        words = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        footer = " ".join(f"f{rng.randrange(10**6)}" for _ in range(18))
        for times, edits, feet in ((1, 0, 0), (50, 1, 0), (200, 2, 0), (200, 3, 0), (1, 1, 40), (1, 9, 0)):
            own = words[:]
            for at in rng.sample(range(100), edits):
                own[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[:50] * (times - 1) + own) + f" {footer}" * feet))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_classes(df) == plain_classes(rows)


def test_classes_of_documents_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert found_classes(df) == plain_classes([tuple(r) for r in df.collect()])


def test_connected_with_hubs_of_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB", 6)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(299, x) for x in range(40, 60)] + [(i, i + 1) for i in range(400, 430)]
    want: dict = {}
    for a, b in edges:
        both = want.get(a, {a}) | want.get(b, {b})
        want |= dict.fromkeys(both, both)
    rows = near_dedup.connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "hubs")).collect()
    comp = {r.id: r.comp for r in rows}
    assert len(comp) == len(rows) and comp.keys() | set(comp.values()) <= want.keys()
    got: dict = {}
    for x in want:
        got.setdefault(comp.get(x, x), set()).add(x)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}
