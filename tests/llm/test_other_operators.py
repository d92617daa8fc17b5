import base64
import hashlib
import io
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrules.llm import packing, sharding, url_filters, warc

# --- urls -------------------------------------------------------------------------------------------------------------


def judge(url, rules, default="allow"):
    url = url or ""
    _, found, rest = url.partition("://")
    host = path = ""
    if found:
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), rest[cut:]
        path = rest[: min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("run", [50_000, 5, 1])
def test_url_filter_against_a_loop(spark, run):
    rng = random.Random(run)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "net", "org"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "/x/y", "/xy", "/é\U0001f600"]) for _ in range(rng.randrange(3)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values()) + [("block", "", "/x/x")]
    urls = [f"{rng.choice(['http', 'ftp'])}://{host().upper() if rng.random() < 0.2 else host()}{path()}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(400)]
    urls += [None, "", "no-scheme/x", "http://", "http://?x", "http:///x", "a://b://c/x", "http://a..b/x", "http://a\nb/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.apply_rules(df, url_filters.rule_table(spark, rules), run_rules=run).collect()}
    assert [got[i] for i in range(len(urls))] == [judge(u, rules) for u in urls]


def test_url_filter_odd(spark):
    df = spark.sql("SELECT 1 AS page_id, 'http://a.net/x' AS url, 'old' AS host, 'old' AS rule, 5 AS run, 6 AS salt, 7 AS key, 8 AS top UNION ALL SELECT 1, 'http://a.net/x', 'old', 'old', 5, 6, 7, 8 UNION ALL SELECT null, null, null, null, null, null, null, null")
    rules = url_filters.rule_table(spark, [("block", "NET", "/")])
    got = url_filters.apply_rules(df, rules)
    assert [(r.host, r.rule, r.key, r.verdict) for r in got.orderBy("page_id").collect()] == [("", None, None, "allow")] + [("a.net", "net/", 7, "block")] * 2
    assert url_filters.apply_rules(df.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filters.apply_rules(df, url_filters.rule_table(spark, []), default="block").collect()] == ["block"] * 3


# --- WARC -------------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 9000), (None, "u", "same"), (None, "u", "only null"), (5, "u", "é" * 9000)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS key", "3 AS best", "4 AS type")


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark).repartition(3), with_payload=True).collect()
    rows = sorted(((r.record_id, r.payload_bytes, r.type, r.refers_to) for r in got), key=str)
    assert rows == sorted([("1", 4, "revisit", "2"), ("2", 4, "response", None), ("3", 0, "revisit", "4"), ("4", 0, "response", None), ("5", 18000, "response", None), ("5", 18000, "response", None), ("", 4, "revisit", "2"), ("", 9, "response", None)], key=str)
    for r in got:
        if r.type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
    assert {r.type for r in warc.round_trip(pages(spark), min_bytes=5).where("record_id < '5'").collect()} == {"response"}


def sample_archive(n=80):
    records = [warc.record_bytes("response", str(i), f"http://h/{i}", f"<html>{'text ' * (i % 9)}{i}</html>".encode(), None) for i in range(n)]
    return records, warc.archive_bytes(records, warc.train(records))


def test_reader_uses_the_dictionary_and_checks_frames():
    records, content = sample_archive()
    assert content[:4] == b"\x5d\x2a\x4d\x18"
    assert [r.headers["warc-record-id"] for r in warc.RecordReader(io.BytesIO(content), chunk=7)] == [f"<urn:x-page:{i}>" for i in range(80)]
    size = 8 + int.from_bytes(content[4:8], "little")
    for bad, what in (
        (content[:-3], "cut off"),
        (content[:6], "no frame"),
        (content[: size // 2], "dictionary is cut off"),
        (content[:size] + b"xxxx" + content[size:], "no frame begins"),
        (content[size:], "damaged"),
        (content[:-30] + bytes(b ^ 255 for b in content[-30:-20]) + content[-20:], "damaged|Content|digest|headers"),
    ):
        with pytest.raises(warc.WarcError, match=what):
            list(warc.RecordReader(io.BytesIO(bad)))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date___"), (b"Content-Length: ", b"Content-Length: 1"), (b"<html>", b"<HTML>"), (b"HTTP/1.1 200", b"nothing here")])
def test_reader_checks_records(old, new):
    records, _ = sample_archive(1)
    assert old in records[0]
    with pytest.raises(warc.WarcError):
        list(warc.RecordReader(io.BytesIO(warc.archive_bytes([records[0].replace(old, new)], b""))))


def test_exported_files_are_read_back(spark, tmp_path):
    stored = warc.write_archives(warc.plan_records(pages(spark)), archive_size=10)
    assert warc.export(stored, str(tmp_path)).count() == len(list(tmp_path.iterdir())) == 8
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("name"), "content")
    assert warc.read_archives(files).count() == 8


# --- packing ----------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(0, 4, 11)
        lengths = np.nonzero(counts)[0]
        for k in (1, 2, 3):
            bounds, padding = packing.boundaries(counts, k)
            pad = lambda b: sum(counts[x] * (min(y for y in b if y >= x) - x) for x in lengths)
            ways = [c for n in range(1, min(k, len(lengths)) + 1) for c in itertools.combinations(lengths.tolist(), n) if c[-1] == lengths[-1]]
            assert padding == pad(bounds) == min(map(pad, ways)) and len(bounds) <= k
    assert packing.boundaries(np.zeros(5, int), 3) == ([], 0)


def test_packing_is_whole(spark):
    rng = random.Random(7)
    lengths = [rng.choice([0, 1, 5, 9, 10, 11, 25, 100]) for _ in range(300)]
    df = spark.createDataFrame([(i, " ".join(["x"] * n)) for i, n in enumerate(lengths)], "doc_id bigint, text string")
    s = packing.Settings(buckets=3, max_len=10, batch_tokens=40)
    got = packing.pack(df, s).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.begin, r.n_tokens))
        assert r.padding == r.bucket_len - r.n_tokens >= 0 and r.n_tokens <= 10
    for i, n in enumerate(lengths):
        assert sorted(pieces[i]) == [(k, 10 * k, min(10, n - 10 * k)) for k in range(max(1, -(-n // 10)))]
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r.slot)
    room = {r.bucket: max(1, 40 // max(1, r.bucket_len)) for r in got}
    last = {b: max(k for x, k in batches if x == b) for b, _ in batches}
    for (b, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == room[b] or k == last[b])
    assert all({k for x, k in batches if x == b} == set(range(n + 1)) for b, n in last.items())


def test_packed_sequences_rebuild_every_text(spark, odd_documents):
    """Pieces with their tokens, put together by row, are the text's own words; a row that is there twice gives them twice."""
    s = packing.Settings(buckets=3, max_len=7, batch_tokens=40)
    got = packing.pack(odd_documents, s, sequences=packing.words(F.col("text"))).collect()
    plain = packing.pack(odd_documents, s).collect()
    assert Counter(r[:9] for r in got) == Counter(map(tuple, plain))
    pieces = defaultdict(list)
    for r in got:
        assert len(r.tokens) == r.n_tokens <= r.bucket_len
        pieces[r.doc_id, r.text_hash].append((r.piece, r.tokens))
    texts = Counter((r.doc_id, r.text) for r in odd_documents.collect())
    hashes = {r.text: r.h for r in odd_documents.select("text", F.xxhash64("text").alias("h")).collect()}
    assert len(pieces) == len(texts)
    for (i, text), n in texts.items():
        own = sorted(pieces[i, hashes[text]])
        for copy in range(n):
            assert [w for _, tokens in own[copy::n] for w in tokens] == (text or "").split()
    ids = packing.pack(odd_documents, s, sequences=F.when(F.col("doc_id") != 2, F.array(F.lit(5), F.lit(6)))).collect()
    assert sorted(map(str, (r.tokens for r in ids))) == ["[5, 6]"] * 6 + ["[]"] * 3


def test_packing_odd(odd_documents, no_documents):
    got = packing.pack(odd_documents).collect()
    assert sum(r.n_tokens for r in got) == 60000 + 3 * 9 + 3 and len(got) == 8 + -(-60000 // 4096)
    assert packing.pack(no_documents).count() == 0


# --- sharding ---------------------------------------------------------------------------------------------------------


def shards(df, **kwargs):
    got = sharding.shard(df, **kwargs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return got, {s: sum(r.size for r in own) for s, own in by.items()}


def test_sharding_is_even_with_a_hot_text(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot text', repeat('y', cast(id % 97 AS int))) AS text")
    got, sizes = shards(df)
    assert len(got) == 9000 and set(sizes) == set(range(8))
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) < 0.01 * mean + 200
    hot = sorted((r.shard, r.slot) for r in got if r.text == "hot text")
    at = {k: i for i, k in enumerate(sorted((r.shard, r.slot) for r in got))}
    assert at[hot[-1]] - at[hot[0]] == len(hot) - 1  # they follow each other
    assert {(r.doc_id, r.shard, r.slot) for r in shards(df.repartition(3))[0]} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_sharding_keeps_texts_apart_that_share_a_key(spark, monkeypatch):
    """Even if the first bits of all texts' hashes are the same, rows of one text follow each other within a bin."""
    monkeypatch.setattr(sharding, "shard_key", lambda text="text": F.shiftrightunsigned(F.col("__hash"), 64 - sharding.ROW_BITS).bitwiseOR(F.lit(9 << sharding.ROW_BITS)))
    df = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id % 5) AS text")
    got, _ = shards(df, shards=1, bins_per_shard=1)
    order = [r.text for r in sorted(got, key=lambda r: r.slot)]
    assert len(got) == 600 and sum(a != b for a, b in itertools.pairwise(order)) == 4


def test_splitters_refine_until_tolerance(spark):
    keys = spark.range(5000).selectExpr("IF(id % 2 = 0, 7, (1L << 62) + id) AS key", "1 AS size")
    found = sharding.find_splitters(keys, 4, 1, 0.001)
    assert found.rounds > 1 and found.total_bytes == 5000
    below = [keys.where(F.col("key") < c).count() for c in found.cuts]
    assert below[2] in range(3745, 3756) and set(below[:2]) <= {0, 2500}  # equal keys cannot be cut


def test_bin_of_counts_cuts(spark):
    cuts = sorted(random.Random(1).randrange(1 << 63) for _ in range(40)) + [1 << 63]
    keys = [0, 1, (1 << 63) - 1, *cuts[:-1], *(c - 1 for c in cuts[:-1])]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.bin_of(F.col("k"), cuts[:-1]).alias("b")).collect()
    assert all(r.b == sum(c <= r.k for c in cuts[:-1]) for r in got)


def test_sharding_odd(odd_documents, no_documents):
    got, _ = shards(odd_documents)
    assert len(got) == 9 and {r.size for r in got if r.text is None} == {1}
    assert sharding.shard(no_documents).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0] > kept[1] == kept[2] > kept[3] > kept[4] > 0
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


def test_pipeline_odd(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() >= 0
