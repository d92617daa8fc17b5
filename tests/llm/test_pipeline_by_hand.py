import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sparkrules.llm import packing
from sparkrules.llm import queries as llm_queries

from .conftest import edited, prose
from .test_text_operators import brute_classes, brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", llm_queries.oracle_sql())
def test_sql_in_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(llm_queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = llm_queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def without_lines(docs):
    total, pages = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        pages.update({(d["source"], x.strip(" ")) for x in d["text"].split("\n")} - {(d["source"], "")})
    out = []
    for d in docs:
        lines = d["text"].split("\n")
        left = [x for x in lines if not (pages[d["source"], x.strip(" ")] >= 5 and pages[d["source"], x.strip(" ")] > 0.1 * total[d["source"]])]
        out.append(d if len(left) == len(lines) else {**d, "text": "\n".join(left), "n_chars": len("\n".join(left))})
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage's rows, from the rows that plain Python says come before; then run() as a whole."""
    rng = random.Random(14)
    items = [(i, prose(rng, 14)) for i in range(5)]
    docs = []
    for i in range(160):
        text = edited(rng, docs[-1]["text"].split("\n")[1], 0.01) if i % 8 == 2 else prose(rng, rng.randrange(60, 90))
        if i % 10 == 5:
            text += " " + items[i % 5][1]
        if i % 4 == 3:
            text = " ".join(f"{w}{rng.choice(['***', '$$$'])}" for w in text.split())
        text = f"menu of {i % 2}\n{text}\nown {i}"
        docs.append({"doc_id": i, "text": text, "lang": "en", "source": f"s{i % 2}", "n_chars": len(text)})
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = lambda rows: spark.createDataFrame([tuple(d.values()) for d in rows], kind)
    frame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 3)) for i in range(160)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [[d for d in docs if d["doc_id"] % 4 != 3]]
    want.append(without_lines(want[-1]))
    classes = brute_classes([d["text"] for d in want[-1]])
    want.append([d for k, d in enumerate(want[-1]) if classes[k] == k])
    hits = brute_hits([d["text"] for d in want[-1]], items)
    want.append([d for d, h in zip(want[-1], hits, strict=True) if not h[2]])
    assert want[0] != want[1] and len(want[1]) > len(want[2]) > len(want[3]) > 20
    before = docs
    for (_, stage), rows in zip(corpus_pipeline.STAGES, want, strict=False):
        got = stage(spark, frame(before), str(tmp_path)).orderBy("doc_id").collect()
        assert [r.asDict() for r in got] == rows
        before = rows

    size = {d["doc_id"]: len(d["text"].split()) for d in want[-1]}
    bounds, _ = packing.boundaries(np.bincount(list(size.values())), 16)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lens = {i: min(b for b in bounds if b >= n) for i, n in size.items()}
    assert sorted((r.doc_id, r.piece, r.begin, r.n_tokens, r.bucket_len, r.padding) for r in whole) == [(i, 0, 0, n, lens[i], lens[i] - n) for i, n in sorted(size.items())]
    places = defaultdict(list)
    for r in whole:
        places[r.bucket].append((r.batch, r.slot))
    for b, found in places.items():  # every batch has room for more texts than there are
        assert sorted(found) == [(0, k) for k in range(len(found))]
