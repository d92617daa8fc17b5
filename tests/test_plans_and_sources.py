import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrules import EngineConfig, RuleEngine
from sparkrules.cli import main
from sparkrules.operators import monitor
from sparkrules.operators.dedupe import first_per_key
from sparkrules.sources import avro_ocf, protobuf
from sparkrules.sources.files import format_of, read_files
from sparkrules.sources.ingest import canonical_text, messages, unwrap_debezium
from sparkrules.sources.kafka import KafkaConfig
from sparkrules.streaming.run import StreamRunner, run_stream
from sparkrules.streaming.state import WindowState

RULE = {"id": "r", "conditions": {"field": "a", "op": "gt", "value": 1}}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 3 AS a", "id AS unused").write.parquet(path)
    e = RuleEngine(EngineConfig(output_columns=("id",))).load_rules_from_dict({"rules": [RULE]}).evaluate(spark.read.parquet(path))
    assert "unused" not in plan(e.decisions()) and "Exchange" not in plan(e.decisions())
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert "GreaterThan(a,1)" in e.matched_only()._jdf.queryExecution().explainString(mode)


def test_predicates_are_computed_once(spark):
    slow = {"field": "s", "op": "regex", "value": "x+y"}
    rules = [{"id": f"r{i}", "conditions": {"and": [slow, {"field": "a", "op": "gt", "value": i}]}} for i in range(5)]
    df = spark.createDataFrame([(1, "xy")], "a int, s string").repartition(2)
    assert plan(RuleEngine().load_rules_from_dict({"rules": rules}).evaluate(df).bitmasks()).count("RLIKE") == 1


def test_window_channels_are_shared_and_large_lookups_joined(spark):
    w = {"entity_field": "k", "function": "count", "duration_seconds": 10, "op": "gt"}
    rules = [{"id": f"w{i}", "conditions": {"window": {**w, "value": i}}} for i in range(3)] + [{"id": "l", "conditions": {"field": "k", "op": "in_lookup", "lookup": "big"}}]
    e = RuleEngine()
    e.register_lookup("big", "int_set", list(range(5000)))
    df = spark.createDataFrame([(1, 5)], "k bigint, sec bigint")
    text = plan(e.load_rules_from_dict({"rules": rules}).evaluate(df, clock=F.col("sec")).bitmasks())
    assert "BroadcastHashJoin" in text and text.count("+- Window") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    e = RuleEngine().load_rules_from_dict({"rules": [RULE]}).evaluate(df)
    assert tuple(e.counts().first()) == (0, 0) and e.decisions().count() == 0


def test_debezium(spark):
    lines = ['{"op":"c","after":{"a":1}}', '{"op":"d","before":{"a":2},"after":null}', '{"a":3}', '{"op":"d","before":null}', '{"payload":{"op":"u","after":{}}}']
    got = [json.loads(r.value) for r in unwrap_debezium(messages(spark, lines)).collect()]
    assert got == [{"__op": "c", "a": 1}, {"__op": "d", "a": 2}, {"a": 3}, {"__op": "u"}]


def test_plain_text(spark):
    got = [json.loads(r.value) for r in canonical_text(messages(spark, ['{"a":1}', "disk full"]), "syslog", now_ms=F.lit(5)).collect()]
    assert got[0] == {"a": 1} and got[1]["message"] == "disk full" and got[1]["ts_ms"] == 5


def test_arrow_files(spark, tmp_path):
    batches = [pa.record_batch({"id": pa.array([i * 3 + j for j in range(3)]), "label": pa.array([f"row-{j}" for j in range(3)]).dictionary_encode()}) for i in range(2)]
    for name, make in (("s.arrows", pa.ipc.new_stream), ("f.arrow", pa.ipc.new_file)):
        with make(str(tmp_path / name), batches[0].schema) as w:
            for b in batches:
                w.write_batch(b)
        assert [r.id for r in read_files(spark, str(tmp_path / name)).orderBy("id").collect()] == list(range(6))
    assert format_of("x.PQ") == "parquet" and format_of("y.jsonl") == "ndjson"


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def test_avro(spark, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": "double"}]}
    text = lambda s: zigzag(len(s)) + s
    record = lambda a, s: zigzag(a) + (zigzag(0) if s is None else zigzag(1) + text(s)) + struct.pack("<d", a / 2)
    sync, body = b"0123456789abcdef", record(-5, b"x") + record(7, None)
    meta = zigzag(1) + text(b"avro.schema") + text(json.dumps(schema).encode()) + zigzag(0)
    (tmp_path / "t.avro").write_bytes(b"Obj\x01" + meta + sync + zigzag(2) + text(body) + sync)
    assert [tuple(r) for r in read_files(spark, str(tmp_path / "t.avro")).collect()] == [(-5, "x", -2.5), (7, None, 3.5)]
    frames = spark.createDataFrame([(bytearray(b"\0\0\0\0\1" + record(3, b"y")),), (bytearray(record(4, None)),)], "value binary")
    assert [r.a for r in avro_ocf.decode_frames(frames, json.dumps(schema)).collect()] == [3, 4]
    with pytest.raises(Exception, match="union"):
        avro_ocf.spark_type(["null", "int", "string"])


def test_protobuf(spark, tmp_path):
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet()
    f = files.file.add(name="t.proto", package="p", syntax="proto3")
    m = f.message_type.add(name="M")
    m.field.add(name="id", number=1, type=3, label=1)
    m.field.add(name="tags", number=2, type=9, label=3)
    described = files.SerializeToString()
    cls = protobuf.message_class(described, "p.M")
    raw = [cls(id=i, tags=["a"] * i).SerializeToString() for i in range(3)]
    (tmp_path / "d.bin").write_bytes(b"".join(bytes([len(r)]) + r for r in raw))
    assert [tuple(r) for r in protobuf.read_delimited(spark, str(tmp_path / "d.bin"), described, "p.M").collect()] == [(0, []), (1, ["a"]), (2, ["a", "a"])]
    frames = spark.createDataFrame([(bytearray(b"\0\0\0\0\1\0" + raw[2]),)], "value binary")
    assert protobuf.decode_frames(frames, described, "p.M").first().id == 2


def test_kafka_options():
    c = KafkaConfig("h:1", ("a", "b"), group="g", max_offsets=9)
    assert c.read_options()["subscribe"] == "a,b" and c.read_options()["maxOffsetsPerTrigger"] == "9"
    assert c.write_options("out") == {"kafka.bootstrap.servers": "h:1", "topic": "out"}


def test_dedupe_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, "a", 8), (3, None, 7), (4, None, 6)], "n int, k string, v int")
    assert sorted(r.n for r in first_per_key(df, ["k"], ["n"]).collect()) == [1, 3, 4]


def test_monitor_edges(spark):
    empty = spark.createDataFrame([], "v double")
    assert monitor.histogram(empty, "v").count() == 0
    flat = spark.createDataFrame([(2.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert [(r.bin, r.n) for r in monitor.histogram(flat, "v").collect()] == [(0, 2)]
    assert [monitor.bucket_ms(x) for x in (1000, 3_600_001, 4 * 86_400_000)] == [1000, 60_000, 3_600_000]


def test_stream_with_windows_and_dead_letters(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    w = {"entity_field": "card", "function": "count", "duration_seconds": 10, "op": "gte", "value": 1}
    engine = RuleEngine().load_rules_from_dict({"rules": [{"id": "again", "conditions": {"window": w}}]})
    seen, bad = {}, {}
    runner = StreamRunner(
        engine,
        lambda df, n: seen.__setitem__(n, sorted((r.card, r.decision) for r in df.collect())),
        WindowState(spark, str(tmp_path / "state")),
        clock=lambda: 100.0 + 5 * len(seen),
        dead_letter=lambda df, n: bad.__setitem__(n, df.count()),
        ndjson=True,
    )
    for n, lines in enumerate((['{"card":"a"}', '{"card":"a"}', "{oops"], ['{"card":"a"}', '{"card":"b"}'])):
        (source / f"{n}.txt").write_text("\n".join(lines))
        run_stream(spark.readStream.text(str(source)), runner, str(tmp_path / "check")).awaitTermination()
    assert seen == {0: [("a", "APPROVE"), ("a", "APPROVE")], 1: [("a", "FLAG"), ("b", "APPROVE")]}
    assert bad == {0: 1, 1: 0}


def test_cli(tmp_path, spark, capsys):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [RULE]}))
    (tmp_path / "in.ndjson").write_text('{"a":0}\n{oops\n{"a":5}\n')
    assert main(["validate", str(tmp_path / "rules.json")]) == 0
    assert main(["eval", str(tmp_path / "rules.json"), str(tmp_path / "in.ndjson")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[1:] == [{"n_records": 2, "n_matched": 1}, {"skipped": 1}]
    (tmp_path / "bad.json").write_text('{"rules": [{"id": "x", "action": "blok", "conditions": {}}]}')
    assert main(["validate", str(tmp_path / "bad.json")]) == 1


def test_backtest(spark):
    from sparkrules.operators.backtest import backtest

    df = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "a int, y boolean")
    one = lambda op, v: RuleEngine().load_rules_from_dict({"rules": [{"id": f"{op}{v}", "conditions": {"field": "a", "op": op, "value": v}}]})
    summary, rules = backtest(df, one("gt", 1), one("gt", 2), "y")
    s = summary.first()
    assert (s.total, s.fire_rate_a, s.fire_rate_b, s.new_positives, s.lost, s.agreement) == (4, 0.75, 0.5, 0, 1, 0.75)
    assert (round(s.precision_a, 3), s.recall_a, s.precision_b, s.recall_b) == (0.333, 0.5, 0.5, 0.5)
    assert [tuple(r) for r in rules.collect()] == [("gt2", 2, 0.5)]
    s, rules = backtest(df.limit(0), one("gt", 1), one("gt", 2))
    assert s.first().fire_rate_a is None and [tuple(r) for r in rules.collect()] == [("gt2", 0, None)]
