"""Further queries: decisions in detail, sliding windows of several shapes, and decoders over messages made from the tables."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import EngineConfig, RuleEngine
from .operators import monitor
from .plans.report import line_diff, stats
from .queries import DAY, FLAGSHIP, LINE, _event_log, _field, lineitem_rules, table
from .sources import arrow_ipc, avro_ocf, protobuf
from .sources.ingest import canonical_text, dead_letters, json_array, parse_json

HOUR = 3600


def div_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotient by zero fits no comparison."""
    share = {"op": "div", "left": "l_quantity", "right": {"op": "sub", "left": "l_linenumber", "right": 3}}
    rules = [{"id": op, "conditions": {"op": op, "expr": share, "value": 7.5}} for op in ("gt", "lte", "neq")]
    return lineitem_rules(spark, sf_dir, {"rules": rules}).bitmasks()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _sliding(entity: str, function: str, seconds: int, op: str, value: float, **more) -> dict:
    return {"window": {"entity_field": entity, "function": function, "duration_seconds": seconds, "op": op, "value": value, **more}}


def window_dedup_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over one channel share it, whatever they compare it with."""
    rules = [{"id": f"n{v}", "conditions": _sliding("user_id", "count", 3 * DAY, "gte", v)} for v in (1, 3, 6)]
    rules += [{"id": "few_but_large", "conditions": {"and": [_sliding("user_id", "count", 3 * DAY, "lt", 3), _sliding("user_id", "max", 3 * DAY, "gt", 80.5, value_field="value")]}}]
    return RuleEngine(EngineConfig(output_columns=("event_id",), window_precision="double")).load_rules_from_dict({"rules": rules}).evaluate(_events(spark, sf_dir), clock="ts").bitmasks()


def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities and three durations in one ruleset."""
    rules = [
        {"id": "user_hour", "conditions": _sliding("user_id", "count", HOUR, "gt", 0)},
        {"id": "user_week", "conditions": _sliding("user_id", "count", 7 * DAY, "gt", 9)},
        {"id": "type_hour", "conditions": _sliding("event_type", "count", HOUR, "gt", 1)},
        {"id": "type_low", "conditions": _sliding("event_type", "min", HOUR, "lt", 10.5, value_field="value")},
    ]
    return RuleEngine(EngineConfig(output_columns=("event_id",), window_precision="double")).load_rules_from_dict({"rules": rules}).evaluate(_events(spark, sf_dir), clock="ts").bitmasks()


DEFAULTED = {"decisions": {"default": "review"}, "rules": [{"id": "cheap", "action": "approve", "conditions": _field("l_extendedprice", "lt", value=9000)}, {"id": "fast", "action": "flag", "conditions": _field("l_tax", "gt", value=0.06)}]}
REVERSED = {
    "decisions": {"default": "approve", "precedence": ["approve", "block", "review", "flag"]},
    "rules": [
        {"id": "heavy", "action": "block", "severity": "CRITICAL", "conditions": _field("l_quantity", "gt", value=30)},
        {"id": "taxed", "action": "review", "conditions": _field("l_tax", "gt", value=0.05)},
        {"id": "cut", "action": "flag", "conditions": _field("l_discount", "gt", value=0.08)},
    ],
}
WEIGHTS = {"rules": [{"id": s.lower(), "severity": s, "conditions": _field("l_linenumber", "gte", value=i + 1)} for i, s in enumerate(("LOW", "MEDIUM", "HIGH", "CRITICAL"))] + [{"id": "own", "weight": 0.5, "severity": "CRITICAL", "conditions": _field("l_linenumber", "gte", value=5)}]}
SHADOWED = {"rules": [{"id": "seen", "action": "review", "conditions": _field("l_quantity", "gt", value=40)}, {"id": "tried", "action": "block", "weight": 60, "shadow": True, "conditions": _field("l_quantity", "gt", value=20)}]}
BANDS = {"rules": [{"id": "a", "action": "score", "weight": 45, "conditions": _field("l_quantity", "gt", value=25)}, {"id": "b", "action": "score", "weight": 35, "conditions": _field("l_discount", "gt", value=0.04)}, {"id": "c", "action": "review", "weight": 1, "conditions": _field("l_linenumber", "eq", value=6)}]}


def decision_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, DEFAULTED).decisions().select(*LINE, "matched", "decision", "winning_rule_id")


def decision_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, REVERSED).decisions().select(*LINE, "decision", "winning_rule_id")


def score_default_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, WEIGHTS).decisions().select(*LINE, "score")


def shadow_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, SHADOWED).decisions().select(*LINE, "matched", "decision", "score", "winning_rule_id")


def risk_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, BANDS).decisions().select(*LINE, "score", "risk_band")


ORDER_RULES = {
    "rules": [
        {"id": "large", "action": "review", "conditions": _field("o_totalprice", "gt", value=300000)},
        {"id": "open", "action": "flag", "conditions": _field("o_orderstatus", "eq", value="O")},
        {"id": "urgent", "action": "score", "conditions": _field("o_orderpriority", "starts_with", value="1")},
    ]
}


def _orders(spark: SparkSession, sf_dir: str):
    return RuleEngine(EngineConfig(output_columns=("o_orderkey",))).load_rules_from_dict(ORDER_RULES).evaluate(table(spark, sf_dir, "orders"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir).grouped("o_orderkey")
    return found.select("decision", F.size("rows").alias("n"), F.md5(F.array_join("rows", ",")).alias("rows_md5"))


def filter_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter_decision("review", "score").select("o_orderkey", "decision")


def filter_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).filter_rule("urgent")


def bitmask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).packed_bitmasks()


def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        {"id": "bulk", "conditions": _field("l_quantity", "gte", value=40)},
        {"id": "huge", "conditions": _field("l_quantity", "gt", value=45)},
        {"id": "tiny", "conditions": _field("l_quantity", "lt", value=3)},
        {"id": "never", "conditions": {"and": [_field("l_tax", "gt", value=0.08), _field("l_tax", "lte", value=0.08)]}},
    ]
    found = RuleEngine().load_rules_from_dict({"rules": rules}).analyze_conflicts().findings
    return spark.createDataFrame([(f.kind, f.first, f.second, f.field) for f in found], "kind string, first string, second string, field string")


def ruleset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruleset = RuleEngine().load_rules_from_dict(FLAGSHIP).ruleset
    return spark.createDataFrame(stats(ruleset).rows(), "kind string, name string, n bigint")


def ruleset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(line_diff("rules:\n- id: a\n  weight: 5\n- id: b", "rules:\n- id: a\n  weight: 7\n- id: b\n- id: c"), "sign string, line int, text string")


# --- ingestion --------------------------------------------------------------------------------------------------------

PROPS = {"rules": [{"id": "k", "conditions": _field("k", "gt", value=50)}]}


def _evaluated(parsed, keys: tuple[str, ...]) -> DataFrame:
    return RuleEngine(EngineConfig(output_columns=keys)).load_rules_from_dict(PROPS).evaluate(parsed).bitmasks()


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is no JSON, every eleventh has a text where a number belongs."""
    bad = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).when(F.col("event_id") % 11 == 0, F.lit('{"k":"many"}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", bad.alias("value"))


def json_array_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "props", F.lit(', {"k": 51}, {}]')).alias("value"))
    ruleset = RuleEngine().load_rules_from_dict(PROPS).ruleset
    parsed = parse_json(json_array(documents, keep=("event_id",)), ruleset, keep=("event_id", "pos"))
    return _evaluated(parsed.good, ("event_id", "pos"))


def ndjson_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks around an object do not matter, and blank lines are no records."""
    line = F.when(F.col("event_id") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "props", F.lit(" \t ")))
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    return _evaluated(parse_json(lines, RuleEngine().load_rules_from_dict(PROPS).ruleset, keep=("event_id",)).good, ("event_id",))


def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_json(_spoiled(spark, sf_dir), RuleEngine().load_rules_from_dict(PROPS).ruleset)
    return dead_letters(parsed.bad, "events").select("source", "code", "payload")


def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_json(_spoiled(spark, sf_dir), RuleEngine().load_rules_from_dict(PROPS).ruleset, keep=("event_id",), type_errors="dead_letter")
    return parsed.bad.select("event_id", "code")


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_json(_spoiled(spark, sf_dir), RuleEngine().load_rules_from_dict(PROPS).ruleset, type_errors="dead_letter")
    return monitor.rejects_by(dead_letters(parsed.bad, "events"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"p":'), "p_partkey", F.lit("}"))).otherwise(F.col("p_name")).alias("value"))
    return canonical_text(lines, "parts", "shop", "one", now_ms=F.lit(5))


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV, as the file reader parses them."""
    from .sources.files import csv_lines

    lines = table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_custkey", F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""p"""'))).alias("value"))
    parsed = csv_lines(lines, "o_orderkey bigint, status string, customer int, priority string")
    rules = [{"id": "open", "conditions": _field("status", "eq", value="O")}, {"id": "low", "conditions": _field("customer", "lt", value=50)}, {"id": "urgent", "conditions": _field("priority", "eq", value='1-URGENT, "p"')}]
    return RuleEngine(EngineConfig(output_columns=("o_orderkey",))).load_rules_from_dict({"rules": rules}).evaluate(parsed).bitmasks()


SHIPPED = {"rules": [{"id": "many", "conditions": _field("quantity", "gte", value=30)}, {"id": "back", "conditions": _field("flag", "in", values=["R"])}]}
SHIPPED_KIND = "orderkey bigint, line int, quantity double, flag string"


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_returnflag").alias("flag")]
    return table(spark, sf_dir, "lineitem").select(*columns)


def _decided(df: DataFrame) -> DataFrame:
    return RuleEngine(EngineConfig(output_columns=("orderkey", "line"))).load_rules_from_dict(SHIPPED).evaluate(df).bitmasks()


def _by_row(df: DataFrame, encode: Callable[[dict], bytes]) -> DataFrame:
    """(value): each row as a message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(r) for r in b.to_pylist()], pa.binary())], names=["value"])

    return df.mapInArrow(run, "value binary")


def arrow_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(arrow_ipc.decode_ipc(arrow_ipc.encode_ipc(_shipped(spark, sf_dir)), SHIPPED_KIND))


AVRO = json.dumps({"type": "record", "name": "line", "fields": [{"name": "orderkey", "type": "long"}, {"name": "line", "type": "int"}, {"name": "quantity", "type": "double"}, {"name": "flag", "type": ["null", "string"]}]})


def avro_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def long(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), b""
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def encode(r: dict) -> bytes:
        flag = r["flag"].encode()
        return b"\0\0\0\0\1" + long(r["orderkey"]) + long(r["line"]) + struct.pack("<d", r["quantity"]) + long(1) + long(len(flag)) + flag

    return _decided(avro_ocf.decode_frames(_by_row(_shipped(spark, sf_dir), encode), AVRO))


def _descriptor() -> bytes:
    from google.protobuf import descriptor_pb2

    files = descriptor_pb2.FileDescriptorSet()
    message = files.file.add(name="line.proto", package="shop", syntax="proto3").message_type.add(name="Line")
    for number, (name, kind) in enumerate((("orderkey", 3), ("line", 5), ("quantity", 1), ("flag", 9)), 1):
        message.field.add(name=name, number=number, type=kind, label=1)
    return files.SerializeToString()


def protobuf_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    described, made = _descriptor(), {}

    def encode(r: dict) -> bytes:
        if not made:
            made["cls"] = protobuf.message_class(described, "shop.Line")
        return b"\0\0\0\0\1\0" + made["cls"](**r).SerializeToString()

    return _decided(protobuf.decode_frames(_by_row(_shipped(spark, sf_dir), encode), described, "shop.Line"))


def monitor_medians_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.medians(_event_log(spark, sf_dir), ["event_type"], "event_id", accuracy=10**9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        div_zero, window_dedup_channels, window_spans, decision_default, decision_precedence, score_default_weight, shadow_rule, risk_band, grouped,
        filter_decision, filter_rule, bitmask_columns, conflict_report, ruleset_stats, ruleset_diff, json_array_ingest, ndjson_padded,
        dead_letter_rows, type_mismatch, error_counts, plain_text, csv_records, arrow_messages, avro_frames, protobuf_frames, monitor_medians_approx,
    )
}

SHARE = "l_quantity / (l_linenumber - 3)"
ORDER_SQL = "CASE WHEN o_totalprice > 300000 THEN 'REVIEW' WHEN o_orderstatus = 'O' THEN 'FLAG' WHEN starts_with(o_orderpriority, '1') THEN 'SCORE' ELSE 'APPROVE' END"
SHIPPED_SQL = "SELECT l_orderkey AS orderkey, CAST(l_linenumber AS INT) AS line, l_quantity >= 30 AS rule_many, l_returnflag = 'R' AS rule_back FROM lineitem"
K_SQL = "CAST(json_extract(props, '$.k') AS DOUBLE) > 50"
SPOILED_SQL = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{' || props WHEN event_id % 11 = 0 THEN '{"k":"many"}' ELSE props END AS value FROM events) AS t"""
SECONDS = "(SELECT *, epoch_ms(ts) // 1000 AS sec FROM events) AS e"


def _span(entity: str, seconds: int) -> str:
    return f"(PARTITION BY {entity} ORDER BY sec RANGE BETWEEN {seconds - 1} PRECEDING AND 1 PRECEDING)"


SQL = {
    "div_zero": f"SELECT l_orderkey, l_linenumber, l_linenumber <> 3 AND {SHARE} > 7.5 AS rule_gt, l_linenumber <> 3 AND {SHARE} <= 7.5 AS rule_lte, l_linenumber <> 3 AND {SHARE} <> 7.5 AS rule_neq FROM lineitem",
    "window_dedup_channels": f"""SELECT event_id, n >= 1 AS rule_n1, n >= 3 AS rule_n3, n >= 6 AS rule_n6, n < 3 AND coalesce(top, 0) > 80.5 AS rule_few_but_large
        FROM (SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top FROM {SECONDS} WINDOW w AS {_span("user_id", 3 * DAY)}) AS t""",
    "window_spans": f"""SELECT event_id, count(*) OVER a > 0 AS rule_user_hour, count(*) OVER b > 9 AS rule_user_week, count(*) OVER c > 1 AS rule_type_hour, coalesce(min(value) OVER c, 0) < 10.5 AS rule_type_low
        FROM {SECONDS} WINDOW a AS {_span("user_id", HOUR)}, b AS {_span("user_id", 7 * DAY)}, c AS {_span("event_type", HOUR)}""",
    # APPROVE stands first in the precedence and is not the default here, so it outranks all that is listed; FLAG ranks below REVIEW
    "decision_default": """SELECT l_orderkey, l_linenumber, l_tax > 0.06 OR l_extendedprice < 9000 AS matched, CASE WHEN l_extendedprice < 9000 THEN 'APPROVE' ELSE 'REVIEW' END AS decision,
        CASE WHEN l_extendedprice < 9000 THEN 'cheap' ELSE '' END AS winning_rule_id FROM lineitem""",
    "decision_precedence": """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'FLAG' WHEN l_tax > 0.05 THEN 'REVIEW' WHEN l_quantity > 30 THEN 'BLOCK' ELSE 'APPROVE' END AS decision,
        CASE WHEN l_discount > 0.08 THEN 'cut' WHEN l_tax > 0.05 THEN 'taxed' WHEN l_quantity > 30 THEN 'heavy' ELSE '' END AS winning_rule_id FROM lineitem""",
    "score_default_weight": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber >= 5 THEN 100.5 WHEN l_linenumber = 4 THEN 100 WHEN l_linenumber = 3 THEN 60 WHEN l_linenumber = 2 THEN 30 ELSE 10 END AS DOUBLE) AS score FROM lineitem",
    "shadow_rule": """SELECT l_orderkey, l_linenumber, l_quantity > 20 AS matched, CASE WHEN l_quantity > 40 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
        CAST(CASE WHEN l_quantity > 40 THEN 10 ELSE 0 END AS DOUBLE) AS score, CASE WHEN l_quantity > 40 THEN 'seen' ELSE '' END AS winning_rule_id FROM lineitem""",
    "risk_band": """SELECT l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 40 OR l_linenumber = 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
        FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 45 ELSE 0 END + CASE WHEN l_discount > 0.04 THEN 35 ELSE 0 END + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS score FROM lineitem) AS t""",
    "grouped": f"SELECT decision, CAST(count(*) AS INT) AS n, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS rows_md5 FROM (SELECT o_orderkey, {ORDER_SQL} AS decision FROM orders) AS t GROUP BY decision",
    "filter_decision": f"SELECT o_orderkey, decision FROM (SELECT o_orderkey, {ORDER_SQL} AS decision FROM orders) AS t WHERE decision IN ('REVIEW', 'SCORE')",
    "filter_rule": "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1')",
    "bitmask_columns": "SELECT o_orderkey, CAST((o_totalprice > 300000)::INT + 2 * (o_orderstatus = 'O')::INT + 4 * starts_with(o_orderpriority, '1')::INT AS BIGINT) AS mask_0 FROM orders",
    "conflict_report": "SELECT * FROM (VALUES ('DEAD', 'never', '', ''), ('SUBSUMES', 'bulk', 'huge', 'l_quantity'), ('CONFLICT', 'bulk', 'tiny', 'l_quantity'), ('CONFLICT', 'huge', 'tiny', 'l_quantity')) AS t(kind, first, second, field)",
    "ruleset_stats": """SELECT kind, name, CAST(n AS BIGINT) AS n FROM (VALUES ('action', 'block', 2), ('action', 'flag', 1), ('action', 'review', 1), ('severity', 'HIGH', 1), ('severity', 'LOW', 2), ('severity', 'MEDIUM', 1),
        ('operator', 'eq', 1), ('operator', 'gt', 2), ('operator', 'gte', 1), ('operator', 'in', 1),
        ('field', 'l_discount', 1), ('field', 'l_extendedprice', 1), ('field', 'l_linenumber', 1), ('field', 'l_quantity', 1), ('field', 'l_returnflag', 1)) AS t(kind, name, n)""",
    "ruleset_diff": "SELECT sign, CAST(line AS INT) AS line, text FROM (VALUES ('-', 3, '  weight: 5'), ('+', 3, '  weight: 7'), ('+', 5, '- id: c')) AS t(sign, line, text)",
    "json_array_ingest": f"SELECT event_id, CAST(0 AS INT) AS pos, {K_SQL} AS rule_k FROM events UNION ALL SELECT event_id, 1, true FROM events UNION ALL SELECT event_id, 2, false FROM events",
    "ndjson_padded": f"SELECT event_id, {K_SQL} AS rule_k FROM events WHERE event_id % 5 <> 0",
    "dead_letter_rows": f"SELECT 'events' AS source, 'MALFORMED_JSON' AS code, value AS payload FROM {SPOILED_SQL} WHERE event_id % 7 = 0",
    "type_mismatch": f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'MALFORMED_JSON' ELSE 'TYPE_MISMATCH' END AS code FROM {SPOILED_SQL} WHERE event_id % 7 = 0 OR event_id % 11 = 0",
    "error_counts": f"SELECT 'events' AS source, CASE WHEN event_id % 7 = 0 THEN 'MALFORMED_JSON' ELSE 'TYPE_MISMATCH' END AS code, count(*) AS n FROM {SPOILED_SQL} WHERE event_id % 7 = 0 OR event_id % 11 = 0 GROUP BY code",
    "plain_text": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"p":' || p_partkey || '}' ELSE
        '{"ts_ms":5,"source":"parts","service":"shop","instance":"one","level":"INFO","message":"' || p_name || '"}' END AS value FROM part""",
    "csv_records": "SELECT o_orderkey, o_orderstatus = 'O' AS rule_open, o_custkey < 50 AS rule_low, o_orderpriority = '1-URGENT' AS rule_urgent FROM orders",
    "arrow_messages": SHIPPED_SQL,
    "avro_frames": SHIPPED_SQL,
    "protobuf_frames": SHIPPED_SQL,
    "monitor_medians_approx": "SELECT event_type, quantile_disc(event_id, 0.5) AS median_event_id FROM events GROUP BY event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
