"""Queries over the driver's tables, one for each group of operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import EngineConfig, Evaluation, RuleEngine
from .operators import monitor
from .operators.backtest import backtest
from .operators.dedupe import first_per_key
from .operators.models import LinearModel
from .plans.binding import Schema
from .sources.ingest import parse_json, unwrap_debezium

DAY = 86400
AS_OF_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Masks:
    """A query that returns, for each row, which conditions hold. tests: rule to (condition, the same in SQL)."""

    source: str
    keys: tuple[str, ...]
    tests: dict[str, tuple[dict, str]]
    #: Further columns of the source, in Spark's SQL and in the oracle's.
    columns: tuple[str, ...] = ()
    sql_columns: tuple[str, ...] | None = None
    lookups: tuple[tuple[str, str, tuple], ...] = ()
    as_of_ms: int | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.source)
        df = df.selectExpr("*", *self.columns) if self.columns else df
        engine = RuleEngine(EngineConfig(output_columns=self.keys))
        for name, kind, values in self.lookups:
            engine.register_lookup(name, kind, list(values))
        engine.load_rules_from_dict({"rules": [{"id": n, "conditions": c} for n, (c, _) in self.tests.items()]})
        return engine.evaluate(df, as_of_ms=self.as_of_ms).bitmasks()

    @property
    def sql(self) -> str:
        tests = ", ".join(f"coalesce({e}, false) AS rule_{n}" for n, (_, e) in self.tests.items())
        more = self.columns if self.sql_columns is None else self.sql_columns
        return f"SELECT {', '.join(self.keys)}, {tests} FROM (SELECT {', '.join(('*', *more))} FROM {self.source}) AS t"


LINE = ("l_orderkey", "l_linenumber")
SQL_OPS = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "eq": "=", "neq": "<>"}
STATUS = ("nullif(o_orderstatus, 'F') AS status",)
IP = ("concat('10.', user_id % 4, '.', event_id % 256, '.', user_id % 256) AS ip",)
IP_NUMBER = "(10 * 16777216 + (user_id % 4) * 65536 + (event_id % 256) * 256 + user_id % 256)"
TAGS = ("split(concat_ws(',', event_type, case when user_id % 2 = 0 then 'even' end, case when user_id % 3 = 0 then event_type end), ',') AS tags",)
SQL_TAGS = ("string_split(concat_ws(',', event_type, case when user_id % 2 = 0 then 'even' end, case when user_id % 3 = 0 then event_type end), ',') AS tags",)
GEO = tuple(
    f"cast({e} AS double) AS {n}" for n, e in (("lat", "s_suppkey % 120 - 60"), ("lon", "s_suppkey * 7 % 340 - 170"), ("lat2", "s_suppkey % 120 - 60 + s_suppkey % 11"), ("lon2", "s_suppkey * 7 % 340 - 170 + s_suppkey % 37"))
)
MS = "epoch_ms(ts)"


def _field(name: str, op: str, **more) -> dict:
    return {"field": name, "op": op, **more}


def _distance() -> str:
    flat = "6371.0088 * sqrt(pow(radians(lon2 - lon) * cos(radians(lat + lat2) / 2), 2) + pow(radians(lat2 - lat), 2))"
    h = "pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)"
    return f"(CASE WHEN {flat} <= 1500 THEN {flat} ELSE 2 * 6371.0088 * asin(least(1.0, sqrt({h}))) END)"


def _geo(op: str, km: float) -> dict:
    return {"op": op, "lat_field": "lat", "lon_field": "lon", "other_lat_field": "lat2", "other_lon_field": "lon2", "value": km}


def _sql(text: str) -> dict:
    return {"sql": text}


MASKS: dict[str, Masks] = {
    "num_compare_all": Masks(
        "lineitem", LINE, {op: (_field("l_quantity", op, value=25), f"l_quantity {s} 25") for op, s in SQL_OPS.items()} | {f"int_{op}": (_field("l_linenumber", op, value=3.7), f"l_linenumber {s} 3") for op, s in SQL_OPS.items()}
    ),
    "num_float_narrowing": Masks(
        "lineitem", LINE, {op: (_field("disc", op, value=0.05), f"disc {s} 0.05::REAL") for op, s in SQL_OPS.items()}, ("cast(l_discount AS float) AS disc",)
    ),
    "range_incl_excl": Masks(
        "lineitem",
        LINE,
        {"incl": (_field("l_quantity", "between_including", value=[10, 20]), "l_quantity BETWEEN 10 AND 20"), "excl": (_field("l_quantity", "between_excluding", value=[10, 20]), "l_quantity > 10 AND l_quantity < 20")},
    ),
    "cat_in_not_in": Masks(
        "orders",
        ("o_orderkey",),
        {
            "is_in": (_field("o_orderpriority", "in", values=["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
            "is_not_in": (_field("o_orderpriority", "not_in", values=["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
            "eq": (_field("o_orderstatus", "eq", value="O"), "o_orderstatus = 'O'"),
            "neq": (_field("o_orderstatus", "neq", value="O"), "o_orderstatus <> 'O'"),
        },
    ),
    "null_semantics": Masks(
        "orders",
        ("o_orderkey",),
        {
            "eq": (_field("status", "eq", value="O"), "status = 'O'"),
            "neq": (_field("status", "neq", value="O"), "status <> 'O'"),
            "is_in": (_field("status", "in", values=["O"]), "status IN ('O')"),
            "is_not_in": (_field("status", "not_in", values=["O"]), "status NOT IN ('O')"),
            "null": (_field("status", "is_null"), "status IS NULL"),
            "not_null": (_field("status", "is_not_null"), "status IS NOT NULL"),
            "empty": (_field("status", "is_empty"), "status IS NULL OR status = ''"),
            "not_empty": (_field("status", "is_not_empty"), "status <> ''"),
            "not_contains": ({"not": _field("status", "contains", value="O")}, "status IS NULL OR NOT contains(status, 'O')"),
        },
        STATUS,
    ),
    "not_inversion": Masks(
        "orders",
        ("o_orderkey",),
        {
            "numeric": ({"not": _field("price", "gt", value=100000)}, "price <= 100000"),
            "category": ({"not": _field("status", "in", values=["O"])}, "status NOT IN ('O')"),
            "null": ({"not": _field("status", "is_null")}, "status IS NOT NULL"),
            "cross": ({"not": _field("price", "gt_field", other_field="o_custkey")}, "price <= o_custkey"),
            "range": ({"not": _field("price", "between_including", value=[1000, 100000])}, "price IS NULL OR NOT price BETWEEN 1000 AND 100000"),
            "regex": ({"not": _field("status", "regex", value="[OP]")}, "NOT regexp_matches(status, '[OP]')"),
            "string": ({"not": _field("status", "starts_with", value="O")}, "status IS NULL OR NOT starts_with(status, 'O')"),
            "tree": ({"not": {"and": [_field("status", "eq", value="O"), _field("price", "gt", value=50000)]}}, "NOT (coalesce(status = 'O', false) AND coalesce(price > 50000, false))"),
            "twice": ({"not": {"not": _field("price", "gt", value=100000)}}, "NOT coalesce(price <= 100000, false)"),
            "flags": ({"not": _field("o_custkey", "flags_all", mask=3)}, "(o_custkey & 3) <> 3"),
        },
        (*STATUS, "nullif(o_totalprice, o_totalprice * cast(o_orderkey % 5 = 0 AS int)) AS price"),
        (*STATUS, "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price"),
    ),
    "cross_field": Masks(
        "lineitem",
        LINE,
        {op: (_field("l_tax", f"{op}_field", other_field="l_discount"), f"l_tax {s} l_discount") for op, s in SQL_OPS.items()} | {"text": (_field("l_returnflag", "eq_field", other_field="l_linestatus"), "l_returnflag = l_linestatus")},
    ),
    "flags_ops": Masks(
        "customer",
        ("c_custkey",),
        {
            "any": (_field("c_custkey", "flags_any", mask=3), "(c_custkey & 3) <> 0"),
            "all": (_field("c_custkey", "flags_all", mask="0x3"), "(c_custkey & 3) = 3"),
            "none": (_field("c_custkey", "flags_none", mask=8), "(c_custkey & 8) = 0"),
        },
    ),
    "string_ops": Masks(
        "part",
        ("p_partkey",),
        {
            "contains": (_field("p_type", "contains", value="A"), "contains(p_type, 'A')"),
            "starts": (_field("p_brand", "starts_with", value="Brand#1"), "starts_with(p_brand, 'Brand#1')"),
            "ends": (_field("p_brand", "ends_with", value="3"), "suffix(p_brand, '3')"),
            "ci": (_field("p_brand", "ci_eq", value="bRAND#12"), "lower(p_brand) = 'brand#12'"),
            "length": (_field("p_name", "length_gt", value=8), "strlen(p_name) > 8"),
            "length_lt": (_field("p_name", "length_lt", value=8), "strlen(p_name) < 8"),
            "length_eq": (_field("p_brand", "length_eq", value=8), "strlen(p_brand) = 8"),
        },
    ),
    "string_bytes": Masks("documents", ("doc_id",), {f"over_{n}": (_field("text", "length_gt", value=n), f"strlen(text) > {n}") for n in (500, 2000, 8000)}),
    "regex_ops": Masks(
        "pages",
        ("page_id",),
        {
            "hit": (_field("url", "regex", value=r"^https?://(www|blog)\.[a-z]+\.example\.(com|net)/"), r"regexp_matches(url, '^https?://(www|blog)\.[a-z]+\.example\.(com|net)/')"),
            "miss": (_field("url", "not_regex", value=r"/(en|de)/\d{3}"), r"NOT regexp_matches(url, '/(en|de)/\d{3}')"),
        },
    ),
    "like_sql": Masks(
        "part",
        ("p_partkey",),
        {
            "contains": (_sql("p_type LIKE '%O%'"), "contains(p_type, 'O')"),
            "starts": (_sql("p_brand LIKE 'Brand#2%'"), "starts_with(p_brand, 'Brand#2')"),
            "ends": (_sql("p_brand LIKE '%4'"), "suffix(p_brand, '4')"),
            "folded": (_sql("p_brand ILIKE 'BRAND#3%'"), "starts_with(lower(p_brand), 'brand#3')"),
            "negated": (_sql("p_type NOT LIKE '%O%'"), "NOT contains(p_type, 'O')"),
        },
    ),
    "sql_expr": Masks(
        "lineitem",
        LINE,
        {
            n: (_sql(e), e)
            for n, e in {
                "precedence": "l_quantity > 40 OR l_discount > 0.05 AND l_tax < 0.02",
                "parens": "(l_quantity > 40 OR l_discount > 0.05) AND l_tax < 0.02",
                "between": "l_quantity BETWEEN 5 AND 10 AND NOT l_linenumber = 1",
                "nulls": "l_returnflag IS NOT NULL AND l_returnflag NOT IN ('R', 'N')",
                "numbers": "l_linenumber IN (1, 3, 5)",
            }.items()
        },
    ),
    "arithmetic": Masks(
        "lineitem",
        LINE,
        {
            "unit_price": ({"op": "gt", "expr": {"op": "div", "left": {"op": "mul", "left": "l_extendedprice", "right": {"op": "sub", "left": 1, "right": "l_discount"}}, "right": "l_quantity"}, "value": 1200.5}, "l_extendedprice * (1 - l_discount) / l_quantity > 1200.5"),
            "sum": ({"op": "between_including", "expr": {"op": "add", "left": "l_quantity", "right": "l_linenumber"}, "value": [10, 20]}, "l_quantity + l_linenumber BETWEEN 10 AND 20"),
            "div_zero": ({"op": "neq", "expr": {"op": "div", "left": "l_quantity", "right": {"op": "sub", "left": "l_quantity", "right": "l_quantity"}}, "value": 1}, "false"),
        },
    ),
    "temporal_dow_tod": Masks(
        "events",
        ("event_id",),
        {
            "weekend": (_field("ts", "day_of_week_in", values=[0, 6]), "dayofweek(ts) IN (0, 6)"),
            "office": (_field("ts", "time_of_day_between", value=[9, 17.5]), f"{MS} % 86400000 / 3600000.0 BETWEEN 9 AND 17.5"),
            "night": (_field("ts", "time_of_day_between", value=[22, 4]), f"{MS} % 86400000 / 3600000.0 >= 22 OR {MS} % 86400000 / 3600000.0 <= 4"),
        },
    ),
    "temporal_before_after_within": Masks(
        "events",
        ("event_id",),
        {
            "before": (_field("ts", "before", value=AS_OF_MS), f"{MS} < {AS_OF_MS}"),
            "after": (_field("ts", "after", value=AS_OF_MS), f"{MS} > {AS_OF_MS}"),
            "within": (_field("ts", "within_last", value=5 * DAY), f"{MS} >= {AS_OF_MS - 5 * DAY * 1000}"),
        },
        as_of_ms=AS_OF_MS,
    ),
    "geo_distance": Masks("supplier", ("s_suppkey",), {f"{op[9:]}_{n}": (_geo(op, km), f"{_distance()} {'>' if op.endswith('gt') else '<'} {km}") for op in ("distance_gt", "distance_lt") for n, km in (("near", 777.7), ("far", 2222.2))}, GEO),
    "cidr_match": Masks(
        "events",
        ("event_id",),
        {
            "in16": (_field("ip", "ip_in_subnet", value="10.1.0.0/16"), "user_id % 4 = 1"),
            "out16": (_field("ip", "ip_not_in_subnet", value="10.1.0.0/16"), "user_id % 4 <> 1"),
            "in24": (_field("ip", "in_subnet", value="10.2.7.0/24"), "user_id % 4 = 2 AND event_id % 256 = 7"),
            "single": (_field("ip", "ip_in_subnet", value="10.0.3.4"), f"{IP_NUMBER} = 167772932"),
        },
        IP,
    ),
    "lookup_string": Masks(
        "orders",
        ("o_orderkey",),
        {"hit": (_field("o_orderpriority", "in_lookup", lookup="hot"), "o_orderpriority IN ('1-URGENT', '3-MEDIUM')"), "miss": (_field("o_orderpriority", "not_in_lookup", lookup="hot"), "o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')")},
        lookups=(("hot", "string_set", ("1-URGENT", "3-MEDIUM")),),
    ),
    "lookup_int": Masks(
        "lineitem",
        LINE,
        {"hit": (_field("l_suppkey", "in_lookup", lookup="small"), "l_suppkey BETWEEN 1 AND 30"), "joined": (_field("l_partkey", "in_lookup", lookup="odd"), "l_partkey % 2 = 1 AND l_partkey < 4000"), "joined_miss": (_field("l_partkey", "not_in_lookup", lookup="odd"), "NOT (l_partkey % 2 = 1 AND l_partkey < 4000)")},
        lookups=(("small", "int_set", tuple(range(1, 31))), ("odd", "int_set", tuple(range(1, 4000, 2)))),
    ),
    "lookup_cidr": Masks(
        "events",
        ("event_id",),
        {"hit": (_field("ip", "in_lookup", lookup="vpn"), "user_id % 4 = 1 OR (user_id % 4 = 2 AND event_id % 256 < 64)"), "many": (_field("ip", "not_in_lookup", lookup="many"), "NOT (user_id % 4 = 3 AND event_id % 2 = 0)")},
        IP,
        lookups=(("vpn", "ipv4_cidr_set", ("10.1.0.0/17", "10.1.128.0/17", "10.2.0.0/18")), ("many", "ipv4_cidr_set", tuple(f"10.3.{n}.0/24" for n in range(0, 256, 2)))),
    ),
    "array_ops": Masks(
        "events",
        ("event_id",),
        {
            "any": (_field("tags", "contains_any", values=["even", "error"]), "list_has_any(tags, ['even', 'error'])"),
            "all": (_field("tags", "contains_all", values=["even", "click"]), "list_has_all(tags, ['even', 'click'])"),
            "not_all": ({"not": _field("tags", "contains_all", values=["even", "click"])}, "NOT list_has_all(tags, ['even', 'click'])"),
            "none": (_field("tags", "not_intersects", values=["even", "error"]), "NOT list_has_any(tags, ['even', 'error'])"),
            "longer": (_field("tags", "array_len_gt", value=1), "len(list_distinct(tags)) > 1"),
            "one": (_field("tags", "array_len_eq", value=1), "len(list_distinct(tags)) = 1"),
        },
        TAGS,
        SQL_TAGS,
    ),
}
SLIDING = {
    "window_count": ("count", {}, "gt", (0, 2, 4), "count(*) OVER w"),
    "window_sum": ("sum", {"sum_field": "value"}, "gt", (10.3, 60.7, 200.9), "coalesce(sum(value) OVER w, 0)"),
    "window_avg": ("avg", {"sum_field": "value"}, "gte", (10.3, 40.7), "coalesce(avg(value) OVER w, 0)"),
    "window_ratio": ("ratio", {"numerator_field": "value", "denominator_field": "other"}, "gt", (0.3, 3.7), "CASE WHEN coalesce(sum(other) OVER w, 0) > 0 THEN sum(value) OVER w / sum(other) OVER w ELSE 0 END"),
    "window_min": ("min", {"value_field": "value"}, "lt", (1.3, 9.9), "coalesce(min(value) OVER w, 0)"),
    "window_max": ("max", {"value_field": "value"}, "lte", (1.3, 99.9), "coalesce(max(value) OVER w, 0)"),
}


def _window_rules(name: str) -> dict:
    function, fields, op, limits, _ = SLIDING[name]
    window = {"entity_field": "user_id", "function": function, "duration_seconds": DAY, **fields}
    return {"rules": [{"id": f"t{i}", "conditions": {"window": {**window, "op": op, "value": v}}} for i, v in enumerate(limits)]}


def _window(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "value", "cast(event_id % 7 + 1 AS double) AS other")
        engine = RuleEngine(EngineConfig(output_columns=("event_id",), window_precision="double")).load_rules_from_dict(_window_rules(name))
        return engine.evaluate(events, clock="ts").bitmasks()

    return query


def _window_sql(name: str) -> str:
    _, _, op, limits, value = SLIDING[name]
    tests = ", ".join(f"v {SQL_OPS[op]} {limit} AS rule_t{i}" for i, limit in enumerate(limits))
    return f"""SELECT event_id, {tests} FROM (
        SELECT event_id, {value} AS v FROM (SELECT *, CAST(event_id % 7 + 1 AS DOUBLE) AS other, epoch_ms(ts) // 1000 AS sec FROM events) AS e
        WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN {DAY - 1} PRECEDING AND 1 PRECEDING)) AS s"""


REFERENCE = tuple(round(0.05 * ((i * 7) % 11 - 5), 2) for i in range(64))
VECTORS = {"vector_cosine": ("cosine", "list_cosine_similarity", 0.1234), "vector_l2": ("l2", "list_distance", 2.5), "vector_dot": ("dot", "list_inner_product", 0.15)}


def _vector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    metric, _, limit = VECTORS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        leaf = {"vector_distance": {"dims": "embedding", "reference": list(REFERENCE), "metric": metric, "op": "gt", "value": limit}}
        engine = RuleEngine(EngineConfig(output_columns=("vec_id",))).load_rules_from_dict({"rules": [{"id": "near", "conditions": leaf}, {"id": "far", "conditions": {"not": leaf}}]})
        return engine.evaluate(table(spark, sf_dir, "embeddings")).bitmasks()

    return query


def _vector_sql(name: str) -> str:
    _, function, limit = VECTORS[name]
    value = f"{function}(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {list(REFERENCE)}::DOUBLE[])"
    return f"SELECT vec_id, {value} > {limit} AS rule_near, NOT {value} > {limit} AS rule_far FROM embeddings"


FLAGSHIP = {
    "decisions": {"default": "approve", "precedence": ["approve", "flag", "review", "block"]},
    "rules": [
        {"id": "high_value", "action": "review", "severity": "HIGH", "conditions": _field("l_extendedprice", "gt", value=50000)},
        {"id": "returned", "action": "flag", "weight": 5, "conditions": _field("l_returnflag", "in", values=["R"])},
        {"id": "bulk", "action": "block", "severity": "MEDIUM", "weight": 35, "conditions": {"and": [_field("l_quantity", "gte", value=40), _field("l_discount", "gt", value=0.05)]}},
        {"id": "late_shadow", "action": "block", "shadow": True, "weight": 99, "conditions": _field("l_linenumber", "eq", value=7)},
    ],
}
HIGH, RETURNED, BULK = "l_extendedprice > 50000", "l_returnflag = 'R'", "l_quantity >= 40 AND l_discount > 0.05"
FLAGSHIP_SQL = f"""
    SELECT l_orderkey, l_linenumber, h OR r OR b OR l_linenumber = 7 AS matched,
           CASE WHEN b THEN 'BLOCK' WHEN h THEN 'REVIEW' WHEN r THEN 'FLAG' ELSE 'APPROVE' END AS decision,
           CAST(CASE WHEN h THEN 30 ELSE 0 END + CASE WHEN r THEN 5 ELSE 0 END + CASE WHEN b THEN 35 ELSE 0 END AS DOUBLE) AS score,
           CASE WHEN b THEN 'bulk' WHEN h THEN 'high_value' WHEN r THEN 'returned' ELSE '' END AS winning_rule_id
    FROM (SELECT *, {HIGH} AS h, {RETURNED} AS r, {BULK} AS b FROM lineitem) AS t"""
BAND_SQL = "CASE WHEN decision = 'BLOCK' OR score >= 80 THEN 'HIGH' WHEN decision = 'REVIEW' OR score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band"


def lineitem_rules(spark: SparkSession, sf_dir: str, rules: dict, keys: tuple[str, ...] = LINE) -> Evaluation:
    engine = RuleEngine(EngineConfig(output_columns=keys)).load_rules_from_dict(rules)
    return engine.evaluate(table(spark, sf_dir, "lineitem"))


CAPPED = {
    "rules": [
        {"id": "a", "action": "score", "weight": 30, "conditions": _field("l_quantity", "gt", value=20)},
        {"id": "b", "action": "score", "weight": 30, "score_cap": 50, "conditions": _field("l_discount", "gt", value=0.03)},
        {"id": "c", "action": "score", "weight": 15, "conditions": _field("l_tax", "gt", value=0.04)},
        {"id": "d", "action": "approve", "conditions": _field("l_linenumber", "eq", value=1)},
    ]
}
LABELS = {
    "decisions": {"default": "approve", "precedence": ["approve", "flag", "bot_block", "block"]},
    "rules": [
        {"id": "bot", "action": "block", "label": "bot block", "conditions": _field("l_quantity", "gt", value=45)},
        {"id": "tie_low", "action": "flag", "severity": "LOW", "conditions": _field("l_discount", "gt", value=0.02)},
        {"id": "tie_high", "action": "flag", "severity": "HIGH", "conditions": _field("l_tax", "gt", value=0.03)},
        {"id": "tie_prio", "action": "flag", "severity": "HIGH", "priority": 9, "conditions": _field("l_linenumber", "eq", value=2)},
    ],
}


def decision_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).decisions()


def decision_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).codes()


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).decision_counts()


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).rule_counts()


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).counts()


def score_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, CAPPED).decisions().select(*LINE, "score", "risk_band", "winning_rule_id")


def custom_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, LABELS).decisions().select(*LINE, "decision", "winning_rule_id")


def matched_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).matched_only().select(*LINE, "decision")


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_rules(spark, sf_dir, FLAGSHIP).explanations().select(*LINE, F.array_join("rules", ",").alias("rules"))


def model_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = RuleEngine(EngineConfig(output_columns=LINE))
    engine.register_model("risk", LinearModel((0.05, -12.0), -1.0))
    leaf = {"model_score": {"model": "risk", "features": ["l_quantity", "l_discount"], "op": "gt", "value": 0.5004}}
    return engine.load_rules_from_dict({"rules": [{"id": "risky", "conditions": leaf}]}).evaluate(table(spark, sf_dir, "lineitem")).bitmasks()


def array_any_same_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    both = {"and": [_field("price", "gt", value=40000), _field("flag", "eq", value="R")]}
    rules = [
        {"id": "same", "conditions": {"array_any": {"path": "items", "where": both}}},
        {"id": "sql", "conditions": _sql("any_match(items, x -> x.price > 60000 AND x.flag = 'A') AND o_orderkey > 100")},
        {"id": "none", "conditions": {"not": {"array_any": {"path": "items", "where": both}}}},
    ]
    return RuleEngine(EngineConfig(output_columns=("o_orderkey",))).load_rules_from_dict({"rules": rules}).evaluate(orders).bitmasks()


def backtest_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = RuleEngine().load_rules_from_dict({"rules": [{"id": "a", "conditions": _field("l_quantity", "gt", value=30)}]})
    b = RuleEngine().load_rules_from_dict({"rules": [{"id": "b1", "conditions": _field("l_quantity", "gt", value=35)}, {"id": "b2", "conditions": _field("l_discount", "gt", value=0.07)}]})
    lines = table(spark, sf_dir, "lineitem").withColumn("bad", F.col("l_returnflag") == "R")
    return backtest(lines, a, b, "bad")[0]


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"rules": [{"id": "big", "action": "review", "conditions": _field("value", "gt", value=60)}, {"id": "error", "action": "block", "conditions": _field("event_type", "eq", value="error")}]}
    events = table(spark, sf_dir, "events")
    events = events.withColumn("ts_ms", Schema(events.schema, {}).resolve("ts").column)
    return RuleEngine(EngineConfig(output_columns=("event_id", "ts_ms", "event_type", "value"))).load_rules_from_dict(rules).evaluate(events).decisions()


EVENT_SQL = "(SELECT *, epoch_ms(ts) AS ts_ms, CASE WHEN event_type = 'error' THEN 'BLOCK' WHEN value > 60 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM events) AS e"


def monitor_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.timeline(_event_log(spark, sf_dir), "ts_ms", 3_600_000, "decision")


def monitor_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.facets(_event_log(spark, sf_dir), "decision", "event_type")


def monitor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.counts_by(_event_log(spark, sf_dir), "event_type").select("event_type", "n", "actioned")


def monitor_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.histogram(table(spark, sf_dir, "events"), "value", 24).select("bin", "n")


def monitor_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _event_log(spark, sf_dir)
    fired = log.where("winning_rule_id <> ''").groupBy(F.col("winning_rule_id").alias("rule_id")).agg(F.count("*").alias("fired"), F.count("*").alias("wins"))
    return monitor.top_rules(fired, 10)


def monitor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitor.query(_event_log(spark, sf_dir), decision="REVIEW", rule="bi")
    return monitor.page(found, 20, 10, "event_id").select("event_id", "decision")


def monitor_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def monitor_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return first_per_key(events, ["user_id", "event_type"], ["event_id"])


def ndjson_ingest_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"rules": [{"id": "k", "conditions": _field("k", "gt", value=50)}, {"id": "gone", "conditions": _field("other", "is_null")}]}
    engine = RuleEngine().load_rules_from_dict(rules)
    parsed = parse_json(table(spark, sf_dir, "events").select("event_id", "props"), engine.ruleset, "props", ("event_id",))
    engine.config = EngineConfig(output_columns=("event_id",))
    return engine.evaluate(parsed.good).bitmasks()


def debezium_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    state = F.struct("o_orderkey", "o_orderstatus")
    op = F.when(F.col("o_orderkey") % 3 == 0, "d").when(F.col("o_orderkey") % 3 == 1, "c").otherwise("u")
    event = F.struct(op.alias("op"), F.when(op != "c", state).alias("before"), F.when(op != "d", state).alias("after"))
    flat = unwrap_debezium(orders.select(F.to_json(event).alias("value")))
    kind = "__op string, o_orderkey bigint, o_orderstatus string"
    return flat.select(F.from_json("value", kind).alias("v")).select(F.col("v.__op").alias("op"), "v.o_orderkey", "v.o_orderstatus")


DIRECT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        decision_full, decision_codes, decision_counts, rule_counts, counts, score_cap, custom_label, matched_only, explanations, model_linear,
        array_any_same_element, backtest_ab, monitor_timeline, monitor_facets, monitor_counts, monitor_hist, monitor_top_rules, monitor_page,
        monitor_latest, monitor_medians, dedupe_first, ndjson_ingest_props, debezium_unwrap,
    )
}
DIRECT_SQL = {
    "decision_full": f"SELECT *, {BAND_SQL} FROM ({FLAGSHIP_SQL}) AS d",
    "decision_codes": f"""SELECT l_orderkey, l_linenumber, matched, score,
        CASE decision WHEN 'APPROVE' THEN 0 WHEN 'FLAG' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END AS decision_code,
        CASE winning_rule_id WHEN '' THEN -1 WHEN 'high_value' THEN 0 WHEN 'returned' THEN 1 ELSE 2 END AS winning_rule FROM ({FLAGSHIP_SQL}) AS d""",
    "decision_counts": f"SELECT decision, count(*) AS n, count(*) FILTER (WHERE matched) AS matched, sum(score) AS total_score FROM ({FLAGSHIP_SQL}) AS d GROUP BY decision",
    "rule_counts": f"""SELECT 'high_value' AS rule_id, count(*) AS matches FROM lineitem WHERE {HIGH} UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE {RETURNED}
        UNION ALL SELECT 'bulk', count(*) FROM lineitem WHERE {BULK} UNION ALL SELECT 'late_shadow', count(*) FROM lineitem WHERE l_linenumber = 7""",
    "counts": f"SELECT count(*) AS n_records, count(*) FILTER (WHERE matched) AS n_matched FROM ({FLAGSHIP_SQL}) AS d",
    "score_cap": """
        SELECT l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
               CASE WHEN a THEN 'a' WHEN b THEN 'b' WHEN c THEN 'c' WHEN l_linenumber = 1 THEN 'd' ELSE '' END AS winning_rule_id
        FROM (SELECT *, CASE WHEN b THEN least(CASE WHEN a THEN 30 ELSE 0 END + 30, 50) ELSE CASE WHEN a THEN 30 ELSE 0 END END + CASE WHEN c THEN 15 ELSE 0 END AS score
              FROM (SELECT *, l_quantity > 20 AS a, l_discount > 0.03 AS b, l_tax > 0.04 AS c FROM lineitem) AS t) AS u""",
    "custom_label": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'BOT_BLOCK' WHEN l_linenumber = 2 OR l_tax > 0.03 OR l_discount > 0.02 THEN 'FLAG' ELSE 'APPROVE' END AS decision,
               CASE WHEN l_quantity > 45 THEN 'bot' WHEN l_linenumber = 2 THEN 'tie_prio' WHEN l_tax > 0.03 THEN 'tie_high' WHEN l_discount > 0.02 THEN 'tie_low' ELSE '' END AS winning_rule_id
        FROM lineitem""",
    "matched_only": f"SELECT l_orderkey, l_linenumber, decision FROM ({FLAGSHIP_SQL}) AS d WHERE matched",
    "explanations": f"""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN {HIGH} THEN 'high_value' END, CASE WHEN {RETURNED} THEN 'returned' END,
        CASE WHEN {BULK} THEN 'bulk' END, CASE WHEN l_linenumber = 7 THEN 'late_shadow' END) AS rules FROM lineitem""",
    "model_linear": "SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-(-1.0 + 0.05 * l_quantity + -12.0 * l_discount))) > 0.5004 AS rule_risky FROM lineitem",
    "array_any_same_element": """
        SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > 40000 AND l_returnflag = 'R') AS rule_same,
               o_orderkey > 100 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > 60000 AND l_returnflag = 'A') AS rule_sql,
               NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > 40000 AND l_returnflag = 'R') AS rule_none FROM orders""",
    "backtest_ab": """
        WITH t AS (SELECT l_quantity > 30 AS a, l_quantity > 35 OR l_discount > 0.07 AS b, l_returnflag = 'R' AS y FROM lineitem)
        SELECT count(*) AS total, count(*) FILTER (WHERE a) / count(*) AS fire_rate_a, count(*) FILTER (WHERE b) / count(*) AS fire_rate_b,
               count(*) FILTER (WHERE b AND NOT a) AS new_positives, count(*) FILTER (WHERE a AND NOT b) AS lost, count(*) FILTER (WHERE a = b) / count(*) AS agreement,
               count(*) FILTER (WHERE a AND y) / count(*) FILTER (WHERE a) AS precision_a, count(*) FILTER (WHERE a AND y) / count(*) FILTER (WHERE y) AS recall_a,
               count(*) FILTER (WHERE b AND y) / count(*) FILTER (WHERE b) AS precision_b, count(*) FILTER (WHERE b AND y) / count(*) FILTER (WHERE y) AS recall_b FROM t""",
    "monitor_timeline": f"SELECT ts_ms // 3600000 * 3600000 AS bucket_ms, decision, count(*) AS n FROM {EVENT_SQL} GROUP BY ALL",
    "monitor_facets": f"SELECT 'decision' AS facet, decision AS value, count(*) AS n FROM {EVENT_SQL} GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY ALL",
    "monitor_counts": f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE decision <> 'APPROVE') AS actioned FROM {EVENT_SQL} GROUP BY event_type",
    "monitor_hist": "SELECT CAST(least(floor((value - lo) / ((hi - lo) / 24)), 23) AS INT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) AS r GROUP BY bin",
    "monitor_top_rules": f"SELECT CASE decision WHEN 'BLOCK' THEN 'error' ELSE 'big' END AS rule_id, count(*) AS fired, count(*) AS wins FROM {EVENT_SQL} WHERE decision <> 'APPROVE' GROUP BY rule_id ORDER BY fired DESC LIMIT 10",
    "monitor_page": f"SELECT event_id, decision FROM {EVENT_SQL} WHERE decision = 'REVIEW' ORDER BY ts_ms DESC, event_id LIMIT 20 OFFSET 10",
    "monitor_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "monitor_medians": "SELECT l_returnflag, median(l_quantity) AS median_l_quantity FROM lineitem GROUP BY l_returnflag",
    "dedupe_first": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) AS t WHERE n = 1",
    "ndjson_ingest_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) > 50 AS rule_k, true AS rule_gone FROM events",
    "debezium_unwrap": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END AS op, o_orderkey, o_orderstatus FROM orders",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**MASKS, **{n: _window(n) for n in SLIDING}, **{n: _vector(n) for n in VECTORS}, **DIRECT}


def oracle_sql() -> dict[str, str]:
    return {**{n: m.sql for n, m in MASKS.items()}, **{n: _window_sql(n) for n in SLIDING}, **{n: _vector_sql(n) for n in VECTORS}, **DIRECT_SQL}
