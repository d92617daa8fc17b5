import json
import random

import pytest
from pyspark.sql import functions as F

from sparkrules import EngineConfig, LookupLoadError, RuleEngine, SchemaError
from sparkrules.functions.network import cidr_range, merge_ranges
from sparkrules.functions.predicates import LOWER, UPPER, key_of
from sparkrules.operators.models import LinearModel
from sparkrules.plans.binding import Schema
from sparkrules.plans.parser import parse_ruleset
from sparkrules.plans.spec import OPERATORS, All, Any, Not, walk
from sparkrules.streaming.state import WindowState

PARCELS = [
    {"id": "oversize", "action": "review", "severity": "MEDIUM", "conditions": {"field": "girth_cm", "op": "gte", "value": 260}},
    {"id": "battery", "action": "flag", "weight": 12.5, "conditions": {"field": "contents", "op": "contains", "value": "battery"}},
    {"id": "unpaid", "action": "block", "severity": "HIGH", "conditions": {"field": "postage", "op": "lt_field", "other_field": "due"}},
]
PARCEL_KIND = "id int, girth_cm double, contents string, postage double, due double"


def engine(*rules, **more) -> RuleEngine:
    return RuleEngine(EngineConfig(**more.pop("config", {}))).load_rules_from_dict({"rules": list(rules), **more})


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("id").collect()]


def masks(spark, df, conditions: dict, **kwargs) -> dict:
    e = RuleEngine(EngineConfig(output_columns=("id",)))
    for name, kind, values in kwargs.pop("lookups", ()):
        e.register_lookup(name, kind, values)
    e.load_rules_from_dict({"rules": [{"id": k, "conditions": c} for k, c in conditions.items()]})
    out = e.evaluate(df, **kwargs).bitmasks().orderBy("id").collect()
    return {k: [r[f"rule_{k}"] for r in out] for k in conditions}


def fold(rules: list[dict], decisions: dict, fired: list[bool]) -> tuple:
    """(matched, decision, winning rule, score, band) of one row, in plain Python by the rules of the survey."""
    severities = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    default = decisions.get("default", "approve").upper()
    order = [x.upper() for x in decisions.get("precedence") or ["approve", "score", "flag", "review", "block"]]
    order = order if default in order else [default, *order]
    total, best, won = 0.0, ((order.index(default)), -1, -(2**31)), None
    for rule, hit in zip(rules, fired, strict=True):
        if not hit or rule.get("shadow"):
            continue
        action, severity = rule.get("action", "flag"), severities.index(rule.get("severity", "LOW"))
        own = rule.get("weight", 0)
        total += own if own or action == "approve" else 10 * (severity + 1)
        if rule.get("score_cap"):
            total = min(total, rule["score_cap"])
        label = rule.get("label", action).upper()
        rank = order.index(label) if label in order else 0
        if not rank and label != default:
            rank = len(order)
        rank = rank or ["approve", "score", "flag", "review", "block"].index(action)
        if (rank, severity, rule.get("priority", 0)) > best:
            best, won = (rank, severity, rule.get("priority", 0)), rule
    decision = won.get("label", won.get("action", "flag")).upper() if won else default
    band = "HIGH" if decision == "BLOCK" or total >= 80 else "MEDIUM" if decision == "REVIEW" or total >= 40 else "LOW"
    return any(fired), decision, won["id"] if won else "", total, band


@pytest.mark.parametrize("seed", range(6))
def test_random_decisions(spark, seed):
    rng = random.Random(seed)
    labels = ["approve", "score", "flag", "review", "block", "hold", "call"]
    own = []
    for i in range(9):
        rule = {"id": f"d{i}", "action": rng.choice(labels[:5]), "severity": rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"]), "priority": rng.randint(-1, 1)}
        rule |= {"weight": rng.choice([0, 2.5, 31])} | ({"label": rng.choice(labels[5:])} if rng.random() < 0.3 else {})
        rule |= {"shadow": rng.random() < 0.2, "score_cap": rng.choice([0, 0, 45])}
        own.append(rule | {"conditions": {"field": f"b{i}", "op": "eq", "value": 1}})
    decisions = {"default": rng.choice(["approve", "flag", "hold"]), "precedence": rng.sample(labels, rng.randint(2, 6))}
    data = [[int(rng.random() < 0.3) for _ in own] for _ in range(40)]
    df = spark.createDataFrame([(n, *d) for n, d in enumerate(data)], "id int, " + ", ".join(f"b{i} int" for i in range(9)))
    found = engine(*own, decisions=decisions).evaluate(df)
    want = [fold(own, decisions, [bool(x) for x in d]) for d in data]
    assert rows(found.decisions(), "matched", "decision", "winning_rule_id", "score", "risk_band") == want
    assert {r.rule_id: r.matches for r in found.rule_counts().collect()} == {r["id"]: sum(d[i] for d in data) for i, r in enumerate(own)}
    assert {r.decision: r.rows for r in found.grouped("id").collect()} == {k: [n for n, w in enumerate(want) if w[1] == k] for k in {w[1] for w in want}}
    some = want[0][1]
    assert found.filter_decision(some, negate=True).count() == sum(w[1] != some for w in want)
    assert [r.id for r in found.matched_only().select("id").orderBy("id").collect()] == [n for n, w in enumerate(want) if w[0]]
    assert tuple(found.counts().first()) == (40, sum(w[0] for w in want))


def test_parcels(spark):
    df = spark.createDataFrame([(0, 300.0, "lamp, battery", 4.0, 4.0), (1, 20.0, None, None, 2.0), (2, 260.0, "sofa", 1.0, 9.5), (3, 80.0, "battery", 3.0, 2.0)], PARCEL_KIND)
    found = engine(*PARCELS).evaluate(df)
    assert rows(found.decisions(), "decision", "score", "risk_band") == [("REVIEW", 32.5, "MEDIUM"), ("APPROVE", 0.0, "LOW"), ("BLOCK", 50.0, "HIGH"), ("FLAG", 12.5, "LOW")]
    assert found.filter_rule("battery").count() == 2


def test_lines_arrays_and_rows_are_decided_alike(spark):
    from sparkrules.sources.ingest import json_array, messages

    rng = random.Random(11)
    parcels = [{"girth_cm": rng.choice([90, 260, 410]), "contents": rng.choice(["battery", "books"]), "postage": rng.randint(0, 3), "due": 2} for _ in range(50)]
    df = spark.createDataFrame([(i, float(p["girth_cm"]), p["contents"], float(p["postage"]), 2.0) for i, p in enumerate(parcels)], PARCEL_KIND)
    want = sorted(map(tuple, engine(*PARCELS).evaluate(df).decision_counts().collect()))
    for lines in (messages(spark, [json.dumps(p) for p in parcels]), json_array(messages(spark, [json.dumps(parcels[:20]), json.dumps(parcels[20:])]))):
        assert sorted(map(tuple, engine(*PARCELS).evaluate_ndjson(lines).decision_counts().collect())) == want


@pytest.mark.parametrize("seed", range(4))
def test_torn_lines(spark, seed):
    """Objects are torn at a random place, or are no objects; json.loads tells which lines are records."""
    from sparkrules.sources.ingest import messages

    rng = random.Random(seed)
    lines = []
    for _ in range(60):
        line = json.dumps({"girth_cm": rng.choice([10, 999.5, "wide", None]), "contents": rng.choice(['quote " and \\\\', "battery \u2603"])})
        lines.append(rng.choice([line, line, line[: rng.randrange(len(line))], json.dumps([line]), "null", "12.5"]))

    def parsed(line):
        try:
            return json.loads(line)
        except ValueError:
            return None

    good = [o for o in map(parsed, lines) if isinstance(o, dict)]
    bad = [x for x in lines if x.strip() and not isinstance(parsed(x), dict)]
    found = engine(*PARCELS[:2]).evaluate_ndjson(messages(spark, lines))
    hits = [(o["girth_cm"] == 999.5) + ("battery" in o["contents"]) for o in good]
    assert tuple(found.counts().first()) == (len(good), sum(h > 0 for h in hits))
    assert sorted(r.value for r in found.rejected.collect()) == sorted(bad)


def test_hard_fail(spark):
    from sparkrules.sources.ingest import messages, parse_json

    ruleset = parse_ruleset({"rules": PARCELS})
    assert parse_json(messages(spark, ['{"postage": 2}']), ruleset, mode="hard_fail").good.count() == 1
    with pytest.raises(Exception, match="MALFORMED_JSON"):
        parse_json(messages(spark, ['{"postage": 2}', "postage=2"]), ruleset, mode="hard_fail").good.collect()


def test_null_like_and_defaults(spark):
    from sparkrules.sources.ingest import messages

    rules = [{"id": "r", "conditions": {"field": "c", "op": "is_null"}}, {"id": "z", "conditions": {"field": "n", "op": "lt", "value": 1}}]
    e = engine(*rules, fields={"n": {"type": "float32", "nullable": False}})
    got = e.evaluate_ndjson(messages(spark, ['{"c":"None"}', '{"c":"x","n":3}', "{}"]))
    assert sorted((r.rule_r, r.rule_z) for r in got.bitmasks().collect()) == [(False, False), (True, True), (True, True)]


def test_score_cap_shadow_and_no_rules(spark):
    df = spark.createDataFrame([(0, 5.0)], "id int, x double")
    yes = {"field": "x", "op": "gt", "value": 1}
    e = engine(
        {"id": "a", "weight": 50, "conditions": yes},
        {"id": "b", "weight": 50, "score_cap": 70, "conditions": yes},
        {"id": "c", "weight": 5, "conditions": yes},
        {"id": "d", "weight": 900, "shadow": True, "action": "block", "conditions": yes},
    ).evaluate(df)
    assert rows(e.decisions(), "score", "decision", "winning_rule_id") == [(75.0, "FLAG", "a")]
    assert e.explanations().first().rules == ["a", "b", "c", "d"]
    assert rows(engine().evaluate(df).decisions(), "decision", "matched") == [("APPROVE", False)]
    assert engine().evaluate(df).rule_counts().count() == 0


def test_float_narrowing_and_nan(spark):
    df = spark.createDataFrame([(0, 0.1, 3), (1, float("nan"), 4), (2, None, None)], "id int, f float, n int")
    got = masks(spark, df, {
        "gt": {"field": "f", "op": "gt", "value": 0.1},
        "eq": {"field": "f", "op": "eq", "value": 0.1},
        "nan": {"field": "f", "op": "gt", "value": -5},
        "cut": {"field": "n", "op": "gt", "value": 3.9},
        "neg": {"not": {"field": "f", "op": "lte", "value": 5}},
        "between": {"field": "f", "op": "between_including", "value": [0, 1e9]},
        "empty_and": {"and": []},
        "empty_or": {"or": []},
    })
    assert got == {
        "gt": [False, False, False], "eq": [True, False, False], "nan": [True, False, False], "cut": [False, True, False],
        "neg": [False, False, False], "between": [True, False, False], "empty_and": [False] * 3, "empty_or": [False] * 3,
    }


def test_text_arrays_network_and_time(spark):
    kind = "id int, s string, tags array<string>, ip string, ms bigint, a struct<b:struct<c:double>>, flags int"
    data = [
        (0, "card payment", ["vip", "vip", "risky"], "10.1.2.3", 1767225600000, ((91.0,),), 3),
        (1, "É", [], "nonsense", 0, ((1.0,),), 8),
        (2, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, kind)
    got = masks(spark, df, {
        "bytes": {"field": "s", "op": "length_eq", "value": 2},
        "ci": {"field": "s", "op": "ci_eq", "value": "CARD PAYMENT"},
        "ci_ascii": {"field": "s", "op": "ci_eq", "value": "é"},
        "any": {"field": "tags", "op": "contains_any", "values": ["risky", "x"]},
        "all": {"field": "tags", "op": "contains_all", "values": ["risky", "vip"]},
        "not_all": {"not": {"field": "tags", "op": "contains_all", "values": ["risky", "x"]}},
        "len": {"field": "tags", "op": "array_len_eq", "value": 2},
        "empty": {"field": "tags", "op": "is_empty"},
        "in_net": {"field": "ip", "op": "ip_in_subnet", "value": "10.0.0.0/8"},
        "out_net": {"field": "ip", "op": "ip_not_in_subnet", "value": "192.168.0.0/16"},
        "thursday": {"field": "ms", "op": "day_of_week_in", "values": [4]},
        "midnight": {"field": "ms", "op": "time_of_day_between", "value": [23, 0]},
        "nested": {"field": "a.b.c", "op": "gt", "value": 50},
        "flags": {"not": {"field": "flags", "op": "flags_all", "mask": 3}},
        "lookup": {"field": "ip", "op": "in_lookup", "lookup": "net"},
        "no_lookup": {"field": "ip", "op": "not_in_lookup", "lookup": "net"},
    }, lookups=[("net", "ipv4_cidr_set", ["10.1.0.0/16"])])
    assert got == {
        "bytes": [False, True, False], "ci": [True, False, False], "ci_ascii": [False, False, False], "any": [True, False, False],
        "all": [True, False, False], "not_all": [True, True, False], "len": [True, False, False], "empty": [False, True, True],
        "in_net": [True, False, False], "out_net": [True, True, False], "thursday": [True, True, False], "midnight": [True, True, False],
        "nested": [True, False, False], "flags": [False, True, False], "lookup": [True, False, False], "no_lookup": [False, True, False],
    }


def test_columns_named_like_paths_and_time_types(spark):
    df = spark.sql("SELECT 0 AS id, 5 AS `a.b`, named_struct('b', 1) AS a, timestamp_ntz'2026-01-01 00:00:00' AS n, timestamp'2026-01-01 00:00:00' AS t")
    same = {"field": "n", "op": "eq_field", "other_field": "t"}
    assert masks(spark, df, {"dot": {"field": "a.b", "op": "eq", "value": 5}, "same": same, "at": {"field": "n", "op": "eq", "value": 1767225600000}}) == {"dot": [True], "same": [True], "at": [True]}


def test_array_any_semantics(spark):
    item = "struct<price:double,category:string,ship:struct<fee:double>>"
    df = spark.createDataFrame([(0, [(150.0, "books", None), (5.0, "electronics", (1.0,))]), (1, [(150.0, "electronics", (9.0,)), None]), (2, None), (3, [])], f"id int, items array<{item}>")
    both = {"and": [{"field": "price", "op": "gt", "value": 100}, {"field": "category", "op": "eq", "value": "electronics"}]}
    got = masks(spark, df, {
        "both": {"array_any": {"path": "items", "where": both}},
        "none": {"not": {"array_any": {"path": "items", "where": both}}},
        "deep": {"sql": "any_match(items, x -> x.ship.fee > 5)"},
        "zero": {"array_any": {"path": "items", "where": {"op": "eq", "expr": {"op": "div", "left": "price", "right": 0}, "value": 0}}},
    })
    assert got == {"both": [False, True, False, False], "none": [True, False, True, True], "deep": [False, True, False, False], "zero": [True, True, False, False]}


def test_schema_errors(spark):
    df = spark.createDataFrame([(0, 1.0, "x")], "id int, amount double, s string")
    for condition, code in (
        ({"field": "missing_amount", "op": "gt", "value": 1}, "UNKNOWN_FIELD_NAME"),
        ({"field": "s", "op": "gt", "value": 1}, "TYPE_MISMATCH"),
        ({"field": "amount", "op": "contains", "value": "x"}, "TYPE_MISMATCH"),
        ({"field": "amount", "op": "eq", "value": "x"}, "TYPE_MISMATCH"),
        ({"window": {"entity_field": "s", "duration_seconds": 5, "op": "gt", "value": 1}}, "MISSING_REQUIRED_FIELD"),
        ({"model_score": {"model": "none", "features": ["amount"], "value": 1}}, "UNKNOWN_FIELD_NAME"),
    ):
        with pytest.raises(SchemaError) as e:
            engine({"id": "r", "conditions": condition}).evaluate(df)
        assert e.value.code == code and e.value.rule_id == "r"


def test_lookup_files(tmp_path, spark):
    """Paths are relative to the rules; a reload that fails keeps the rules as they were, one that succeeds replaces them."""
    import os

    (tmp_path / "lists").mkdir()
    berths = tmp_path / "lists/berths.csv"
    berths.write_text("value\n7\n12\n")
    path = tmp_path / "harbour.yaml"
    rule = {"id": "closed", "action": "review", "conditions": {"not": {"field": "berth", "op": "in_lookup", "lookup": "open"}}}
    text = json.dumps({"lookups": {"open": {"type": "int_set", "path": "lists/berths.csv"}}, "rules": [rule]})
    path.write_text(text)
    e = RuleEngine().load_rules(str(path))
    ships = spark.createDataFrame([(n, n) for n in (7, 8, 12, 13)], "id int, berth int")
    matched = lambda: [r.id for r in e.evaluate(ships).matched_only().select("id").orderBy("id").collect()]
    assert matched() == [8, 13] and not e.reload_if_changed()
    berths.rename(tmp_path / "lists/gone.csv")
    with pytest.raises(LookupLoadError):
        RuleEngine().load_rules(str(path))
    path.write_text(text + "\n")
    os.utime(path, (5, 5))
    assert not e.reload_if_changed() and e.last_error and matched() == [8, 13]
    (tmp_path / "lists/gone.csv").rename(berths)
    berths.write_text("value\n8\n")
    os.utime(path, (9, 9))
    assert e.reload_if_changed() and matched() == [7, 12, 13]


def test_ranges():
    assert cidr_range("10.0.0.0/8") == (10 << 24, (11 << 24) - 1) and cidr_range("1.2.3.4")[0] == cidr_range("1.2.3.4/99")[1]
    assert merge_ranges([(5, 9), (1, 3), (4, 6), (20, 21)]) == [(1, 9), (20, 21)]


SPANS = {"count": {}, "sum": {"sum_field": "kwh"}, "avg": {"sum_field": "kwh"}, "min": {"value_field": "kwh"}, "max": {"value_field": "kwh"}}


def meter_window(function: str, seconds: int, op: str = "gt", value: float = 0) -> dict:
    return {"window": {"entity_field": "meter", "function": function, "duration_seconds": seconds, "op": op, "value": value, **SPANS[function]}}


def reading(function: str, seen: list[float]) -> float:
    """A window's value by a plain loop; without rows 0."""
    if not seen:
        return 0
    return {"count": len(seen), "sum": sum(seen), "avg": sum(seen) / len(seen), "min": min(seen), "max": max(seen)}[function]


@pytest.mark.parametrize("seconds", [1, 2, 7, 60])
def test_windows_against_a_plain_loop(spark, seconds):
    rng = random.Random(seconds)
    data = [(i, rng.choice(["north", "south", "yard", None]), float(rng.randint(1, 8)), rng.choice([0, 1000]) + rng.randint(-30, 30)) for i in range(120)]
    df = spark.createDataFrame(data, "id int, meter string, kwh double, sec bigint")
    tests = {f"{f}_{v}": (f, v) for f in SPANS for v in (0, 3, 9)}
    found = engine(*({"id": k, "conditions": meter_window(f, seconds, "gt", v)} for k, (f, v) in tests.items()), config={"output_columns": ("id",)}).evaluate(df, clock=F.col("sec"))
    for r in found.bitmasks().collect():
        _, meter, _, sec = data[r.id]
        seen = [d[2] for d in data if meter is not None and d[1] == meter and sec - seconds < d[3] < sec]
        for k, (f, v) in tests.items():
            assert r[f"rule_{k}"] == (reading(f, seen) > v), (r.id, k, seen)


def test_a_dense_meter_over_a_day(spark):
    """One meter with a row in each of many seconds; a row sees all before it, or the last day of them."""
    day, n = 86_400, 120_000
    df = spark.range(n).selectExpr("cast(id as int) AS id", "'mast' AS meter", "1.0D AS kwh", "id AS sec")
    found = engine({"id": "full", "conditions": meter_window("count", day, "eq", day - 1)}, {"id": "sum", "conditions": meter_window("sum", day, "eq", 5000)}, config={"output_columns": ("id",)})
    got = found.evaluate(df, clock=F.col("sec")).bitmasks().agg(F.sum(F.col("rule_full").cast("int")), F.min(F.expr("if(rule_full, id, null)")), F.max(F.expr("if(rule_sum, id, null)"))).first()
    assert tuple(got) == (n - day + 1, day - 1, 5000)


def test_window_state_against_a_plain_loop(spark, tmp_path):
    """More batches than are kept apart, some of them run twice."""
    rng = random.Random(3)
    ruleset = parse_ruleset({"rules": [{"id": f, "conditions": meter_window(f, s)} for f, s in (("count", 9), ("sum", 9), ("max", 4))]})
    leaves = {key_of(x): x for r in ruleset.rules for x in walk(r.condition)}
    names = {k: x.function for k, x in leaves.items()}
    state, past, now = WindowState(spark, str(tmp_path / "state")), [], 50
    for n in range(18):
        now += rng.randint(1, 4)
        data = [(i, rng.choice(["north", "south", None]), float(rng.randint(1, 9))) for i in range(rng.randint(1, 4))]
        df = spark.createDataFrame(data, "id int, meter string, kwh double")
        schema = Schema(df.schema, {})
        for _ in range(1 + (n % 6 == 5)):  # a batch that runs again sees and leaves the same
            for r in state.read(df, schema, leaves, names, n, now).collect():
                for x in leaves.values():
                    seen = [k for s, m, k in past if r.meter is not None and m == r.meter and s > now - x.seconds]
                    assert r[x.function] == reading(x.function, seen), (n, r, x.function)
            state.write(df, schema, leaves, n, now)
        past += [(now, m, k) for _, m, k in data]
    assert state.active_entities() in (1, 2)
    state.reset()
    assert state.active_entities() == 0


def test_models_and_vectors(spark):
    df = spark.createDataFrame([(0, 0.1, 0.2, [1.0, 0.0]), (1, 9.0, None, [0.0, 0.0]), (2, 3.0, 4.0, None)], "id int, a double, b double, v array<float>")
    e = engine(
        {"id": "m", "conditions": {"model_score": {"model": "lin", "features": ["a", "b"], "op": "gt", "value": 0.5}}},
        {"id": "cos", "conditions": {"vector_distance": {"dims": ["a", "b"], "reference": [3, 4], "op": "gt", "value": 0.99}}},
        {"id": "arr", "conditions": {"vector_distance": {"dims": "v", "reference": [1, 0], "metric": "l2", "op": "lt", "value": 0.5}}},
    )
    e.register_model("lin", LinearModel((1.0, 1.0), -1.0))
    got = e.evaluate(df).bitmasks().orderBy("id").collect()
    assert [(r.rule_m, r.rule_cos, r.rule_arr) for r in got] == [(False, False, True), (False, False, False), (True, True, False)]


# --- random trees against a row-at-a-time evaluator -------------------------------------------------------------------

FIELDS = ("x", "y", "s")


def random_leaf(rng):
    kind = rng.choice(["num", "range", "text", "member", "cross", "null"])
    if kind == "num":
        return {"field": rng.choice("xy"), "op": rng.choice(["gt", "lt", "gte", "lte", "eq", "neq"]), "value": rng.randint(-2, 2)}
    if kind == "range":
        return {"field": rng.choice("xy"), "op": rng.choice(["between_including", "between_excluding"]), "value": sorted(rng.sample(range(-3, 4), 2))}
    if kind == "text":
        return {"field": "s", "op": rng.choice(["contains", "starts_with", "ends_with", "ci_eq"]), "value": rng.choice(["a", "B", "ab"])}
    if kind == "member":
        return {"field": "s", "op": rng.choice(["in", "not_in"]), "values": rng.sample(["a", "B", "ab", ""], 2)}
    if kind == "cross":
        return {"field": "x", "op": rng.choice(["gt_field", "lt_field", "eq_field", "neq_field", "gte_field", "lte_field"]), "other_field": "y"}
    return {"field": rng.choice(FIELDS), "op": rng.choice(["is_null", "is_not_null"])}


def random_tree(rng, depth=3):
    kind = rng.choice(["leaf", "and", "or", "not"]) if depth else "leaf"
    if kind == "leaf":
        return random_leaf(rng)
    if kind == "not":
        return {"not": random_tree(rng, depth - 1)}
    return {kind: [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]}


def holds(node, row) -> bool:
    if isinstance(node, All):
        return bool(node.parts) and all(holds(p, row) for p in node.parts)
    if isinstance(node, Any):
        return any(holds(p, row) for p in node.parts)
    if isinstance(node, Not):
        inner = node.part
        if not isinstance(inner, All | Any | Not) and OPERATORS[inner.op].inverse:
            return leaf_holds(inner, row, OPERATORS[inner.op].inverse)
        return not holds(inner, row)
    return leaf_holds(node, row, node.op)


def leaf_holds(leaf, row, op) -> bool:
    v = row[leaf.fields[0]]
    if op in ("is_null", "is_not_null"):
        return (v is None) == (op == "is_null")
    if v is None:
        return False
    if op.endswith("_field"):
        other, op = row[leaf.fields[1]], op.removesuffix("_field")
        if other is None:
            return False
    elif op in ("in", "not_in"):
        return (v in leaf.args) == (op == "in")
    elif leaf.family == "range":
        lo, hi = leaf.args
        return lo <= v <= hi if op == "between_including" else lo < v < hi
    elif leaf.family == "string":
        a = leaf.args[0]
        fold = str.maketrans(UPPER, LOWER)
        return {"contains": a in v, "starts_with": v.startswith(a), "ends_with": v.endswith(a), "ci_eq": v.translate(fold) == a.translate(fold)}[op]
    else:
        other = leaf.args[0]
    return {"gt": v > other, "lt": v < other, "gte": v >= other, "lte": v <= other, "eq": v == other, "neq": v != other}[op]


def test_random_trees(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, -2, -1, 0, 1, 2]), rng.choice([None, float("nan"), -1.5, 0.0, 1.0, 2.0]), rng.choice([None, "", "a", "B", "ab", "AB", "cab"])) for i in range(60)]
    df = spark.createDataFrame(data, "id int, x int, y double, s string")
    trees = {f"t{i}": random_tree(rng) for i in range(40)}
    got = masks(spark, df, trees)
    parsed = parse_ruleset({"rules": [{"id": k, "conditions": t} for k, t in trees.items()]})
    for rule in parsed.rules:
        want = [holds(rule.condition, dict(zip(FIELDS, d[1:], strict=True))) for d in data]
        assert got[rule.id] == want, trees[rule.id]


def test_observed_counters(spark):
    df = spark.createDataFrame([(0, 10.0, "seeds", 2.0, 2.0), (1, 262.0, "battery", 1.0, 3.0)], PARCEL_KIND)
    out, seen = engine(*PARCELS).evaluate(df).observed("parcels")
    assert out.count() == 2
    got = seen.get
    assert (got["records"], got["matched"], got["score_max"], got["decision_BLOCK"], got["decision_APPROVE"]) == (2, 1, 62.5, 1, 1)


def test_rules_from_a_path_that_spark_reads(spark, tmp_path):
    (tmp_path / "l.csv").write_text("value\nM1\n")
    rule = {"id": "r", "conditions": {"field": "m", "op": "in_lookup", "lookup": "x"}}
    (tmp_path / "r.yaml").write_text(json.dumps({"lookups": {"x": {"type": "string_set", "path": "l.csv"}}, "rules": [rule]}))
    df = spark.createDataFrame([("M1",), ("M2",)], "m string")
    assert RuleEngine().load_rules(f"file://{tmp_path}/r.yaml", spark).evaluate(df).counts().first().n_matched == 1
