import json
import random

import pytest

from sparkrules import ParseError, RuleEngine
from sparkrules.plans.parser import check_regex, parse_string
from sparkrules.plans.spec import All, Any, ArrayAny, Leaf, Not, WindowLeaf
from sparkrules.plans.sqlexpr import parse_sql


def rules(condition, **more) -> str:
    return json.dumps({"rules": [{"id": "r", "conditions": condition, **more}]})


def code(text: str) -> str:
    with pytest.raises(ParseError) as e:
        parse_string(text)
    return e.value.code


AMOUNT = {"field": "amount", "op": "gt", "value": 100}


PLAIN = [("salinity", "gte", 3.5, "numeric"), ("buoy", "ci_eq", "Skerry", "string"), ("depth_m", "between_excluding", [2, 9], "range"), ("crew", "array_len_lt", 4, "array_len")]


def drawn(rng, depth: int) -> tuple[dict, object]:
    """A condition as it is written, and its outline: (kind, outlines of the parts), or the leaf's operator and field."""
    kind = rng.choice(["and", "or", "not", "leaf", "window"]) if depth else "leaf"
    if kind == "window":
        seconds = rng.randrange(1, 10**6)
        return {"window": {"entity_field": "buoy", "function": "max", "value_field": "swell", "duration_seconds": seconds, "op": "lte", "value": 1.25}}, ("window", "max", seconds)
    if kind == "leaf":
        field, op, value, _ = rng.choice(PLAIN)
        return {"field": field, "op": op, "value": value}, (op, field)
    if kind == "not":
        written, outline = drawn(rng, depth - 1)
        return {"not": written}, ("not", [outline])
    parts = [drawn(rng, depth - 1) for _ in range(rng.randint(1, 4))]
    return {kind: [w for w, _ in parts]}, (kind, [o for _, o in parts])


def outline_of(node):
    if isinstance(node, Not):
        return "not", [outline_of(node.part)]
    if isinstance(node, All | Any):
        return ("and" if isinstance(node, All) else "or"), [outline_of(p) for p in node.parts]
    return ("window", node.function, node.seconds) if isinstance(node, WindowLeaf) else (node.op, node.fields[0])


@pytest.mark.parametrize("seed", range(30))
def test_trees_keep_their_shape(seed):
    written, outline = drawn(random.Random(seed), 4)
    assert outline_of(parse_string(rules(written)).rules[0].condition) == outline


@pytest.mark.parametrize("field, op, value, family", PLAIN)
def test_a_misspelt_operator_is_refused_wherever_it_stands(field, op, value, family):
    assert parse_string(rules({"field": field, "op": op, "value": value})).rules[0].condition.family == family
    wrong = {"field": field, "op": op + "_", "value": value}
    fine = {"field": "salinity", "op": "lt", "value": 40}
    for place in (wrong, {"not": wrong}, {"or": [fine, wrong]}, {"and": [{"not": {"or": [fine, {"and": [wrong]}]}}]}, {"array_any": {"path": "nets", "where": wrong}}):
        assert code(rules(place)) == "UNKNOWN_OP"


@pytest.mark.parametrize("action", ["flag", "block", "score", "review", "approve"])
def test_known_actions(action):
    assert parse_string(rules(AMOUNT, action=action)).rules[0].label == action.upper()


@pytest.mark.parametrize(
    "wrong, expected",
    [
        (rules(AMOUNT, action="escalate"), "UNKNOWN_ACTION"),
        (rules(AMOUNT, severity="mild"), "UNKNOWN_SEVERITY"),
        (rules({"field": "depth_m", "op": "between_excluding", "value": [2]}), "TYPE_MISMATCH"),
        (rules({"window": {"entity_field": "buoy", "function": "median", "duration_seconds": 60, "op": "lt", "value": 2}}), "UNKNOWN_OP"),
        (rules({"vector_distance": {"dims": ["lat", "lon"], "reference": [54, 8], "metric": "chebyshev", "value": 3}}), "UNKNOWN_OP"),
        (rules({"sql": "depth_m <=> 3"}), "UNKNOWN_OP"),
        ("ruleset: {name: [tide", "YAML_SYNTAX_ERROR"),
        (json.dumps({"lookups": {"ports": {"type": "bloom", "path": "ports.csv"}}}), "TYPE_MISMATCH"),
        (json.dumps({"rules": [{"id": i, "conditions": AMOUNT} for i in ("ebb", "flow", "ebb")]}), "DUPLICATE_RULE_ID"),
    ],
)
def test_refused_rulesets(wrong, expected):
    assert code(wrong) == expected


def test_depth_limits():
    deep = AMOUNT
    for _ in range(150):
        deep = {"and": [deep]}
    assert code(rules(deep)) in ("UNKNOWN_OP", "YAML_SYNTAX_ERROR")
    with pytest.raises(ParseError, match="deep"):
        parse_sql("(" * 300 + "a > 1" + ")" * 300)


@pytest.mark.parametrize(
    "sql, spelled",
    [
        ("salinity >= 3.5", {"field": "salinity", "op": "gte", "value": 3.5}),
        ("buoy IS NULL", {"field": "buoy", "op": "is_null"}),
        ("salinity < 9 OR buoy IS NOT NULL", {"or": [{"field": "salinity", "op": "lt", "value": 9}, {"field": "buoy", "op": "is_not_null"}]}),
    ],
)
def test_sql_means_the_same_as_the_spelled_tree(sql, spelled):
    for around in (lambda c: c, lambda c: {"not": c}, lambda c: {"or": [AMOUNT, {"and": [c, AMOUNT]}]}):
        a, b = (parse_string(rules(around(c))).rules[0].condition for c in ({"sql": sql}, spelled))
        assert outline_of(a) == outline_of(b)


def test_sql_trees():
    assert parse_sql("a > 1 OR b < 2 AND NOT c = 'x'") == Any((Leaf("numeric", "gt", ("a",), (1.0,)), All((Leaf("numeric", "lt", ("b",), (2.0,)), Not(Leaf("equal", "eq", ("c",), (None, "x")))))))
    assert parse_sql("a.b IS NOT NULL") == Leaf("null", "is_not_null", ("a.b",))
    assert parse_sql("a NOT IN (1, 'b', c)") == Leaf("member", "not_in", ("a",), ("1", "b", "c"))
    assert parse_sql("a LIKE 'x%'").op == "starts_with" and parse_sql("a LIKE '%x'").op == "ends_with"
    assert parse_sql("a LIKE '%x%'").op == parse_sql("a LIKE 'x'").op == "contains"
    assert isinstance(parse_sql("any_match(items, x -> x.price > 3) AND b = 1").parts[0], ArrayAny)
    assert parse_sql("any_match(items, x -> x.price > 3)").where.fields == ("price",)
    for bad in ("a >", "a > 1 b", "a IN ()", "(a > 1", "a BETWEEN 1", "> 3", "a > 'x'"):
        with pytest.raises(ParseError):
            parse_sql(bad)


def test_regex_dialect():
    assert check_regex("card.*payment")
    for bad in ("(?=x)", r"(a)\1", "a++", "(", "(?<!x)y"):
        with pytest.raises(ParseError):
            check_regex(bad)


def test_hints_disabled_rules_and_labels():
    text = json.dumps({
        "fields": {"card": {"type": "entity"}, "kind": {"values": ["a", "b"]}, "t": {"type": "timestamp", "nullable": False}},
        "decisions": {"default": "ok", "precedence": ["flag"]},
        "ruleset": {"name": "n", "version": 2, "rules": [{"id": "off", "enabled": False, "conditions": AMOUNT}, {"id": "on", "label": "bot block!", "conditions": AMOUNT}]},
    })
    r = parse_string(text)
    assert [x.id for x in r.rules] == ["on"] and r.rules[0].label == "BOT_BLOCK_" and r.version == "2"
    assert r.precedence == ("OK", "FLAG") and r.hints["card"].entity and r.hints["kind"].type == "categorical"
    assert r.hints["t"].type == "timestamp_ms" and r.hints["t"].nullable is False


def test_conflicts():
    def one(name, condition):
        return {"id": name, "conditions": condition}

    found = RuleEngine().load_rules_from_dict({
        "rules": [
            one("big", {"field": "a", "op": "gt", "value": 100}),
            one("bigger", {"field": "a", "op": "gt", "value": 200}),
            one("small", {"field": "a", "op": "lt", "value": 50}),
            one("dead", {"and": [{"field": "b", "op": "gt", "value": 5}, {"field": "b", "op": "lt", "value": 5}]}),
            one("us", {"field": "c", "op": "in", "values": ["US"]}),
            one("gb", {"field": "c", "op": "eq", "value": "GB"}),
        ]
    }).analyze_conflicts()
    assert [(f.first, f.second) for f in found.of("CONFLICT")] == [("big", "small"), ("bigger", "small"), ("us", "gb")]
    assert [(f.first, f.second) for f in found.of("SUBSUMES")] == [("big", "bigger")]
    assert [f.first for f in found.of("DEAD")] == ["dead"]
