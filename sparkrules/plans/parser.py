"""Rulesets from YAML (or JSON), fail closed: what is not understood is an error, never a guess."""

from __future__ import annotations

import os
import re

import yaml

from ..errors import ParseError
from .spec import (
    ACTIONS,
    ALIASES,
    COMPARE,
    MAX_DEPTH,
    METRICS,
    OPERATORS,
    RANGES,
    SEVERITIES,
    WINDOW_FUNCTIONS,
    All,
    Any,
    ArithmeticLeaf,
    ArrayAny,
    Expr,
    FieldHint,
    Leaf,
    LookupSpec,
    ModelLeaf,
    Not,
    Rule,
    Ruleset,
    VectorLeaf,
    WindowLeaf,
)

#: Type names and their short forms.
TYPES = {
    "float32": "float32", "f32": "float32", "float": "float32",
    "float64": "float64", "f64": "float64", "double": "float64",
    "int32": "int32", "i32": "int32", "integer": "int32",
    "int64": "int64", "i64": "int64", "long": "int64",
    "timestamp_ms": "timestamp_ms", "timestamp": "timestamp_ms", "datetime": "timestamp_ms",
    "boolean": "boolean", "bool": "boolean",
    "string": "string", "text": "string",
    "categorical": "categorical", "category": "categorical", "enum": "categorical",
    "entity_key": "entity_key", "entity": "entity_key", "key": "entity_key",
}
LOOKUP_TYPES = ("string_set", "int_set", "ipv4_cidr_set")
ARITHMETIC = {"add": "add", "+": "add", "sub": "sub", "-": "sub", "mul": "mul", "*": "mul", "div": "div", "/": "div"}


def decision_label(text: str) -> str:
    return re.sub(r"[^A-Z0-9_.\-]", "_", str(text).upper())


class _Conditions:
    """Parses the conditions of one rule."""

    def __init__(self, rule_id: str):
        self.rule_id = rule_id

    def fail(self, message: str, code: str = "UNKNOWN_OP"):
        raise ParseError(code, message, rule_id=self.rule_id)

    def need(self, node: dict, key: str):
        if node.get(key) is None:
            self.fail(f"'{key}' is missing in {node!r}"[:200], "MISSING_REQUIRED_FIELD")
        return node[key]

    def op(self, text) -> str:
        name = str(text).lower()
        name = ALIASES.get(name, name)
        if name not in OPERATORS:
            self.fail(f"unknown operator: '{text}'")
        return name

    def number(self, value) -> float:
        try:
            if isinstance(value, bool | list | dict) or value is None:
                raise ValueError
            return float(value)
        except ValueError:
            self.fail(f"not a number: {value!r}", "TYPE_MISMATCH")

    def pair(self, value) -> tuple[float, float]:
        if not isinstance(value, list) or len(value) != 2:
            self.fail(f"two bounds are needed, not {value!r}", "TYPE_MISMATCH")
        return self.number(value[0]), self.number(value[1])

    def values(self, value) -> list:
        return value if isinstance(value, list) else self.fail(f"a list is needed, not {value!r}", "TYPE_MISMATCH")

    def parse(self, node, depth: int = 0):
        if depth > MAX_DEPTH:
            self.fail(f"conditions are nested too deep (limit {MAX_DEPTH})")
        if not isinstance(node, dict):
            self.fail(f"not a condition: {node!r}"[:200], "MISSING_REQUIRED_FIELD")
        sql = node.get("sql", node.get("expr") if isinstance(node.get("expr"), str) and "op" not in node else None)
        if sql is not None:
            from .sqlexpr import parse_sql

            return parse_sql(str(sql), self.rule_id)
        for key, kind in (("and", All), ("or", Any)):
            if key in node:
                return kind(tuple(self.parse(n, depth + 1) for n in node[key] or ()))
        if "not" in node:
            return Not(self.parse(node["not"], depth + 1))
        for key in ("window", "model_score", "vector_distance", "array_any"):
            if key in node:
                return getattr(self, key)(node, self.values_of(node, key), depth)
        return self.leaf(node)

    def values_of(self, node: dict, key: str) -> dict:
        inner = node[key]
        return inner if isinstance(inner, dict) else self.fail(f"'{key}' is not a mapping", "MISSING_REQUIRED_FIELD")

    def comparison(self, outer: dict, inner: dict, default: str | None = None) -> tuple[str, tuple]:
        """op and value of a derived column; they stand inside or beside it."""
        op = self.op(inner.get("op") or outer.get("op") or default or self.need(inner, "op"))
        value = inner.get("value", outer.get("value"))
        if op in RANGES:
            return op, self.pair(value)
        if op not in COMPARE:
            self.fail(f"'{op}' does not compare a number")
        return op, (self.number(value),)

    def window(self, node: dict, w: dict, depth: int):
        function = str(w.get("function", "count")).lower()
        if function not in WINDOW_FUNCTIONS:
            self.fail(f"unknown window function: '{function}'")
        value = w.get("sum_field") or w.get("value_field") or w.get("numerator_field") or ""
        op, args = self.comparison(node, w)
        seconds = self.need(w, "duration_seconds")
        if not isinstance(seconds, int) or seconds <= 0:
            self.fail(f"duration_seconds: {seconds!r}", "TYPE_MISMATCH")
        return WindowLeaf(str(self.need(w, "entity_field")), function, value, w.get("denominator_field") or "", seconds, op, args)

    def model_score(self, node: dict, m: dict, depth: int):
        op, args = self.comparison(node, m, "gt")
        name = m.get("model") or m.get("name") or self.need(m, "model")
        return ModelLeaf(str(name), tuple(map(str, m.get("features") or ())), int(m.get("output_index", 0)), op, args)

    def vector_distance(self, node: dict, v: dict, depth: int):
        metric = str(v.get("metric", "cosine")).lower()
        if metric not in METRICS:
            self.fail(f"unknown metric: '{metric}'")
        op, args = self.comparison(node, v, "gt")
        dims = self.need(v, "dims")
        dims = (dims,) if isinstance(dims, str) else tuple(map(str, dims))
        return VectorLeaf(dims, tuple(self.number(x) for x in self.need(v, "reference")), METRICS[metric], op, args)

    def array_any(self, node: dict, a: dict, depth: int):
        return ArrayAny(str(self.need(a, "path")), self.parse(self.need(a, "where"), depth + 1))

    def expr(self, node, depth: int = 0) -> Expr:
        if depth > MAX_DEPTH:
            self.fail(f"arithmetic is nested too deep (limit {MAX_DEPTH})")
        if isinstance(node, dict):
            if "field" in node and "op" not in node:
                return Expr("field", (str(node["field"]),))
            if "value" in node and "op" not in node:
                return Expr("literal", (self.number(node["value"]),))
            op = ARITHMETIC.get(str(node.get("op")).lower()) or self.fail(f"unknown arithmetic: {node.get('op')!r}")
            return Expr(op, (self.expr(self.need(node, "left"), depth + 1), self.expr(self.need(node, "right"), depth + 1)))
        try:
            return Expr("literal", (self.number(node),))
        except ParseError:
            return Expr("field", (str(node),))

    def leaf(self, node: dict):
        op = self.op(self.need(node, "op"))
        family = OPERATORS[op].family
        value = node.get("values", node.get("value"))
        if "expr" in node:
            if op not in COMPARE and op not in RANGES:
                self.fail(f"'{op}' does not compare a number")
            other = str(node.get("other_field") or "")
            args = () if other else self.pair(value) if op in RANGES else (self.number(value),)
            return ArithmeticLeaf(self.expr(node["expr"]), op, args, other)
        if family == "geo":
            names = ("lat_field", "lon_field", "other_lat_field", "other_lon_field")
            return Leaf(family, op, tuple(str(self.need(node, n)) for n in names), (self.number(value),))
        name = str(self.need(node, "field"))
        if "other_field" in node and op in COMPARE:
            op, family = f"{op}_field", "cross"
        if family == "cross":
            return Leaf(family, op, (name, str(self.need(node, "other_field"))))
        if family == "null":
            return Leaf(family, op, (name,))
        if family == "lookup":
            return Leaf(family, op, (name,), (str(self.need(node, "lookup")),))
        if family == "flags":
            mask = node.get("mask", value)
            try:
                mask = int(mask, 0) if isinstance(mask, str) else int(mask)
            except (TypeError, ValueError):
                self.fail(f"not a mask: {mask!r}", "TYPE_MISMATCH")
            return Leaf(family, op, (name,), (mask,))
        if value is None:
            self.fail(f"'value' is missing for '{op}'", "MISSING_REQUIRED_FIELD")
        return Leaf(*self.valued(family, op, value, name))

    def valued(self, family: str, op: str, value, name: str) -> tuple:
        match family:
            case "range":
                args = self.pair(value)
            case "member" | "set":
                args = tuple(_text(v) for v in self.values(value))
            case "array_len" | "length":
                args = (int(self.number(value)),)
            case "string" | "cidr":
                args = (_text(value),)
            case "regex":
                args = (check_regex(_text(value), self.rule_id),)
            case "temporal" if op == "day_of_week_in":
                args = tuple(int(self.number(v)) for v in self.values(value))
            case "temporal" if op == "time_of_day_between":
                args = self.pair(value)
            case "temporal":
                args = (int(self.number(value)),)
            case _ if op in ("eq", "neq"):
                # numbers in quotes are numbers too; the column's type decides in the end
                try:
                    return "equal", op, (name,), (self.number(value), _text(value))
                except ParseError:
                    return "equal", op, (name,), (None, _text(value))
            case _:
                args = (self.number(value),)
        return family, op, (name,), args


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def check_regex(pattern: str, rule_id: str = "") -> str:
    """Only what both a linear-time matcher and Java take: no look-around, back-references, possessive or atomic groups."""
    bare = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|(?<!\\)[*+?}]\+", bare):
        raise ParseError("UNKNOWN_OP", f"unsupported regular expression: {pattern!r}", rule_id=rule_id)
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace(r"\z", r"\Z")))
    except re.error as e:
        raise ParseError("UNKNOWN_OP", f"invalid regular expression {pattern!r}: {e}", rule_id=rule_id) from e
    return pattern


def _rule(node: dict, version: str) -> Rule:
    rule_id = str(node.get("id") or "")
    if not rule_id:
        raise ParseError("MISSING_REQUIRED_FIELD", "a rule without id")
    action = str(node.get("action", "flag")).lower()
    if action not in ACTIONS:
        raise ParseError("UNKNOWN_ACTION", f"unknown action: '{node['action']}'", rule_id=rule_id)
    severity = str(node.get("severity", "LOW")).upper()
    if severity not in SEVERITIES:
        raise ParseError("UNKNOWN_SEVERITY", f"unknown severity: '{node['severity']}'", rule_id=rule_id)
    if "conditions" not in node:
        raise ParseError("MISSING_REQUIRED_FIELD", "a rule without conditions", rule_id=rule_id)
    try:
        return Rule(
            id=rule_id,
            condition=_Conditions(rule_id).parse(node["conditions"]),
            name=str(node.get("name", rule_id)),
            version=str(node.get("version", version)),
            priority=int(node.get("priority", 0)),
            weight=float(node.get("weight", 0.0)),
            score_cap=float(node.get("score_cap", 0.0)),
            reason_code=str(node.get("reason_code", rule_id)),
            shadow=bool(node.get("shadow", False)),
            action=action,
            label=decision_label(node.get("label", action)),
            severity=severity,
        )
    except (TypeError, ValueError) as e:
        raise ParseError("TYPE_MISMATCH", str(e), rule_id=rule_id) from e


def _hint(name: str, node: dict) -> FieldHint:
    kind = TYPES.get(str(node["type"]).lower()) if "type" in node else None
    entity = bool(node.get("entity", node.get("is_entity_field", kind == "entity_key")))
    values = tuple(map(_text, node.get("values", node.get("closed_values")) or ()))
    kind = kind or ("entity_key" if entity else "categorical" if values else None)
    return FieldHint(name, kind, node.get("nullable"), entity, values)


def parse_ruleset(root: dict, base_dir: str = ".") -> Ruleset:
    if not isinstance(root, dict):
        raise ParseError("YAML_SYNTAX_ERROR", "the ruleset is not a mapping")
    fields = root.get("fields") or root.get("schema") or {}
    entries = fields.items() if isinstance(fields, dict) else ((f.get("name", ""), f) for f in fields)
    hints = {str(n): _hint(str(n), f or {}) for n, f in entries if n}
    lookups = []
    for name, node in (root.get("lookups") or {}).items():
        if node.get("type") not in LOOKUP_TYPES:
            raise ParseError("TYPE_MISMATCH", f"unknown lookup type of '{name}': {node.get('type')!r}")
        lookups.append(LookupSpec(str(name), node["type"], str(node.get("path", ""))))
    decisions = root.get("decisions") or {}
    default = decision_label(decisions.get("default", "APPROVE"))
    precedence = tuple(decision_label(x) for x in decisions.get("precedence") or ()) or Ruleset.precedence
    if default not in precedence:
        precedence = (default, *precedence)
    inner = root.get("ruleset") or {}
    own = inner or root
    version = str(own.get("version", "1.0.0"))
    rules = [_rule(r, version) for r in (inner.get("rules") or root.get("rules") or ()) if r.get("enabled", True)]
    seen: set[str] = set()
    for r in rules:
        if r.id in seen:
            raise ParseError("DUPLICATE_RULE_ID", f"duplicate rule id: '{r.id}'", rule_id=r.id)
        seen.add(r.id)
    return Ruleset(tuple(rules), str(own.get("name", "ruleset")), version, str(root.get("schema_version", "1.0")), hints, tuple(lookups), default, precedence, base_dir)


def parse_string(text: str, base_dir: str = ".") -> Ruleset:
    try:
        root = yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError) as e:
        raise ParseError("YAML_SYNTAX_ERROR", str(e)[:500]) from e
    return parse_ruleset(root or {}, base_dir)


def parse_file(path: str, read=None) -> Ruleset:
    """read: reads a path as text; by default a local file."""
    try:
        if read is None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        else:
            text = read(path)
    except OSError as e:
        raise ParseError("FILE_IO_ERROR", str(e), source=path) from e
    return parse_string(text, os.path.dirname(path) or ".")
