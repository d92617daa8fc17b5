"""What a ruleset says, as immutable values.

A condition is a tree of All, Any, Not and leaves. One Leaf class carries every operator; OPERATORS says for each operator
which family it is of, and what stands for its negation under ``not``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any as Value
from typing import NamedTuple


class Operator(NamedTuple):
    """family; inverse: the operator that ``not`` turns it into, "guarded" (true negation, null stays false) or "" (complement)."""

    family: str
    inverse: str = ""


def _pairs(family: str, *pairs: str) -> dict[str, Operator]:
    out = {}
    for pair in pairs:
        a, b = pair.split("/")
        out |= {a: Operator(family, b), b: Operator(family, a)}
    return out


OPERATORS: dict[str, Operator] = {
    **_pairs("numeric", "gt/lte", "lt/gte", "eq/neq"),
    **_pairs("null", "is_null/is_not_null", "is_empty/is_not_empty"),
    **_pairs("cross", "gt_field/lte_field", "lt_field/gte_field", "eq_field/neq_field"),
    **_pairs("member", "in/not_in"),
    **_pairs("set", "intersects/not_intersects"),
    **_pairs("flags", "flags_any/flags_none"),
    **_pairs("cidr", "ip_in_subnet/ip_not_in_subnet"),
    **_pairs("regex", "regex/not_regex"),
    **_pairs("lookup", "in_lookup/not_in_lookup"),
    "contains_any": Operator("set", "not_intersects"),
    "contains_all": Operator("set", "guarded"),
    "flags_all": Operator("flags", "guarded"),
    **{op: Operator("range") for op in ("between_including", "between_excluding")},
    **{op: Operator("array_len") for op in ("array_len_gt", "array_len_lt", "array_len_eq")},
    **{op: Operator("string") for op in ("contains", "starts_with", "ends_with", "ci_eq")},
    **{op: Operator("length") for op in ("length_gt", "length_lt", "length_eq")},
    **{op: Operator("temporal") for op in ("before", "after", "within_last", "day_of_week_in", "time_of_day_between")},
    **{op: Operator("geo") for op in ("distance_gt", "distance_lt")},
}
ALIASES = {
    "is_none": "is_null",
    "not_null": "is_not_null",
    "is_not_none": "is_not_null",
    "not_empty": "is_not_empty",
    "in_subnet": "ip_in_subnet",
    "not_in_subnet": "ip_not_in_subnet",
    "geo_distance_gt": "distance_gt",
    "geo_distance_lt": "distance_lt",
}
COMPARE = ("gt", "lt", "gte", "lte", "eq", "neq")
RANGES = ("between_including", "between_excluding")
WINDOW_FUNCTIONS = ("count", "sum", "avg", "ratio", "min", "max")
METRICS = {"cosine": "cosine", "l2": "l2", "euclidean": "l2", "distance": "l2", "dot": "dot", "inner": "dot"}
ACTIONS = ("approve", "score", "flag", "review", "block")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
MAX_DEPTH = 128


@dataclass(frozen=True)
class Expr:
    """Arithmetic: op is add, sub, mul, div, field or literal."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Leaf:
    """args depends on the family; the value is hashable, so equal leaves are one predicate."""

    family: str
    op: str
    fields: tuple[str, ...] = ()
    args: tuple = ()


@dataclass(frozen=True)
class WindowLeaf:
    entity: str
    function: str
    value: str
    denominator: str
    seconds: int
    op: str
    args: tuple
    family: str = "window"

    @property
    def channel(self) -> tuple:
        return (self.entity, self.function, self.value, self.denominator, self.seconds)


@dataclass(frozen=True)
class ModelLeaf:
    model: str
    features: tuple[str, ...]
    output_index: int
    op: str
    args: tuple
    family: str = "model"


@dataclass(frozen=True)
class VectorLeaf:
    dims: tuple[str, ...]
    reference: tuple[float, ...]
    metric: str
    op: str
    args: tuple
    family: str = "vector"


@dataclass(frozen=True)
class ArithmeticLeaf:
    expr: Expr
    op: str
    args: tuple
    other: str = ""
    family: str = "arithmetic"


@dataclass(frozen=True)
class ArrayAny:
    """One element of the array satisfies the whole condition."""

    path: str
    where: Value
    family: str = "array_any"


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Value


@dataclass(frozen=True)
class Rule:
    id: str
    condition: Value
    name: str = ""
    version: str = "1.0.0"
    priority: int = 0
    weight: float = 0.0
    score_cap: float = 0.0
    reason_code: str = ""
    shadow: bool = False
    action: str = "flag"
    label: str = "FLAG"
    severity: str = "LOW"


@dataclass(frozen=True)
class FieldHint:
    name: str
    type: str | None = None
    nullable: bool | None = None
    entity: bool = False
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class LookupSpec:
    name: str
    type: str
    path: str


@dataclass(frozen=True)
class Ruleset:
    rules: tuple[Rule, ...]
    name: str = "ruleset"
    version: str = "1.0.0"
    schema_version: str = "1.0"
    hints: dict[str, FieldHint] = field(default_factory=dict)
    lookups: tuple[LookupSpec, ...] = ()
    default_decision: str = "APPROVE"
    precedence: tuple[str, ...] = ("APPROVE", "SCORE", "FLAG", "REVIEW", "BLOCK")
    base_dir: str = "."


def walk(node):
    """Every leaf below a condition, outside of array elements."""
    if isinstance(node, All | Any):
        for p in node.parts:
            yield from walk(p)
    elif isinstance(node, Not):
        yield from walk(node.part)
    else:
        yield node


def fields_of(leaf) -> tuple[str, ...]:
    """Top-level fields that a leaf reads."""
    match leaf:
        case WindowLeaf():
            return tuple(f for f in (leaf.entity, leaf.value, leaf.denominator) if f)
        case ModelLeaf():
            return leaf.features
        case VectorLeaf():
            return leaf.dims
        case ArithmeticLeaf():
            return tuple(_expr_fields(leaf.expr)) + ((leaf.other,) if leaf.other else ())
        case ArrayAny():
            return (leaf.path,)
    return leaf.fields


def _expr_fields(e: Expr):
    if e.op == "field":
        yield e.args[0]
    elif e.op != "literal":
        for a in e.args:
            yield from _expr_fields(a)
