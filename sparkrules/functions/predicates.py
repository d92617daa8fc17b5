"""Leaves of conditions as boolean Columns that are never null: a null operand makes a leaf false."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..plans.binding import Bound
from ..plans.spec import OPERATORS, All, Any, ArithmeticLeaf, ArrayAny, Expr, Leaf, ModelLeaf, Not, VectorLeaf, WindowLeaf
from .geo import distance_km
from .network import cidr_range, ip_number

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many values, a lookup is an IN list or a chain of ranges; larger ones are joined (operators.lookups).
INLINE_VALUES, INLINE_RANGES = 1000, 64
DAY_MS, HOUR_MS = 86_400_000, 3_600_000.0


#: Set while a condition is compiled for a filter, which takes null for false: bare comparisons reach the scan.
_FILTER: ContextVar[bool] = ContextVar("filter", default=False)


def certain(c: Column) -> Column:
    return c if _FILTER.get() else F.coalesce(c, F.lit(False))


@contextmanager
def for_filter(on: bool):
    token = _FILTER.set(on)
    try:
        yield
    finally:
        _FILTER.reset(token)


@dataclass
class Scope:
    """What leaves are compiled against."""

    resolve: Callable[[str], Bound]
    rule_id: str = ""
    as_of_ms: int = 0
    #: Columns that an earlier stage has made: of window, model and vector leaves and of joined lookups.
    derived: dict = field(default_factory=dict)
    lookups: dict = field(default_factory=dict)
    #: Inside an array element: not is a plain complement, arithmetic takes null and x/0 as 0, a null text is empty for regex.
    nested: bool = False
    #: Of window columns other than counts.
    window_precision: str = "float"

    def mismatch(self, op: str, b: Bound):
        raise SchemaError("TYPE_MISMATCH", f"'{op}' does not apply to '{b.name}' ({b.type.simpleString()})", rule_id=self.rule_id, field=b.name)

    def want(self, name: str, op: str, *kinds: str) -> Bound:
        b = self.resolve(name)
        if not any(getattr(b, k) for k in kinds):
            self.mismatch(op, b)
        return b


def threshold(value: float, kind: T.DataType) -> Column:
    """A number as a literal of the column's own type: integers are cut, floats rounded, out-of-range values clamped."""
    if isinstance(kind, T.FloatType):
        return F.lit(float(np.float32(value))).cast("float")
    if isinstance(kind, T.DoubleType):
        return F.lit(float(value))
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
    return F.lit(max(-(1 << (bits - 1)), min((1 << (bits - 1)) - 1, int(value)))).cast(kind)


def compare(op: str, c: Column, v: Column, floating: bool = False) -> Column:
    match op:
        case "gt":
            out = c > v
        case "gte":
            out = c >= v
        case "lt":
            out = c < v
        case "lte":
            out = c <= v
        case "eq":
            out = c == v
        case _:
            out = c != v
    # Spark sorts NaN above every number; a comparison with NaN is false, but for inequality
    return out & ~F.isnan(c) if floating and op in ("gt", "gte") else out


def number_test(op: str, b: Bound, args: tuple) -> Column:
    """A comparison or range over a numeric column."""
    if op in ("between_including", "between_excluding"):
        low, high = (threshold(a, b.type) for a in args)
        inside = (b.column >= low) & (b.column <= high) if op == "between_including" else (b.column > low) & (b.column < high)
        return certain(inside & ~F.isnan(b.column) if b.floating else inside)
    return certain(compare(op, b.column, threshold(args[0], b.type), b.floating))


def _equal(leaf: Leaf, s: Scope) -> Column:
    b, (value, text) = s.resolve(leaf.fields[0]), leaf.args
    if b.numeric:
        return number_test(leaf.op, b, (value,)) if value is not None else s.mismatch(leaf.op, b)
    return _member(Leaf("member", "in" if leaf.op == "eq" else "not_in", leaf.fields, (text,)), s)


def _member(leaf: Leaf, s: Scope) -> Column:
    b = s.resolve(leaf.fields[0])
    if b.array:
        values = F.array(*[F.lit(v) for v in leaf.args]).cast(b.type)
        hit = F.arrays_overlap(F.array_compact(b.column), values)
    elif b.numeric:
        try:
            numbers = [float(v) for v in leaf.args]
        except ValueError:
            s.mismatch(leaf.op, b)
        hit = b.column.isin([threshold(n, b.type) for n in numbers])
    else:
        text = b.column if b.text else b.column.cast("string")
        hit = text.isin(list(leaf.args))
    return certain(~hit if leaf.op == "not_in" else hit)


def _set(leaf: Leaf, s: Scope) -> Column:
    b = s.want(leaf.fields[0], leaf.op, "array", "text")
    if not b.array:
        if leaf.op == "contains_all":
            return certain(b.column == leaf.args[0]) if len(set(leaf.args)) == 1 else F.lit(not leaf.args) & b.column.isNotNull()
        hit = b.column.isin(list(leaf.args))
        return certain(~hit if leaf.op == "not_intersects" else hit)
    values, own = F.array(*[F.lit(v) for v in leaf.args]).cast(b.type), F.array_compact(b.column)
    if leaf.op == "contains_all":
        return certain(F.size(F.array_except(values, own)) == 0)
    hit = F.arrays_overlap(own, values)
    return certain(~hit if leaf.op == "not_intersects" else hit)


def _null(leaf: Leaf, s: Scope) -> Column:
    b = s.resolve(leaf.fields[0])
    match leaf.op:
        case "is_null":
            return b.column.isNull()
        case "is_not_null":
            return b.column.isNotNull()
    size = F.size(b.column) if b.array else F.octet_length(s.want(b.name, leaf.op, "text").column)
    return b.column.isNull() | (size == 0) if leaf.op == "is_empty" else certain(size > 0)


def _array_len(leaf: Leaf, s: Scope) -> Column:
    b = s.want(leaf.fields[0], leaf.op, "array", "text")
    size = F.size(F.array_distinct(F.array_compact(b.column))) if b.array else F.octet_length(b.column)
    return certain(b.column.isNotNull() & compare(leaf.op.rpartition("_")[2], size, F.lit(leaf.args[0])))


def _cross(leaf: Leaf, s: Scope) -> Column:
    a, b, op = s.resolve(leaf.fields[0]), s.resolve(leaf.fields[1]), leaf.op.removesuffix("_field")
    if a.numeric and b.numeric:
        x, y = a.column.cast("double"), b.column.cast("double")
        out = compare(op, x, y)
        if op not in ("eq", "neq"):
            out = out & ~F.isnan(x) & ~F.isnan(y)
        elif a.floating or b.floating:  # NaN differs from everything, itself included
            nan = F.isnan(x) | F.isnan(y)
            out = out & ~nan if op == "eq" else out | nan
        return certain(out)
    if op not in ("eq", "neq") or a.numeric or b.numeric:
        s.mismatch(leaf.op, b if a.numeric else a)
    return certain(compare(op, a.column, b.column))


def _flags(leaf: Leaf, s: Scope) -> Column:
    c = s.want(leaf.fields[0], leaf.op, "numeric").column.cast("bigint")
    mask = leaf.args[0]
    mask = F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint")
    both = c.bitwiseAND(mask)
    return certain(both == mask if leaf.op == "flags_all" else both != 0 if leaf.op == "flags_any" else both == 0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _string(leaf: Leaf, s: Scope) -> Column:
    c, value = s.want(leaf.fields[0], leaf.op, "text").column, leaf.args[0]
    op = leaf.op
    if op.startswith("i_"):
        op, c, value = op[2:], F.lower(c), value.lower()
    match op:
        case "contains":
            return certain(c.contains(value))
        case "starts_with":
            return certain(c.startswith(value))
        case "ends_with":
            return certain(c.endswith(value))
    return certain(ascii_lower(c) == value.translate(str.maketrans(UPPER, LOWER)))


def _length(leaf: Leaf, s: Scope) -> Column:
    c = s.want(leaf.fields[0], leaf.op, "text").column
    return certain(compare(leaf.op.removeprefix("length_"), F.octet_length(c), F.lit(leaf.args[0])))


def _regex(leaf: Leaf, s: Scope) -> Column:
    c = s.want(leaf.fields[0], leaf.op, "text").column
    hit = (F.coalesce(c, F.lit("")) if s.nested else c).rlike(leaf.args[0])
    return certain(~hit if leaf.op == "not_regex" else hit)


def _ip(s: Scope, name: str, op: str) -> Column:
    b = s.want(name, op, "text", "integer")
    return ip_number(b.column) if b.text else b.column.cast("bigint")


def _cidr(leaf: Leaf, s: Scope) -> Column:
    try:
        low, high = cidr_range(leaf.args[0])
    except ValueError as e:
        raise SchemaError("TYPE_MISMATCH", str(e), rule_id=s.rule_id, field=leaf.fields[0]) from e
    hit = _ip(s, leaf.fields[0], leaf.op).between(low, high)
    return certain(~hit if leaf.op == "ip_not_in_subnet" else hit)


def _temporal(leaf: Leaf, s: Scope) -> Column:
    b = s.want(leaf.fields[0], leaf.op, "numeric")
    ms = b.column.cast("bigint")
    match leaf.op:
        case "before":
            return certain(ms < leaf.args[0])
        case "after":
            return certain(ms > leaf.args[0])
        case "within_last":
            return certain(ms >= s.as_of_ms - leaf.args[0] * 1000)
        case "day_of_week_in":  # the first of January 1970 was a Thursday, day 4; a day's last half millisecond belongs to it
            days = ms / DAY_MS if b.micros is None else b.micros / (DAY_MS * 1000)
            day = F.pmod(F.floor(days) + 4, F.lit(7))
            return certain(day.isin(list(leaf.args))) if leaf.args else F.lit(False)
    low, high = leaf.args
    hour = F.pmod(ms, F.lit(DAY_MS)) / HOUR_MS
    return certain((hour >= low) & (hour <= high) if low <= high else (hour >= low) | (hour <= high))


def _geo(leaf: Leaf, s: Scope) -> Column:
    d = distance_km(*(s.want(f, leaf.op, "numeric").column for f in leaf.fields))
    return certain(d > leaf.args[0] if leaf.op == "distance_gt" else d < leaf.args[0])


def _lookup(leaf: Leaf, s: Scope) -> Column:
    known = s.lookups[leaf.args[0]]
    negated = leaf.op == "not_in_lookup"
    if (joined := s.derived.get(("lookup", leaf.fields[0], leaf.args[0]))) is not None:
        return certain(~joined & s.resolve(leaf.fields[0]).column.isNotNull() if negated else joined)
    if known.type == "ipv4_cidr_set":
        ip = _ip(s, leaf.fields[0], leaf.op)
        hit = reduce(or_, (ip.between(a, b) for a, b in known.values), F.lit(False))
        hit = hit & ip.isNotNull()
        return certain(~hit & ip.isNotNull() if negated else hit)
    b = s.want(leaf.fields[0], leaf.op, "integer" if known.type == "int_set" else "text")
    hit = b.column.isin(list(known.values)) if known.values else F.lit(False)
    return certain(~hit & b.column.isNotNull() if negated else hit)


def arithmetic(e: Expr, s: Scope) -> Column:
    """In double; null, or x/0, is null; in array elements 0."""
    if e.op == "literal":
        return F.lit(float(e.args[0]))
    if e.op == "field":
        c = s.want(e.args[0], "expr", "numeric").column.cast("double")
        return F.coalesce(c, F.lit(0.0)) if s.nested else c
    a, b = (arithmetic(x, s) for x in e.args)
    match e.op:
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
    out = F.try_divide(a, b)
    return F.coalesce(out, F.lit(0.0)) if s.nested else out


def _arithmetic(leaf: ArithmeticLeaf, s: Scope) -> Column:
    value = Bound("expr", arithmetic(leaf.expr, s), T.DoubleType())
    if leaf.other:
        other = s.want(leaf.other, leaf.op, "numeric").column.cast("double")
        return certain(compare(leaf.op, value.column, other, True))
    return number_test(leaf.op, value, leaf.args)


def _derived(leaf, s: Scope) -> Column:
    if s.nested:
        return F.lit(False)
    kind = T.FloatType()
    if isinstance(leaf, WindowLeaf):
        kind = T.IntegerType() if leaf.function == "count" else T.DoubleType() if s.window_precision == "double" else kind
    return number_test(leaf.op, Bound(leaf.family, s.derived[key_of(leaf)], kind), leaf.args)


def key_of(leaf) -> tuple:
    """What a derived column depends on; leaves that differ in the comparison only share it."""
    match leaf:
        case WindowLeaf():
            return ("window", *leaf.channel)
        case ModelLeaf():
            return ("model", leaf.model, leaf.features, leaf.output_index)
    return ("vector", leaf.dims, leaf.reference, leaf.metric)


def _array_any(leaf: ArrayAny, s: Scope) -> Column:
    if s.nested:
        return F.lit(False)
    b = s.resolve(leaf.path)
    if not b.array or not isinstance(b.type.elementType, T.StructType):
        s.mismatch("array_any", b)
    return certain(F.exists(b.column, lambda x: x.isNotNull() & compile_condition(leaf.where, _element(x, b, s))))


def _element(x: Column, b: Bound, s: Scope) -> Scope:
    from ..plans.binding import type_at

    def resolve(name: str) -> Bound:
        kind = type_at(b.type.elementType, name)
        if kind is None:
            raise SchemaError("UNKNOWN_FIELD_NAME", f"unknown field in '{b.name}': '{name}'", rule_id=s.rule_id, field=name)
        return Bound(name, reduce(lambda c, p: c[p], name.split("."), x), kind)

    return Scope(resolve, s.rule_id, s.as_of_ms, {}, s.lookups, nested=True)


LEAVES = {
    "numeric": lambda leaf, s: number_test(leaf.op, s.want(leaf.fields[0], leaf.op, "numeric"), leaf.args),
    "range": lambda leaf, s: number_test(leaf.op, s.want(leaf.fields[0], leaf.op, "numeric"), leaf.args),
    "equal": _equal, "member": _member, "set": _set, "null": _null, "array_len": _array_len, "cross": _cross,
    "flags": _flags, "string": _string, "length": _length, "regex": _regex, "cidr": _cidr, "temporal": _temporal,
    "geo": _geo, "lookup": _lookup, "arithmetic": _arithmetic, "window": _derived, "model": _derived,
    "vector": _derived, "array_any": _array_any,
}


def negated(leaf, s: Scope):
    """``not`` over a leaf: the inverse operator where there is one, so that null stays false; else None."""
    from dataclasses import replace

    if s.nested:
        return None
    if isinstance(leaf, WindowLeaf):
        return replace(leaf, op=OPERATORS[leaf.op].inverse) if OPERATORS[leaf.op].inverse else None
    if not isinstance(leaf, Leaf):
        return None
    inverse = OPERATORS[leaf.op].inverse if leaf.op in OPERATORS else ""
    return replace(leaf, op=inverse) if inverse and inverse != "guarded" else None


def compile_leaf(leaf, s: Scope) -> Column:
    return LEAVES[leaf.family](leaf, s)


def compile_condition(node, s: Scope, leaf_column: Callable | None = None) -> Column:
    """A whole tree; leaf_column may give the columns of leaves that an earlier stage has computed."""
    column = leaf_column or (lambda leaf: compile_leaf(leaf, s))
    if isinstance(node, All | Any):
        parts = [compile_condition(p, s, leaf_column) for p in node.parts]
        return reduce(and_ if isinstance(node, All) else or_, parts) if parts else F.lit(False)
    if isinstance(node, Not):
        inner = node.part
        if isinstance(inner, All | Any | Not):
            with for_filter(False):
                return ~compile_condition(inner, s, leaf_column)
        if (other := negated(inner, s)) is not None:
            return column(other)
        with for_filter(False):
            out = ~column(inner)
        if isinstance(inner, Leaf) and inner.op in OPERATORS and OPERATORS[inner.op].inverse == "guarded" and not s.nested:
            out = out & s.resolve(inner.fields[0]).column.isNotNull()
        return out
    return column(node)
