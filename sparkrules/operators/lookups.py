"""Lookup sets from CSV files, and membership as a broadcast join for sets too large for an expression."""

from __future__ import annotations

import csv
import io
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LookupLoadError
from ..functions.network import cidr_range, ip_number, merge_ranges
from ..functions.predicates import INLINE_RANGES, INLINE_VALUES
from ..plans.binding import Schema
from ..plans.spec import Leaf, LookupSpec

#: A joined set is broadcast up to so many values; a larger one is joined with a shuffle.
BROADCAST_VALUES = 2_000_000


@dataclass(frozen=True)
class Lookup:
    """values: distinct strings or integers, or merged, disjoint ranges of addresses."""

    name: str
    type: str
    values: tuple

    @property
    def inline(self) -> bool:
        return len(self.values) <= (INLINE_RANGES if self.type == "ipv4_cidr_set" else INLINE_VALUES)


def make_lookup(name: str, kind: str, raw: list[str]) -> Lookup:
    try:
        if kind == "int_set":
            return Lookup(name, kind, tuple(sorted({int(v) for v in raw if v.strip()})))
        if kind == "ipv4_cidr_set":
            return Lookup(name, kind, tuple(merge_ranges([cidr_range(v) for v in raw if v.strip()])))
    except ValueError as e:
        raise LookupLoadError("TYPE_MISMATCH", f"lookup '{name}': {e}") from e
    return Lookup(name, kind, tuple(sorted(set(raw))))


def load_lookup(spec: LookupSpec, base_dir: str, read=None) -> Lookup:
    """A CSV file with a header: the column value (or cidr), else the first. Relative paths start at the rules file."""
    path = spec.path if "://" in spec.path or os.path.isabs(spec.path) else os.path.join(base_dir, spec.path)
    try:
        if read:
            text = read(path)
        else:
            with open(path, encoding="utf-8", newline="") as f:
                text = f.read()
    except OSError as e:
        raise LookupLoadError("FILE_IO_ERROR", f"lookup '{spec.name}': {e}", source=path) from e
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        raise LookupLoadError("FILE_IO_ERROR", f"lookup '{spec.name}' has no header", source=path)
    head = [h.strip().lower() for h in rows[0]]
    wanted = "cidr" if spec.type == "ipv4_cidr_set" else "value"
    at = head.index(wanted) if wanted in head else 0
    return make_lookup(spec.name, spec.type, [r[at].strip() for r in rows[1:] if len(r) > at])


def join_lookup(df: DataFrame, schema: Schema, leaf: Leaf, known: Lookup, name: str) -> DataFrame:
    """df with a boolean column that says whether the field's value is in the set; every row stays once."""
    spark: SparkSession = df.sparkSession
    b = schema.resolve(leaf.fields[0])
    small = len(known.values) <= BROADCAST_VALUES
    hint = F.broadcast if small else (lambda d: d)
    if known.type == "ipv4_cidr_set":
        # ranges are disjoint, so each address meets one at most; they are cut at /8 borders for an equality key
        pieces = [(b8, max(lo, b8 << 24), min(hi, (b8 << 24) + (1 << 24) - 1)) for lo, hi in known.values for b8 in range(lo >> 24, (hi >> 24) + 1)]
        right = spark.createDataFrame(pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("__b8", "__lo", "__hi"), zip(*pieces, strict=True), strict=True)}))
        ip = ip_number(b.column) if b.text else b.column.cast("bigint")
        left = df.withColumn("__ip", ip).withColumn("__ip8", F.shiftright("__ip", 24))
        on = (F.col("__ip8") == F.col("__b8")) & F.col("__ip").between(F.col("__lo"), F.col("__hi"))
        return left.join(hint(right), on, "left").withColumn(name, F.col("__b8").isNotNull()).drop("__ip", "__ip8", "__b8", "__lo", "__hi")
    kind = "bigint" if known.type == "int_set" else "string"
    right = spark.createDataFrame(pa.table({"__value": pa.array(known.values, pa.int64() if kind == "bigint" else pa.string())}))
    joined = df.join(hint(right), b.column.cast(kind) == F.col("__value"), "left")
    return joined.withColumn(name, F.col("__value").isNotNull()).drop("__value")
