"""Sliding-window aggregates per entity over earlier micro-batches.

In batch mode every second of a clock column is one micro-batch: a row sees what its entity did in the ``seconds`` seconds before
its own second, never its own second. Rows are summed up to (entity, second) before anything is shuffled for the
window, so an entity that a third of all rows share costs its task no more than one row a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.binding import Schema
from ..plans.spec import WindowLeaf

#: A null operand counts as this.
NULL_VALUE = 1.0
#: A window of no more rows is summed row by row, oldest first, as DuckDB does; of more rows DuckDB adds partial sums in an order not followed here.
FEW = 16


def operand(schema: Schema, name: str, null_value: float = NULL_VALUE) -> Column:
    return F.coalesce(schema.resolve(name).column.cast("double"), F.lit(null_value)) if name else F.lit(1.0)


def finish(function: str, n: Column, total: Column, other: Column, low: Column, high: Column, precision: str = "float") -> Column:
    """The window's value from its sums; without any row 0, never null."""
    zero = F.lit(0.0)
    match function:
        case "count":
            return F.coalesce(n, F.lit(0)).cast("int")
        case "sum":
            out = total
        case "avg":
            out = F.try_divide(total, n.cast("double"))
        case "ratio":
            out = F.when(other > 0, total / other)
        case "min":
            out = low
        case _:
            out = high
    return F.coalesce(out, zero).cast(precision)


def _terms(n: Column, total: Column, low: Column, high: Column) -> Column:
    """What a bucket adds to a sum, one by one: its rows if they are equal or two, else their sum."""
    return F.when((low == high) & (n <= FEW), F.array_repeat(low, n.cast("int"))).when(n == 2, F.array(low, high)).otherwise(F.array(total))


def _combined(c: dict[str, str]) -> dict[str, Column]:
    """How partial sums are combined: aggregate functions by column name."""
    how = {"n": F.sum, "s": F.sum, "d": F.sum, "lo": F.min, "hi": F.max, "terms": F.collect_list}
    return {name: how[kind](name) for name, kind in c.items()}


def _sliding(buckets: DataFrame, kinds: dict[str, str], seconds: int) -> DataFrame:
    """(__entity, __sec) and the columns of ``kinds`` over the seconds [sec - seconds + 1, sec - 1], for every bucket.

    Time is cut into blocks of ``seconds``. Such a span is the end of one block and the beginning of the next, so it is a
    running result from the right and one from the left: two passes, whatever ``seconds`` is, no subtraction, and a
    dense entity is spread over its blocks. "terms" are the lists that sums of few rows are made of.
    """
    block = F.floor(F.col("__sec") / seconds).cast("bigint")
    own = W.partitionBy("__entity", "__block").orderBy("__sec")
    left = own.rowsBetween(W.unboundedPreceding, -1)
    falling = W.partitionBy("__entity", "__block").orderBy(F.desc("__sec"))
    right = falling.rowsBetween(W.unboundedPreceding, W.currentRow)
    aggs = _combined(kinds)
    last, first = own.rowsBetween(-FEW, -1), falling.rowsBetween(1 - FEW, W.currentRow)
    lefts = [(F.flatten(c.over(last)) if kinds[k] == "terms" else c.over(left)).alias(k) for k, c in aggs.items()]
    rights = [(F.flatten(F.reverse(c.over(first))) if kinds[k] == "terms" else c.over(right)).alias(k) for k, c in aggs.items()]
    both = buckets.withColumn("__block", block).select(
        "__entity",
        "__sec",
        "__block",
        F.struct(*lefts).alias("__left"),
        F.struct(*rights).alias("__right"),
    )
    ask = both.select("__entity", "__block", "__sec", F.lit(0).alias("__tells"), "__left", F.lit(None).cast(both.schema["__right"].dataType).alias("__right"))
    # what begins at second s of a block is inside the spans of the next block's seconds up to s + seconds - 1
    tell = both.select("__entity", F.col("__block") + 1, F.col("__sec") + (seconds - 1), F.lit(1), F.lit(None).cast(both.schema["__left"].dataType), "__right")
    back = W.partitionBy("__entity", "__block").orderBy(F.desc("__sec"), F.desc("__tells")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = ask.union(tell).withColumn("__right", F.last("__right", ignorenulls=True).over(back)).where("__tells = 0")
    out, zero = [], F.lit(0).cast("bigint")
    n = F.coalesce("__left.__n", zero) + F.coalesce("__right.__n", zero)
    for name, kind in kinds.items():
        if kind == "terms":
            continue
        a, b = F.col(f"__left.{name}"), F.col(f"__right.{name}")
        join = {"lo": F.least(a, b), "hi": F.greatest(a, b)}
        both_parts = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if kind in ("s", "d"):
            parts = [F.coalesce(f"{side}.{name}_terms", F.array().cast("array<double>")) for side in ("__right", "__left")]
            both_parts = F.when(n.between(1, FEW), F.aggregate(F.concat(*parts), F.lit(0.0), lambda t, x: t + x)).otherwise(both_parts)
        out.append(join.get(kind, both_parts).alias(name))
    return met.select("__entity", "__sec", *out)


def add_windows(df: DataFrame, schema: Schema, leaves: dict[tuple, WindowLeaf], clock: Column, names: dict[tuple, str], null_value: float = NULL_VALUE, precision: str = "float") -> DataFrame:
    """df with a column for each channel; clock: epoch seconds of the row's micro-batch.

    Channels of one entity and one duration share a pass over the entity's buckets; each entity is joined to the rows once.
    """
    df = df.withColumn("__sec", clock)
    for n, entity in enumerate(sorted({w.entity for w in leaves.values()})):
        own = {k: w for k, w in leaves.items() if w.entity == entity}
        key = schema.resolve(entity).column.cast("string")
        operands = sorted({(w.value, w.denominator) for w in own.values()})
        sums: dict[str, Column] = {"__n": F.count("*")}
        for i, (value, other) in enumerate(operands):
            v, d = operand(schema, value, null_value), operand(schema, other, null_value)
            sums |= {f"__s{i}": F.sum(v), f"__d{i}": F.sum(d), f"__lo{i}": F.min(v), f"__hi{i}": F.max(v), f"__dlo{i}": F.min(d), f"__dhi{i}": F.max(d)}
        keyed = df.withColumn("__entity", key)
        buckets = keyed.where("__entity is not null and __sec is not null").groupBy("__entity", "__sec").agg(*[c.alias(k) for k, c in sums.items()])
        for i in range(len(operands)):
            of = {"s": ("lo", "hi"), "d": ("dlo", "dhi")}
            buckets = buckets.withColumns({f"__{k}{i}_terms": _terms(F.col("__n"), F.col(f"__{k}{i}"), F.col(f"__{a}{i}"), F.col(f"__{b}{i}")) for k, (a, b) in of.items()})
        seen = None
        for seconds in sorted({w.seconds for w in own.values()}):
            of_span = {k: w for k, w in own.items() if w.seconds == seconds}
            needed = {"__n": "n"}
            for w in of_span.values():
                i = operands.index((w.value, w.denominator))
                used = {"count": (), "sum": ("s",), "avg": ("s",), "ratio": ("s", "d"), "min": ("lo",)}.get(w.function, ("hi",))
                needed |= {f"__{kind}{i}": kind for kind in used} | {f"__{kind}{i}_terms": "terms" for kind in used if kind in ("s", "d")}
            found = _sliding(buckets.select("__entity", "__sec", *needed), needed, seconds)
            values = []
            for k, w in of_span.items():
                i = operands.index((w.value, w.denominator))
                part = lambda kind, i=i, needed=needed: F.col(f"__{kind}{i}") if f"__{kind}{i}" in needed else F.lit(None)
                values.append(finish(w.function, F.col("__n"), part("s"), part("d"), part("lo"), part("hi"), precision).alias(names[k]))
            found = found.select(F.col("__entity").alias(f"__e{n}"), F.col("__sec").alias(f"__t{n}"), *values)
            seen = found if seen is None else seen.join(found, [f"__e{n}", f"__t{n}"])
        df = keyed.join(seen, (F.col("__entity") == F.col(f"__e{n}")) & (F.col("__sec") == F.col(f"__t{n}")), "left").drop("__entity", f"__e{n}", f"__t{n}")
        zero = {names[k]: F.coalesce(F.col(names[k]), F.lit(0).cast("int" if w.function == "count" else precision)) for k, w in own.items()}
        df = df.withColumns(zero)
    return df.drop("__sec")
