"""Sliding-window state between micro-batches: a log of (channel operands, entity, second) buckets.

A batch reads the state that earlier batches have left, is evaluated, and then adds its own buckets, so rows of one batch never see
each other. A batch writes its buckets only (``d=<number>``); every COMPACT batches all buckets that a window can still reach
become one table (``b=<number>``). A batch that is run again reads the same earlier state and writes the same tables, so
retries change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import NULL_VALUE, finish, operand
from ..plans.binding import Schema
from ..plans.spec import WindowLeaf

#: So many batches are added before the log is made one table.
COMPACT = 16
KIND = "slot string, entity string, sec bigint, n bigint, s double, d double, lo double, hi double"


class WindowState:
    def __init__(self, spark: SparkSession, path: str, null_value: float = NULL_VALUE):
        self.spark, self.path, self.null_value = spark, path.rstrip("/"), null_value
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _numbers(self, kind: str) -> list[int]:
        """Of committed tables, in order."""
        if not self._fs.exists(self._jvm_path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jvm_path(self.path))]
        done = [n for n in names if n.startswith(f"{kind}=") and self._fs.exists(self._jvm_path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def versions(self) -> list[int]:
        """Batches whose buckets are there."""
        return sorted({*self._numbers("b"), *self._numbers("d")})

    def _base(self, batch: int) -> int:
        """The newest table of all buckets that is older than this batch, or -1."""
        return max((b for b in self._numbers("b") if b < batch), default=-1)

    def before(self, batch: int) -> DataFrame:
        """The buckets that batches before this one have left."""
        base = self._base(batch)
        paths = [f"{self.path}/b={base}"] if base >= 0 else []
        paths += [f"{self.path}/d={d}" for d in self._numbers("d") if base < d < batch]
        return self.spark.read.schema(KIND).parquet(*paths) if paths else self.spark.createDataFrame([], KIND)

    def reset(self) -> None:
        self._fs.delete(self._jvm_path(self.path), True)

    def active_entities(self) -> int:
        own = self.versions()
        return self.before(own[-1] + 1).select("entity").distinct().count() if own else 0

    @staticmethod
    def slot(w: WindowLeaf) -> str:
        return "\x1f".join((w.entity, w.value, w.denominator))

    def read(self, df: DataFrame, schema: Schema, leaves: dict[tuple, WindowLeaf], names: dict[tuple, str], batch: int, now: int, precision: str = "float") -> DataFrame:
        """df with each channel's value over the buckets of seconds in (now - duration, now]."""
        longest = max(w.seconds for w in leaves.values())
        state = self.before(batch).where((F.col("sec") <= now) & (F.col("sec") > now - longest))
        for n, entity in enumerate(sorted({w.entity for w in leaves.values()})):
            own = {k: w for k, w in leaves.items() if w.entity == entity}
            aggs = []
            for k, w in own.items():
                live = (F.col("slot") == self.slot(w)) & (F.col("sec") > now - w.seconds)
                part = lambda c, live=live: F.when(live, F.col(c))
                value = finish(w.function, F.sum(part("n")), F.sum(part("s")), F.sum(part("d")), F.min(part("lo")), F.max(part("hi")), precision)
                aggs.append(value.alias(names[k]))
            key = schema.resolve(entity).column.cast("string")
            # only entities of this batch
            here = df.select(key.alias("entity")).distinct()
            known = state.where(F.col("slot").isin([self.slot(w) for w in own.values()])).join(here, "entity", "left_semi")
            seen = known.groupBy(F.col("entity").alias(f"__e{n}")).agg(*aggs)
            df = df.join(seen, key == F.col(f"__e{n}"), "left").drop(f"__e{n}")
            df = df.withColumns({names[k]: F.coalesce(F.col(names[k]), F.lit(0).cast("int" if w.function == "count" else precision)) for k, w in own.items()})
        return df

    def write(self, df: DataFrame, schema: Schema, leaves: dict[tuple, WindowLeaf], batch: int, now: int) -> None:
        """Adds the batch's buckets at second ``now``; buckets that no window can reach any more go when the log is made one table."""
        slots = {self.slot(w): w for w in leaves.values()}
        parts = []
        for s, w in slots.items():
            key = schema.resolve(w.entity).column.cast("string")
            v, d = operand(schema, w.value, self.null_value), operand(schema, w.denominator, self.null_value)
            parts.append(df.select(F.lit(s).alias("slot"), key.alias("entity"), F.lit(now).cast("bigint").alias("sec"), F.lit(1).cast("bigint").alias("n"), v.alias("s"), d.alias("d"), v.alias("lo"), v.alias("hi")).where("entity is not null"))
        if not parts:
            return
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        self._summed(out).write.mode("overwrite").parquet(f"{self.path}/d={batch}")
        base = self._base(batch)
        if sum(base < d <= batch for d in self._numbers("d")) >= COMPACT:
            longest = {s: max(w.seconds for w in leaves.values() if self.slot(w) == s) for s in slots}
            live = F.lit(False)
            for s, seconds in longest.items():
                live = live | ((F.col("slot") == s) & (F.col("sec") > now - seconds))
            self._summed(self.before(batch + 1).where(live)).write.mode("overwrite").parquet(f"{self.path}/b={batch}")
            # what this batch read stays, in case it runs again
            for kind, keep in (("d", base), ("b", base - 1)):
                for old in [v for v in self._numbers(kind) if v <= keep]:
                    self._fs.delete(self._jvm_path(f"{self.path}/{kind}={old}"), True)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("slot", "entity", "sec").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
