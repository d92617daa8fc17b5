"""URL filtering by a sort-merge range join, with DataFrame functions only.

A rule is a host and a path prefix. The canonical key of a rule is its host with the labels reversed, a separator and its
path, so that everything below the rule is one interval of keys, and the intervals of rules on one host nest. A url is
looked up under its host and each parent domain. The rules' interval ends are break points in key order; each carries
the rule on top of the stack of rules that are open there: at a rule's begin the rule itself, at its end the rule that it is
nested in. Break points and url keys are sorted together and swept once: the last break point at or before a key has
the longest rule that covers it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Between host and path; sorts below every character of a path.
SEP = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """rules: (verdict, host, path). Hosts are lower-cased; of equal (host, path) the last one counts."""
    last = {(h.translate(str.maketrans(UPPER, LOWER)), p): v for v, h, p in rules}
    rows = [{"host": h, "path": p, "verdict": v} for (h, p), v in last.items()]
    packed = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<host:string,path:string,verdict:string>>")).alias("r")
    )
    return packed.select("r.*")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def break_points(rules: DataFrame) -> DataFrame:
    """key (binary), rule (struct or null): what is on top of the stack from this key on."""
    keyed = rules.withColumn("key", F.concat(_reversed(F.col("host")), F.lit(SEP), F.col("path")))
    top = F.struct(
        F.length(F.concat("host", "path")).alias("len"),
        F.length("host").alias("host_len"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    keyed = keyed.select("key", "path", top.alias("top"))
    shorter = keyed.where(F.length("path") > 0).select(
        F.col("key").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"), "path"
    )
    shorter = shorter.select(
        "inner", F.expr("substring(inner, 1, length(inner) - length(path) + n)").alias("key")
    )
    parents = (
        shorter.join(keyed.select("key", "top"), "key")
        .groupBy(F.col("inner").alias("key"))
        .agg(F.max("top").alias("outer_top"))
    )
    begin = keyed.select(F.encode("key", "UTF-8").alias("key"), "top")
    end = keyed.join(parents, "key", "left").select(
        F.concat(F.encode("key", "UTF-8"), F.expr("X'FF'")).alias("key"), F.col("outer_top").alias("top")
    )
    return begin.union(end)


def apply_rules(
    df: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", rows_per_task: int = 200_000, run_rules: int = 50_000
) -> DataFrame:
    """All columns of df with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule (columns host, path, verdict) fits its host and all subdomains if the url's path begins with the rule's; a rule
    with an empty host fits every host. Of the rules that fit, the longest (host and path together, then host) wins.
    Without one, rule is null and the verdict is ``default``. Null urls and urls without :// have an empty host and path.
    Repeated rows stay; an empty df or empty rules give a whole, defined result.

    Urls are dealt to tasks by a hash, so a host that a third of them share is spread; each task sweeps its own urls against
    the break points of a run of rules. A run is ``run_rules`` rules, chosen by key range; all break points of a run go to each of
    its tasks.
    """
    spark = df.sparkSession
    n_urls, n_rules = df.count(), rules.count()
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_urls // rows_per_task))
    points = break_points(rules)
    runs = max(1, -(-2 * n_rules // run_rules))
    starts = _run_starts(points, runs) if runs > 1 else []

    def run_of(key: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(b) for b in starts]), lambda b: b <= key)) if starts else F.lit(0)

    points = points.select("key", "top", run_of(F.col("key")).alias("run"), F.lit(0).alias("is_url"))
    if starts:
        points = points.union(_carried(spark, points, starts))
    points = points.select("run", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "is_url", "top")

    own = {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    urls = df.withColumns(own).withColumns({"__row": F.monotonically_increasing_id(), "verdict": F.lit(None).cast("string"), "rule": F.lit(None).cast("string")})
    keep = F.struct(*[f"`{c}`" for c in urls.columns if c not in ("__row", "rule", "verdict")])
    labels = F.reverse(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    suffixes = F.array_distinct(F.concat(F.array(F.lit("")), parents))
    keys = urls.select("__row", keep.alias("__keep"), "path", F.explode(suffixes).alias("__suffix"))
    keys = keys.withColumn("key", F.encode(F.concat("__suffix", F.lit(SEP), "path"), "UTF-8"))
    # the row's own columns travel once, with the root look-up
    keys = keys.select(
        run_of(F.col("key")).alias("run"),
        F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int").alias("salt"),
        "key",
        F.lit(1).alias("is_url"),
        "__row",
        F.when(F.col("__suffix") == "", F.col("__keep")).alias("__keep"),
    )
    both = keys.unionByName(points, allowMissingColumns=True)
    sweep = W.partitionBy("run", "salt").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a break point's null top is a state of its own, so the state is wrapped
    state = F.last(F.when(F.col("is_url") < 1, F.struct(F.col("top").alias("top"))), ignorenulls=True).over(sweep)
    swept = both.withColumn("state", state).where("is_url = 1").select("__row", "__keep", F.col("state.top").alias("top"))
    best = swept.groupBy("__row").agg(F.first("__keep", ignorenulls=True).alias("__keep"), F.max("top").alias("top"))
    return best.select(
        "__keep.*",
        F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )


def _run_starts(points: DataFrame, runs: int) -> list[bytearray]:
    """Keys that cut the break points into about equal runs; at most runs - 1 of them come to the driver."""
    ranged = points.select("key").repartitionByRange(runs, "key").withColumn("p", F.spark_partition_id())
    firsts = ranged.groupBy("p").agg(F.min("key").alias("key")).orderBy("key").collect()
    return [r["key"] for r in firsts[1:]]


def _carried(spark: SparkSession, points: DataFrame, starts: list[bytearray]) -> DataFrame:
    """For each run after the first a break point at its start, before all others: the state in which the runs before it end."""
    ends = points.groupBy("run").agg(F.max(F.struct("key", F.struct("top").alias("state"))).alias("end"))
    runs = spark.range(0, len(starts) + 1).select(F.col("id").cast("int").alias("run")).join(ends, "run", "left")
    before = F.last("end", ignorenulls=True).over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    key = F.element_at(F.array(*[F.lit(b) for b in starts]), F.col("run"))
    carried = runs.withColumn("end", before).where("run > 0 and end is not null")
    return carried.select(key.alias("key"), F.col("end.state.top").alias("top"), "run", F.lit(-1).alias("is_url"))
