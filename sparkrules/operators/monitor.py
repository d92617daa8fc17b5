"""Aggregates over decision logs: counts, facets, histograms, rule tables and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.binding import divided
from .dedupe import comparable

#: The bucket of a timeline by the span that it shows (milliseconds).
SPANS = ((3_600_000, 1_000), (3 * 86_400_000, 60_000))
LONG_BUCKET = 3_600_000


def counts_by(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, actioned, avg_score); actioned: decisions other than APPROVE."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("decision") != "APPROVE").alias("actioned"), F.avg("score").alias("avg_score"))


def query(log: DataFrame, decision: str = "", risk: str = "", instance: str = "", rule: str = "", since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Rows of the log that fit all filters; rule is a part of the winning rule's id."""
    tests: list[Column] = []
    tests += [F.col("decision") == decision] if decision else []
    tests += [F.col("risk_band") == risk] if risk else []
    tests += [F.col("instance") == instance] if instance else []
    tests += [F.col("winning_rule_id").contains(rule)] if rule else []
    tests += [F.col("ts_ms") >= since_ms] if since_ms is not None else []
    tests += [F.col("ts_ms") < until_ms] if until_ms is not None else []
    for t in tests:
        log = log.where(t)
    return log


def page(log: DataFrame, limit: int = 50, offset: int = 0, *ties: str) -> DataFrame:
    """One page, newest first."""
    return log.orderBy(F.desc("ts_ms"), *ties).offset(offset).limit(limit)


def facets(log: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return log.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """(bin, n, low, high): equal widths between the least and the largest value; NaN and null are left out, empty bins not listed."""
    x = F.col(value).cast("double")
    own = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high = own.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return own.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"), F.col("x").alias("low"), F.col("x").alias("high")).limit(0)
    width = (high - low) / bins
    at = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    return own.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumns({"low": F.lit(low) + F.col("bin") * width, "high": F.lit(low) + (F.col("bin") + 1) * width})


def top_rules(fired: DataFrame, k: int, rule: str = "rule_id", wins: str = "wins", times: str = "fired") -> DataFrame:
    """The k rules that fired most; more wins, then the smaller id, come first among equals."""
    return fired.orderBy(F.desc(times), F.desc(wins), rule).limit(k)


def bucket_ms(span_ms: int) -> int:
    return next((size for most, size in SPANS if span_ms <= most), LONG_BUCKET)


def timeline(log: DataFrame, ts_ms: str = "ts_ms", bucket: int = 60_000, *keys: str) -> DataFrame:
    """(bucket_ms, keys, n): tumbling buckets by integer arithmetic."""
    begin = divided(F.col(ts_ms).cast("bigint"), bucket) * bucket
    return log.groupBy(begin.alias("bucket_ms"), *keys).agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, whatever types its columns have."""
    row = F.struct(*[f"`{c}`" for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(order, *comparable(df, *keys, order))).alias("__row")).select("__row.*")


def medians(df: DataFrame, keys: list[str], *values: str, accuracy: int = 0) -> DataFrame:
    """median_<value> by key. Exact, a key's distinct values meet in one task; with ``accuracy`` the rank is off by 1 / accuracy at most,
    and sketches of a bounded size are merged instead."""
    found = {v: F.percentile_approx(v, 0.5, accuracy) if accuracy else F.median(v) for v in values}
    return df.groupBy(*keys).agg(*[c.alias(f"median_{v}") for v, c in found.items()])


def rejects_by(log: DataFrame) -> DataFrame:
    """(source, code, n) of dead letters, as ingest.dead_letters() gives them."""
    return log.groupBy("source", "code").agg(F.count("*").alias("n"))
