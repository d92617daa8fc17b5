"""Line deduplication by site-relative frequency: lines on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RATIO = 0.1
MIN_PAGES = 5
#: The list of boilerplate lines is broadcast up to this many characters, else joined with a shuffle.
BROADCAST_CHARS = 8 << 20
#: Hashes of frequent lines are broadcast up to so many.
BROADCAST_LINES = 200_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(df: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line, pages, total): lines, trimmed, on at least ``min_pages`` pages and over ``ratio`` of their site's pages.

    A line counts once a page; empty lines never count; pages with a null site are one site, and repeated rows are pages of
    their own. Counts run over 64-bit hashes of the lines, combined before the shuffle; lines whose hash passes, at most
    (lines a page) / ratio of them a site, are counted again by their whole text, so a collision cannot add or hide
    anything.
    """
    pages = df.select(F.col(site).alias("site"), F.array_distinct(F.transform(lines_of(F.col(text)), lambda line: F.trim(line))).alias("lines"))
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    each = pages.select("site", F.explode("lines").alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))

    def often(counts: DataFrame) -> DataFrame:
        known = counts.where(F.col("pages") >= min_pages).join(totals.withColumnRenamed("site", "s"), F.col("site").eqNullSafe(F.col("s"))).drop("s")
        return known.where(F.col("pages") > F.col("total") * ratio)

    passed = often(each.groupBy("site", "h").agg(F.count("*").alias("pages"))).select(F.col("site").alias("s"), F.col("h").alias("k"))
    passed = Scratch(df.sparkSession, "lines").table(passed)
    passed = F.broadcast(passed) if passed.count() <= BROADCAST_LINES else passed
    again = each.join(passed, F.col("site").eqNullSafe(F.col("s")) & (F.col("h") == F.col("k")), "left_semi")
    return often(again.groupBy("site", "line").agg(F.count("*").alias("pages"))).select("site", "line", "pages", "total")


def drop_lines(df: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, found: DataFrame | None = None) -> DataFrame:
    """All rows and columns of df, with the site's boilerplate lines taken out of ``text`` and their number in ``n_dropped``.

    Texts without such a line stay byte for byte as they are; null stays null; a page may end up empty. A column named n_dropped is
    replaced. ``found`` may give the lines (site, line); else they are counted over df.
    """
    if found is None:
        found = Scratch(df.sparkSession, "lines").table(boilerplate(df, site, text, ratio, min_pages))
    lists = found.groupBy("site").agg(F.collect_set("line").alias("__drop"))  # (lines a page) / ratio of them at most
    chars = found.agg(F.sum(F.length("line") + 16)).first()[0] or 0
    lists = lists.withColumnRenamed("site", "__site")
    lists = F.broadcast(lists) if chars <= BROADCAST_CHARS else lists
    own = df.join(lists, F.col(site).eqNullSafe(F.col("__site")), "left")
    kept = F.filter(lines_of(F.col(text)), lambda line: ~F.array_contains(F.col("__drop"), F.trim(line)))
    gone = F.when(F.col("__drop").isNull() | F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text))) - F.size(kept))
    left = F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    return own.withColumn("n_dropped", gone.cast("int")).withColumn(text, left).drop("__drop", "__site")
