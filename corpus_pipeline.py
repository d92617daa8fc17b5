"""A training corpus from documents, in five stages; belongs to the subpackage sparkrules.llm.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns a DataFrame that is written
and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrules.llm import decontaminate, line_dedup, near_dedup, packing, quality
from sparkrules.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Contaminated texts are broadcast up to this many, else joined with a shuffle.
BROADCAST_ROWS = 100_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out of its texts; n_chars follows the text."""
    cleaned = line_dedup.drop_lines(docs)
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    scratch = Scratch(spark, "decontaminate")
    index = scratch.table(decontaminate.build_index(docs.withColumn("__key", key), id_col="__key"))
    found = decontaminate.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = scratch.table(found.where(F.size("items") > 0).select("id").distinct())
    scratch.drop(index)
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, key == F.col("id"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into batches of length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: The classifier, ProbMinHash and the dynamic programme have no SQL form; tests/llm/test_pipeline_by_hand.py holds stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
