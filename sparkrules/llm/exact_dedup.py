"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name, different blocks different
names; then names of adjacent pairs of blocks are given in the same way, round after round, until each text has one
name. Names come from sorted, distinct values, never from hashes alone, so two texts have one name only if they are
equal byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_BYTES = 4096


def _blocks(text: Column, size: int) -> Column:
    """The text's bytes in blocks; an empty text is one empty block."""
    last = F.greatest(F.ceil(F.octet_length(text) / size).cast("int") - 1, F.lit(0))
    # the outer transform binds the bytes once, however many blocks there are
    cut = F.transform(
        F.array(F.encode(text, "UTF-8")),
        lambda b: F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size))),
    )
    return F.element_at(cut, 1)


def _named(distinct: DataFrame) -> DataFrame:
    """Adds name: an integer of its own for each row of distinct, which is sorted within its partitions."""
    return distinct.sortWithinPartitions(*distinct.columns).withColumn("name", F.monotonically_increasing_id())


def name_texts(df: DataFrame, scratch: Scratch, text: str = "text", block_bytes: int = BLOCK_BYTES, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of df: __row, the ``extra`` columns, level and name; texts are equal if level and name are.

    Blocks are sorted and named once as whole values, distinct ones only, combined before the shuffle. Rows then get their
    block's name over the block's 64-bit hash; where a hash stands for two blocks (none in practice) the names are found
    by the blocks themselves. A text of n blocks takes ceil(log2 n) rounds, in which only texts of several blocks take part.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), value.alias("__text"), *[c.alias(k) for k, c in (extra or {}).items()])
    blocks = rows.withColumn("__blocks", _blocks(F.col("__text"), block_bytes))
    hashes = F.transform("__blocks", lambda b: F.xxhash64(b))
    rows = scratch.table(blocks.select("__row", *(extra or {}), hashes.alias("hashes")))

    values = df.select(F.explode(_blocks(value, block_bytes)).alias("block"))
    names = scratch.table(_named(values.select(F.xxhash64("block").alias("h"), "block").distinct()).select("h", "name", "block"))
    doubled = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    at = rows.select("__row", F.size("hashes").alias("n"), F.posexplode("hashes").alias("i", "h"))
    if doubled.isEmpty():
        named = at.join(names.select("h", "name"), "h").select("__row", "n", "i", "name")
    else:
        # numbers of rows may differ from reading to reading, so blocks and the rows' other columns are stored by one
        rows = scratch.table(blocks.select("__row", *(extra or {}), "__blocks"))
        at = rows.select("__row", F.size("__blocks").alias("n"), F.posexplode("__blocks").alias("i", "block"))
        named = at.join(names.select("block", "name"), "block").select("__row", "n", "i", "name")
    named = scratch.table(named)
    scratch.drop(names)

    most = named.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(named.where("n = 1").select("__row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (
            named.where("n > 1")
            .groupBy("__row", F.shiftright("i", 1).alias("i"), F.ceil(F.col("n") / 2).cast("int").alias("n"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = scratch.table(pairs)
        names = _named(pairs.select("a", "b").distinct())
        named = scratch.table(pairs.join(names, ["a", "b"]).select("__row", "n", "i", "name"))
        scratch.drop(pairs)
        most, level = -(-most // 2), level + 1
    identity = done[0]
    for more in done[1:]:
        identity = identity.union(more)
    return rows.drop("hashes", "__blocks").join(identity, "__row")


def dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df: the id, keep_id, group_size, kept and text_sha256.

    Null texts count as empty and are equal to empty ones. Of equal texts the row with the largest id stays; null ids are
    smaller than all others, and of repeated ids one row stays. A group in which every id is null has a null keep_id. An
    empty table gives an empty result. Groups are never gathered: sizes and largest ids are combined before the shuffle.
    """
    scratch = Scratch(df.sparkSession, "dedup")
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    named = scratch.table(name_texts(df, scratch, text, block_bytes, {id_col: F.col(id_col), "sha": sha}))
    best = F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("best")
    groups = named.groupBy("level", "name").agg(F.count("*").alias("group_size"), best)
    # only repeated texts are joined back, from a table, so that a hot group's rows can be split
    groups = scratch.table(groups.where("group_size > 1"))
    alone = F.col("group_size").isNull()
    return named.join(groups, ["level", "name"], "left").select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("__row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
