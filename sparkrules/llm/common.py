"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``bytes.translate`` table: A-Z to lower case; every byte that is no word byte to a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Text is handled in Python in slices of about this many bytes, so that temporaries stay small.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 50_000
BATCH_BYTES = 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all runs in one JVM, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkrules-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


class Scratch:
    """Tables in the shared folder that cut a job's lineage: a lost executor costs no more than the current step.

    What is not dropped earlier goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Writes df once and reads it back; the path is kept for drop()."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self._path(t._scratch_path), True)


def literal_array(values: Iterable, kind: str) -> Column:
    """A constant array as one folded literal; kind as in DDL, such as ``array<bigint>``."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def all_columns_hash(df: DataFrame, *skip: str) -> Column:
    """A hash of a whole row, the same on every reading of the same rows; types that cannot be hashed are left out."""
    able = [f"`{n}`" for n, kind in df.dtypes if n not in skip and not kind.startswith(("map", "variant", "void"))]
    return F.xxhash64(*able) if able else F.lit(0).cast("bigint")


def number_within(df: DataFrame, group: str, key: Column, order: list[Column], name: str, bins: int = 64) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... within each value of the integer column ``group``, of which there are few.

    Rows of a group are dealt by ``key`` (a hash of the row) to ``bins`` bins that are numbered apart, so that no task
    gets a whole group; the bins' counts (groups x bins rows) give each bin its first number.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("__bin", F.pmod(key, F.lit(bins)).cast("int"))
    counts = df.groupBy(group, "__bin").agg(F.count("*").alias("n")).collect()
    first, total = {}, {}
    for g, b, n in sorted((tuple(r) for r in counts), key=lambda r: (r[0] is not None, r[0], r[1])):
        first.setdefault(str(g), [0] * bins)[b] = total.get(g, 0)
        total[g] = total.get(g, 0) + n
    starts = F.from_json(F.lit(json.dumps(first)), "map<string,array<bigint>>")
    own = starts[F.coalesce(F.col(group).cast("string"), F.lit("None"))]
    nth = F.row_number().over(W.partitionBy(group, "__bin").orderBy(*order))
    return df.withColumn(name, (F.element_at(own, F.col("__bin") + 1) + nth - 1).cast("bigint")).drop("__bin")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to BATCH_BYTES where it stands at Spark's default: texts can be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns free memory of this Python process, which later tasks may not use, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cuts Arrow batches into slices of about SLICE_BYTES of text, with the texts as bytes."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
        begin = 0
        while begin < len(column):
            before = ends[begin - 1] if begin else 0
            end = min(begin + SLICE_ROWS, max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
            yield batch.slice(begin, end - begin), column.slice(begin, end - begin).to_pylist()
            begin = end
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64; its constants are fixed values)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """Word to 64-bit hash; remembers ``keep`` words."""

    def __init__(self, keep: int = 100_000):
        import xxhash

        self._hash, self._keep = xxhash.xxh3_64_intdigest, keep

    def __missing__(self, word: bytes) -> int:
        h = self._hash(word)
        if len(self) < self._keep:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
