"""Files of the driver, or of any file system that Spark reads."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _far(path: str, spark: SparkSession | None):
    """The Hadoop file system and path of a name with a scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def modified(path: str, spark: SparkSession | None = None) -> float:
    """Seconds of the last change; 0 where the file is not to be found."""
    if spark is not None and "://" in path:
        fs, place = _far(path, spark)
        return fs.getFileStatus(place).getModificationTime() / 1000 if fs.exists(place) else 0.0
    return os.path.getmtime(path) if os.path.exists(path) else 0.0


def read_text(path: str, spark: SparkSession) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A whole file in the driver: models and rules, not data."""
    if spark is not None and "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()
