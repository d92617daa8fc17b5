"""Files by format, chosen by extension or by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestError

EXTENSIONS = {
    "arrow": "arrow", "arrows": "arrow", "ipc": "arrow", "feather": "arrow", "parquet": "parquet", "pq": "parquet",
    "csv": "csv", "json": "ndjson", "jsonl": "ndjson", "ndjson": "ndjson", "avro": "avro",
}


def format_of(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].removeprefix(".").lower()
    if ext not in EXTENSIONS:
        raise IngestError("FILE_IO_ERROR", f"unknown file format: {path}")
    return EXTENSIONS[ext]


def read_files(spark: SparkSession, path: str, fmt: str = "auto", schema: T.StructType | str | None = None) -> DataFrame:
    fmt = format_of(path) if fmt == "auto" else fmt
    reader = spark.read.schema(schema) if schema is not None else spark.read
    match fmt:
        case "parquet":
            return reader.parquet(path)
        case "csv":
            return reader.csv(path, header=True, inferSchema=schema is None, escape='"')
        case "ndjson":
            return reader.json(path)
        case "arrow":
            from .arrow_ipc import read_ipc

            return read_ipc(spark, path, schema)
        case "avro":
            from .avro_ocf import read_avro

            return read_avro(spark, path, schema)
    raise IngestError("FILE_IO_ERROR", f"unknown file format: {fmt!r}")


def csv_lines(lines: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Records of CSV that are rows already, such as messages; a quote inside quotes is doubled, a value that does not fit is null."""
    ddl = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    return lines.select(F.from_csv(value, ddl, {"escape": '"'}).alias("__csv")).select("__csv.*")
