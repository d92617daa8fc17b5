"""Arrow IPC files and streams."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def batches_of(content: bytes) -> Iterator[pa.RecordBatch]:
    """The stream format first, then the file format."""
    try:
        reader = pa.ipc.open_stream(io.BytesIO(content))
    except pa.ArrowInvalid:
        file = pa.ipc.open_file(io.BytesIO(content))
        yield from (file.get_batch(i) for i in range(file.num_record_batches))
    else:
        yield from reader


def read_ipc(spark: SparkSession, path: str, schema: T.StructType | str | None = None, validate: bool = True) -> DataFrame:
    """Every file is one task's; without a schema that of the first file is taken. Columns are taken by name."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        first = files.limit(1).collect()
        if not first:
            raise FileNotFoundError(path)
        content = bytes(first[0]["content"])
        try:
            arrow = pa.ipc.open_stream(io.BytesIO(content)).schema
        except pa.ArrowInvalid:
            arrow = pa.ipc.open_file(io.BytesIO(content)).schema
        schema = from_arrow_schema(arrow)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return decode_ipc(files, schema, "content", validate)


def decode_ipc(df: DataFrame, schema: T.StructType | str, value: str = "value", validate: bool = True) -> DataFrame:
    """Rows of messages, each one Arrow stream or file; null messages have none."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for own in batches_of(content.as_py()) if content.is_valid else ():
                    if validate:
                        own.validate(full=True)
                    columns = []
                    for f in target:
                        c = own.column(f.name)
                        c = c.dictionary_decode() if pa.types.is_dictionary(c.type) else c
                        columns.append(c.cast(f.type))
                    yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.select(value).mapInArrow(read, schema)


def encode_ipc(df: DataFrame) -> DataFrame:
    """(value): df's rows as Arrow streams, one a batch."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = io.BytesIO()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["value"])

    return df.mapInArrow(write, "value binary")
