"""Protobuf frames and length-delimited files, through google.protobuf and a descriptor set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IngestError

MAX_DEPTH = 32


def message_class(descriptor_set: bytes, message: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool, files = descriptor_pool.DescriptorPool(), descriptor_pb2.FileDescriptorSet.FromString(descriptor_set)
    for f in files.file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(message))


def spark_type(descriptor, depth: int = 0) -> T.StructType:
    """Enums by name; unsigned numbers as bigint."""
    if depth > MAX_DEPTH:
        raise IngestError("SCHEMA_MISMATCH", f"messages are nested deeper than {MAX_DEPTH}")
    kinds = {1: T.DoubleType(), 2: T.FloatType(), 8: T.BooleanType(), 9: T.StringType(), 12: T.BinaryType(), 14: T.StringType(), 5: T.IntegerType(), 15: T.IntegerType(), 17: T.IntegerType()}
    fields = []
    for f in descriptor.fields:
        kind = spark_type(f.message_type, depth + 1) if f.message_type else kinds.get(f.type, T.LongType())
        fields.append(T.StructField(f.name, T.ArrayType(kind) if repeated(f) else kind))
    return T.StructType(fields)


def repeated(f) -> bool:
    return f.is_repeated if hasattr(f, "is_repeated") else f.label == f.LABEL_REPEATED


def to_dict(message) -> dict:
    out = {}
    for f in message.DESCRIPTOR.fields:
        value = getattr(message, f.name)
        one = to_dict if f.message_type else (lambda v, f=f: getattr(f.enum_type.values_by_number.get(v), "name", str(v))) if f.enum_type else (lambda v: v)
        if repeated(f):
            out[f.name] = [one(v) for v in value]
        elif f.has_presence and not message.HasField(f.name):
            out[f.name] = None
        else:
            out[f.name] = one(value)
    return out


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise IngestError("MALFORMED_JSON", "a Protobuf length is cut off")
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def strip_prefix(frame: bytes) -> bytes:
    """Without the registry prefix: 0, a schema number of four bytes and the message's index path."""
    if frame[:1] != b"\0" or len(frame) < 6:
        return frame
    n, at = varint(frame, 5)
    for _ in range((n >> 1) ^ -(n & 1)):
        _, at = varint(frame, at)
    return frame[at:]


def delimited(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        n, at = varint(content, at)
        if at + n > len(content):
            raise IngestError("MALFORMED_JSON", "a Protobuf message is cut off")
        yield content[at : at + n]
        at += n


def _decode(df: DataFrame, descriptor_set: bytes, message: str, frames) -> DataFrame:
    schema = spark_type(message_class(descriptor_set, message).DESCRIPTOR)
    kind = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, held = message_class(descriptor_set, message), []
        for b in batches:
            for content in b.column(0):
                for frame in frames(content.as_py()):
                    held.append(to_dict(cls.FromString(frame)))
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return df.mapInArrow(read, schema)


def decode_frames(df: DataFrame, descriptor_set: bytes, message: str, value: str = "value") -> DataFrame:
    return _decode(df.select(value), descriptor_set, message, lambda c: [strip_prefix(c)] if c else [])


def read_delimited(spark: SparkSession, path: str, descriptor_set: bytes, message: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")
    return _decode(files, descriptor_set, message, lambda c: delimited(c) if c else [])
