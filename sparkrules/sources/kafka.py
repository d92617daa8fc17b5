"""Kafka options; the connector itself is a Spark package that the cluster has to provide."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KafkaConfig:
    servers: str
    topics: tuple[str, ...]
    group: str = ""
    starting: str = "latest"
    max_offsets: int = 0
    extra: dict[str, str] = field(default_factory=dict)

    def read_options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(self.topics), "startingOffsets": self.starting}
        if self.group:
            out["kafka.group.id"] = self.group
        if self.max_offsets:
            out["maxOffsetsPerTrigger"] = str(self.max_offsets)
        return out | {f"kafka.{k}": v for k, v in self.extra.items()}

    def write_options(self, topic: str) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": topic} | {f"kafka.{k}": v for k, v in self.extra.items()}


def read_kafka(spark: SparkSession, config: KafkaConfig, format: str = "kafka") -> DataFrame:
    """(topic, partition, offset, timestamp, key, value); records with an empty value are skipped.

    ``format`` may name another source with the columns of Kafka's.
    """
    stream = spark.readStream.format(format).options(**config.read_options()).load()
    return stream.where(F.octet_length("value") > 0).select("topic", "partition", "offset", "timestamp", "key", F.col("value").cast("string").alias("value"))


def write_kafka(df: DataFrame, config: KafkaConfig, topic: str, key: str | None = None, format: str = "kafka") -> None:
    """Each row as a JSON object; appended, as a topic is."""
    rows = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    rows.write.format(format).mode("append").options(**config.write_options(topic)).save()
