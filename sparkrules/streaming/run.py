"""Rule evaluation over a stream, micro-batch by micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Evaluation, RuleEngine
from ..functions.predicates import key_of
from ..plans.spec import WindowLeaf
from ..sources.kafka import KafkaConfig, write_kafka
from .state import WindowState

Sink = Callable[[DataFrame, int], None]


def decision_log(evaluation: Evaluation, now_ms: int, instance: str = "") -> DataFrame:
    """Decisions as log rows: ts_ms, instance, ruleset_version, the columns of decisions(), and model.<name> for each model's score."""
    scores = evaluation.model_scores()
    decisions = evaluation.decisions(scores)
    return decisions.select(F.lit(now_ms).alias("ts_ms"), F.lit(instance).alias("instance"), F.lit(evaluation.ruleset.version).alias("ruleset_version"), *[f"`{c}`" for c in decisions.columns])


class FileLog:
    """A sink that appends decision logs below a folder as ``format`` (json, parquet, orc, csv).

    Each batch is a folder of its own under the time bucket in which it began, and is written as a whole, so a batch that runs
    again replaces what it wrote. ``roll_seconds`` is the width of the buckets, ``max_rows`` the size of a file.
    """

    def __init__(self, path: str, format: str = "json", roll_seconds: int = 3600, max_rows: int = 0, clock: Callable[[], float] = time.time):
        self.path, self.format, self.roll, self.max_rows, self.clock = path.rstrip("/"), format, roll_seconds, max_rows, clock
        self._bucket: dict[int, int] = {}

    def __call__(self, df: DataFrame, number: int) -> None:
        if number not in self._bucket:
            self._bucket = {number: int(self.clock()) // self.roll * self.roll}
        writer = df.write.mode("overwrite").format(self.format)
        if self.max_rows:
            writer = writer.option("maxRecordsPerFile", self.max_rows)
        writer.save(f"{self.path}/begin={self._bucket[number]}/batch={number}")


class KafkaLog:
    """A sink that sends each row as a JSON object to a topic; ``format`` may name another connector with Kafka's options."""

    def __init__(self, config: KafkaConfig, topic: str, key: str | None = None, format: str = "kafka"):
        self.config, self.topic, self.key, self.format = config, topic, key, format

    def __call__(self, df: DataFrame, number: int) -> None:
        write_kafka(df, self.config, self.topic, self.key, self.format)


def both(*sinks: Sink) -> Sink:
    """One sink out of several, in order."""

    def write(df: DataFrame, number: int) -> None:
        for s in sinks:
            s(df, number)

    return write


class StreamRunner:
    """Evaluates batches with processing-time windows; use ``batch`` as the function of foreachBatch.

    The rules file is looked at before each batch; new rules start with an empty window state. Output is at least once: a
    sink sees a batch number again after a failure, and may use it to write only once. Rejected records go to ``dead_letter``
    with their whole payload.
    """

    def __init__(self, engine: RuleEngine, sink: Sink, state: WindowState | None = None, clock: Callable[[], float] = time.time, instance: str = "", dead_letter: Sink | None = None, ndjson: bool = False):
        self.engine, self.sink, self.state, self.clock, self.instance = engine, sink, state, clock, instance
        self.dead_letter, self.ndjson = dead_letter, ndjson

    def batch(self, df: DataFrame, number: int) -> None:
        if self.engine.reload_if_changed() and self.state:
            self.state.reset()
        now = self.clock()
        # sink, dead letters and window state all read the batch
        df = df.persist()
        try:
            self._evaluate(df, number, now)
        finally:
            df.unpersist()

    def _evaluate(self, df: DataFrame, number: int, now: float) -> None:
        engine = self.engine
        if self.ndjson:
            from ..sources.ingest import dead_letters, parse_json

            parsed = parse_json(df, engine._rules())
            if self.dead_letter:
                self.dead_letter(dead_letters(parsed.bad, self.instance), number)
            df, engine = parsed.good, engine._filling()
        second = int(now)
        evaluation = Evaluation(engine, df, int(now * 1000), F.lit(second))
        windows = {key_of(x): x for x in evaluation._leaves if isinstance(x, WindowLeaf)}
        if windows and self.state:
            evaluation.window_source = lambda d, schema, leaves, names: self.state.read(d, schema, leaves, names, number, second, engine.config.window_precision)
        self.sink(decision_log(evaluation, int(now * 1000), self.instance), number)
        if windows and self.state:
            self.state.write(df, evaluation.schema, windows, number, second)


def run_stream(stream: DataFrame, runner: StreamRunner, checkpoint: str, trigger: dict | None = None):
    """Starts the query; by default it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(runner.batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
