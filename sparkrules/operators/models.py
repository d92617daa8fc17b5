"""Model scores: linear and logistic models as column arithmetic, ONNX models in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..paths import read_bytes

_SESSIONS: dict[int, object] = {}


@dataclass(frozen=True)
class LinearModel:
    """bias + weights x features, through a logistic function if asked; a null feature gives a null score, which fails every test."""

    weights: tuple[float, ...]
    bias: float = 0.0
    logistic: bool = True

    def column(self, features: list[Column]) -> Column:
        if len(features) != len(self.weights):
            raise ValueError(f"{len(features)} features for {len(self.weights)} weights")
        z = F.lit(float(self.bias))
        for w, f in zip(self.weights, features, strict=True):
            z = z + F.lit(float(w)) * f.cast("double")
        return (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if self.logistic else z).cast("float")


@dataclass(frozen=True)
class OnnxModel:
    """A serialised ONNX model; null features are NaN, and the score is the last column of the chosen output."""

    content: bytes
    output_index: int = 0

    @classmethod
    def load(cls, path: str, output_index: int = 0, spark: SparkSession | None = None) -> OnnxModel:
        """A local file, or, given a session, any path that Spark reads."""
        return cls(read_bytes(path, spark), output_index)

    def column(self, features: list[Column]) -> Column:
        import pandas as pd

        content, output = self.content, self.output_index

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            import numpy as np
            import onnxruntime

            key = hash(content)
            if key not in _SESSIONS:  # one session an executor process
                options = onnxruntime.SessionOptions()
                options.intra_op_num_threads = 1
                _SESSIONS[key] = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
            session = _SESSIONS[key]
            name = session.get_inputs()[0].name
            for columns in batches:
                x = np.stack([c.to_numpy(np.float32, na_value=np.nan) for c in columns], axis=1)
                y = np.asarray(session.run(None, {name: x})[output], np.float32).reshape(len(x), -1)
                yield pd.Series(y[:, -1])

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "float")(*[f.cast("float") for f in features])
