"""Structured Streaming around a model graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import ScoringModel


def score_stream(model: ScoringModel, stream: DataFrame, outputs: list[str] | None = None) -> DataFrame:
    """The stream with the model's outputs; append mode, no state, no watermark needed."""
    if not stream.isStreaming:
        raise ValueError("this is no stream: use transform")
    return model.transform(stream, outputs)


def start_scoring(model: ScoringModel, stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = False) -> StreamingQuery:
    """Scores the stream into files at path; once reads what is there and stops."""
    writer = score_stream(model, stream).writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)
