"""Scoring of streams with a trained model.

The engine it follows has no streams; a model's score is a row-wise plan, so
it applies to a streaming DataFrame as it stands, with entity coefficients as
the static side of a stream-static join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kestrix.operators.mixed import MixedModel


def score_stream(stream: DataFrame, model: MixedModel) -> DataFrame:
    return model.score(stream)


def write_scores(stream: DataFrame, model: MixedModel, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scores to Parquet files, exactly once by the query's checkpoint."""
    out = score_stream(stream, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
