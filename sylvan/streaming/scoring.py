"""Scoring a stream: a fitted tree is an expression, so it has no state and needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import predict, predict_proba
from ..operators.tree import Tree, normalise


def score_stream(stream: DataFrame, tree: Tree, keep: list[str]) -> DataFrame:
    """``keep`` columns of a streaming DataFrame with prediction and probability."""
    rows = normalise(stream.select(*dict.fromkeys([*keep, *tree.kinds])), "", tree.kinds)
    return predict_proba(predict(rows, tree), tree).select(*keep, "prediction", "probability")


def write(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scores as Parquet, once each, until the input that is there is done."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
