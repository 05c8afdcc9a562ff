"""A fitted pipeline over a stream: its features are row-local, so the projection needs no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.pipeline import FeatureSet
from ..plans.expr import project


def stream_features(stream: DataFrame, fs: FeatureSet, keep: Sequence[str], path: str, checkpoint: str):
    """Start a query that appends the features of a streaming DataFrame to Parquet files; exactly once by its checkpoint."""
    out = project(stream, fs.features, keep)
    out = out.toDF(*[c if c in keep else f"f{k}" for k, c in enumerate(out.columns)])
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
