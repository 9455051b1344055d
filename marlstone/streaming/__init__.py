"""Rule lists and clusterings applied to streams.

Labels, votes and clusters are projections of a row, so they need no state or watermark; what
is learned is learned from batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlstone.operators import classify, cluster
from marlstone.operators.cluster import ClusterModel
from marlstone.operators.rules import Rule


def label_stream(rows: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """A stream with the predicted class in a new column."""
    if not rows.isStreaming:
        raise ValueError("rows isn't a stream")
    return classify.label(rows, rules, name)


def cluster_stream(rows: DataFrame, model: ClusterModel, name: str) -> DataFrame:
    """A stream with the nearest cluster in a new column."""
    if not rows.isStreaming:
        raise ValueError("rows isn't a stream")
    return cluster.assign(rows, model, name)
