"""Connected components of an edge table: least labels spread over edges, and labels jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) to (node, label): label is the smallest node that edges lead to. Self edges are allowed."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(jump, "label").join(near, "node")
        labels = written(new.select("node", F.least("far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("moved")), "labels")
    return labels.select("node", "label")
