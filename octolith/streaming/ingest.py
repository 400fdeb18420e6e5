"""Voxels of a stream of points: each voxel once, whatever arrives again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import interleave


def stream_voxels(points: DataFrame, levels: int, box: list[tuple[float, float]], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Distinct Morton keys of a streaming (or batch) frame with x, y, z. With a watermark, keys are forgotten after it."""
    n = 1 << levels
    cell = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(a) - lo) / (hi - lo) * n))) for a, (lo, hi) in zip("xyz", box)]
    keyed = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumn("morton", interleave(*cell, levels))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["morton"]).select("morton")
    return keyed.select("morton").dropDuplicates(["morton"])
