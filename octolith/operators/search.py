"""Point lookup, rays, flood fill and triangle tests over voxel sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import axis_of, prefix
from octolith.operators.hidden import outside_cells, voxels_of
from octolith.operators.octree import svo
from octolith.storage import cut


def locate(points: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """points (id, morton) with the deepest level whose node holds them (-1: none), and whether the voxel is there."""
    out = points.select("id", "morton", F.lit(-1).alias("depth"))
    for level in range(levels):
        row = tree.where(F.col("level") == level).select(F.col("key").alias("k"), F.col("child_mask").alias("m"))
        hit = out.join(row, prefix(F.col("morton"), levels - level) == F.col("k"), "left")
        has = F.lit(False)
        if level == levels - 1:
            bit = F.expr("shiftright(m, cast(morton & 7 as int)) & 1")
            has = F.coalesce(bit == 1, F.lit(False))
        out = hit.select("id", "morton", F.when(F.col("k").isNotNull(), F.lit(level)).otherwise(F.col("depth")).alias("depth"), has.alias("has_voxel"))
    return out


def centres(voxels: DataFrame, levels: int, box: list[tuple[float, float]]) -> DataFrame:
    """morton, x, y, z: the middle of each voxel of a grid over a box."""
    n = 1 << levels
    return voxels.select("morton", *((F.lit(lo) + F.lit(hi - lo) * (axis_of(F.col("morton"), a, levels) + 0.5) / n).alias(c) for a, (c, (lo, hi)) in enumerate(zip("xyz", box))))


def slab(o: list[Column], d: list[Column], low: list[Column], size: Column) -> tuple[Column, Column]:
    """Where a ray enters and leaves a cube. Zero directions are nudged, so every axis has a slope."""
    near, far = [], []
    for a, b, c in zip(o, d, low):
        b = F.when(F.abs(b) < 1e-12, F.lit(1e-12)).otherwise(b)
        t0, t1 = (c - a) / b, (c + size - a) / b
        near.append(F.least(t0, t1))
        far.append(F.greatest(t0, t1))
    return F.greatest(*near), F.least(*far)


def cast_rays(rays: DataFrame, voxels: DataFrame, levels: int) -> DataFrame:
    """rays (ray_id, ox..oz, dx..dz) in cell units: the first voxel hit and t, level by level over the octree's cells."""
    o, d = [F.col(c) for c in ("ox", "oy", "oz")], [F.col(c) for c in ("dx", "dy", "dz")]
    front = rays.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz", F.lit(0).cast("long").alias("key"))
    for level in range(1, levels + 1):
        cells = voxels.select(prefix(F.col("morton"), levels - level).alias("cell")).distinct().select(prefix(F.col("cell"), 1).alias("key"), "cell")
        size = F.lit(float(1 << (levels - level)))
        low = [axis_of(F.col("cell"), a, level).cast("double") * size for a in range(3)]
        near, far = slab(o, d, low, size)
        front = front.join(cells, "key").withColumn("near", near).withColumn("far", far).where((F.col("far") >= F.greatest(F.col("near"), F.lit(0.0))))
        # A cell that a ray enters after it has left another one can still be needed (that one may be empty further
        # down), so only misses go; the nearest voxel is taken at the end.
        front = front.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz", F.col("cell").alias("key"), F.greatest("near", F.lit(0.0)).alias("t"))
    return front.groupBy("ray_id").agg(F.min(F.struct(F.round("t", 6).alias("t"), F.col("key"))).alias("h")).select("ray_id", F.col("h.t").alias("t"), F.col("h.key").alias("morton"))


def flood_outside(voxels: DataFrame, levels: int) -> DataFrame:
    """Keys of the empty cells that faces lead to from the highest corner."""
    return voxels_of(outside_cells(cut(svo(voxels, levels), "svo"), levels), levels)


def tri_box_overlap(rows: DataFrame, center: list[Column], half: Column) -> DataFrame:
    """The rows whose triangle (TRIANGLE) touches the cube: the separating-axis test on 13 axes, closed.

    Corners and sides relative to the cube are columns of their own, so that they are computed once.
    """
    have = rows.columns
    v = [[f"__{p}{a}" for a in "xyz"] for p in "abc"]
    e = [[f"__e{i}{a}" for a in "xyz"] for i in range(3)]
    rows = rows.select("*", half.alias("__h"), *((F.col(f"{p}{a}") - m).alias(f"__{p}{a}") for p in "abc" for a, m in zip("xyz", center)))
    rows = rows.select("*", *((F.col(v[(i + 1) % 3][k]) - F.col(v[i][k])).alias(e[i][k]) for i in range(3) for k in range(3)))
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    unit = [["1D", "0D", "0D"], ["0D", "1D", "0D"], ["0D", "0D", "1D"]]
    for axis in [*unit, cross(e[0], e[1]), *(cross(u, x) for u in unit for x in e)]:
        p = [" + ".join(f"{a} * {b}" for a, b in zip(axis, q)) for q in v]
        r = f"__h * ({' + '.join(f'abs({a})' for a in axis)})"
        rows = rows.where(f"least({', '.join(p)}) <= {r} AND greatest({', '.join(p)}) >= -({r})")
    return rows.select(*have)


TRIANGLE = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def voxelize_triangles(triangles: DataFrame, levels: int) -> DataFrame:
    """(tri_id, morton) of triangles in cell units: each level keeps the children that a triangle touches."""
    front = triangles.select("tri_id", *TRIANGLE, F.lit(0).cast("long").alias("key"))
    for level in range(1, levels + 1):
        half = F.lit(float(1 << (levels - level)) / 2)
        child = front.select("tri_id", *TRIANGLE, F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.col("key") * 8 + s)).alias("key"))
        center = [axis_of(F.col("key"), a, level).cast("double") * 2 * half + half for a in range(3)]
        front = tri_box_overlap(child, center, half)
    return front.select("tri_id", F.col("key").alias("morton"))
