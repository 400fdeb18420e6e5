"""What a viewer asks of an octree: camera rays, first hits with a level of detail, picking, shadows, occlusion, shading.

Rays are in cell units: the grid is 2 ** levels cells of side 1 from the origin on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import axis_of, interleave
from octolith.operators.search import slab

RAY = ["ox", "oy", "oz", "dx", "dy", "dz"]
#: A ray starts this much after its origin when it looks for what stands in its way.
CLOSE = 1e-3


def children(tree: DataFrame, level: int) -> DataFrame:
    """key, cell: the cells one level below the nodes of a level of an octree (level, key, child_mask)."""
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")
    out = tree.where(F.col("level") == level).select("key", slots).select("key", (F.col("key") * 8 + F.col("slot")).alias("cell"))
    return F.broadcast(out) if level < 5 else out  # 8 ** 5 rows at most


def _near_far(level: int, levels: int) -> tuple[Column, Column]:
    o, d = [F.col(c) for c in RAY[:3]], [F.col(c) for c in RAY[3:]]
    size = F.lit(float(1 << (levels - level)))
    low = [axis_of(F.col("cell"), a, level).cast("double") * size for a in range(3)]
    return slab(o, d, low, size)


def first_hits(rays: DataFrame, tree: DataFrame, levels: int, draw_level: int | None = None, projection: float | None = None) -> DataFrame:
    """ray_id, t, level, cell, nx, ny, nz: the first cell that a ray (ray_id, RAY) enters and that is fine enough.

    Fine enough is a cell at draw_level (by default the voxels), or one whose side times `projection` is less than t.
    The normal points out of the side that the ray enters through; it is 0 for a ray that starts inside. Ties go to the
    coarser level, then the smaller key.
    """
    last = draw_level or levels
    front = rays.select("ray_id", *RAY, F.lit(0).cast("long").alias("key"))
    found = None
    for level in range(1, last + 1):
        near, far = _near_far(level, levels)
        rows = front.join(children(tree, level - 1), "key").withColumn("near", near).withColumn("far", far).where(F.col("far") >= F.greatest("near", F.lit(0.0)))
        rows = rows.withColumn("t", F.greatest("near", F.lit(0.0)))
        enough = F.lit(level == last) if projection is None else F.lit(level == last) | (F.lit(projection * float(1 << (levels - level))) < F.col("t"))
        hit = rows.where(enough).select("ray_id", *RAY, F.round("t", 6).alias("t"), F.lit(level).alias("level"), "cell", F.col("near"))
        found = hit if found is None else found.unionByName(hit)
        front = rows.where(~enough).select("ray_id", *RAY, F.col("cell").alias("key"))
    best = found.groupBy("ray_id").agg(F.min(F.struct("t", "level", "cell", "near", *RAY)).alias("h")).select("ray_id", "h.*")
    return best.select("ray_id", "t", "level", "cell", *_normal(levels))


def _normal(levels: int) -> list[Column]:
    """The side of a hit's cell that is entered last: the axis whose own slab begins at `near`."""
    size = F.expr(f"shiftleft(1L, {levels} - level)").cast("double")
    enter = []
    for a, (o, d) in enumerate(zip(RAY[:3], RAY[3:])):
        x = F.lit(0).cast("long")
        for level in range(1, levels + 1):
            x = F.when(F.col("level") == level, axis_of(F.col("cell"), a, level)).otherwise(x)
        slope = F.when(F.abs(F.col(d)) < 1e-12, F.lit(1e-12)).otherwise(F.col(d))
        low = x.cast("double") * size
        enter.append(F.least((low - F.col(o)) / slope, (low + size - F.col(o)) / slope))
    inside = F.col("near") <= 0
    first = [(enter[0] >= enter[1]) & (enter[0] >= enter[2]), (enter[1] > enter[0]) & (enter[1] >= enter[2]), (enter[2] > enter[0]) & (enter[2] > enter[1])]
    return [F.when(inside | ~f, F.lit(0)).otherwise(-F.signum(F.col(d)).cast("int")).alias(f"n{a}") for a, f, d in zip("xyz", first, RAY[3:])]


def blocked(rays: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """ray_id of the rays (ray_id, RAY, reach) with a voxel between CLOSE and `reach`: a semi-join down the octree."""
    front = rays.select("ray_id", *RAY, "reach", F.lit(0).cast("long").alias("key"))
    for level in range(1, levels + 1):
        near, far = _near_far(level, levels)
        rows = front.join(children(tree, level - 1), "key").withColumn("near", near).withColumn("far", far)
        rows = rows.where(F.greatest("near", F.lit(CLOSE)) <= F.least("far", F.col("reach")))
        front = rows.select("ray_id", *RAY, "reach", F.col("cell").alias("key"))
    return front.select("ray_id").distinct()


def _hit_points(rays: DataFrame, hits: DataFrame, off: float) -> DataFrame:
    """ray_id, px, py, pz (where a ray hits, `off` out along the normal) and the normal."""
    both = rays.join(hits, "ray_id")
    return both.select("ray_id", *((F.col(o) + F.col("t") * F.col(d) + F.col(n) * off).alias(p) for o, d, n, p in zip(RAY[:3], RAY[3:], ("nx", "ny", "nz"), ("px", "py", "pz"))), "nx", "ny", "nz")


def shadows(rays: DataFrame, hits: DataFrame, tree: DataFrame, levels: int, light: tuple[float, float, float]) -> DataFrame:
    """ray_id and whether a voxel stands between the hit, half a cell out of the voxel, and the light."""
    p = _hit_points(rays, hits, 0.5)
    to = [F.lit(float(v)) - F.col(c) for v, c in zip(light, ("px", "py", "pz"))]
    reach = F.sqrt(to[0] * to[0] + to[1] * to[1] + to[2] * to[2])
    back = p.select("ray_id", *(F.col(c).alias(o) for c, o in zip(("px", "py", "pz"), RAY[:3])), reach.alias("reach"), *((v / reach).alias(d) for v, d in zip(to, RAY[3:])))
    dark = blocked(back.where("reach > 0"), tree, levels).withColumn("shadow", F.lit(True))
    return p.select("ray_id").join(dark, "ray_id", "left").select("ray_id", F.coalesce("shadow", F.lit(False)).alias("shadow"))


def halton(i: Column, base: Column) -> Column:
    """The radical inverse of i: its digits in a base, mirrored at the point."""
    start = lambda x: F.struct(x["i"].alias("n"), (F.lit(1.0) / x["b"]).alias("f"), F.lit(0.0).alias("r"))
    digit = lambda s, b: F.struct(F.floor(s["n"] / b).cast("long").alias("n"), (s["f"] / b).alias("f"), (s["r"] + s["f"] * (s["n"] % b)).alias("r"))
    pair = F.array(F.struct(i.cast("long").alias("i"), base.cast("long").alias("b")))
    return F.transform(pair, lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(62)), start(x), lambda s, _: digit(s, x["b"])))[0]["r"]


def hemisphere(n: int, spark) -> DataFrame:
    """i (from 1), x, y, z: directions of the upper half, by the cosine of their angle to y, from a two-dimensional sequence."""
    rows = spark.range(1, n + 1).select(F.col("id").alias("i"), halton(F.col("id"), F.lit(2)).alias("u"), halton(F.col("id"), F.lit(3)).alias("v"))
    flat, turn = F.sqrt(1 - F.col("u")), F.col("v") * (2 * math.pi)
    return rows.select("i", (flat * F.cos(turn)).alias("x"), F.sqrt("u").alias("y"), (flat * F.sin(turn)).alias("z"))


def occlusion(rays: DataFrame, hits: DataFrame, tree: DataFrame, levels: int, samples: int, reach: float) -> DataFrame:
    """ray_id, blocked (of the samples), visibility: (1 - share blocked) ** 2 of hemisphere rays of that length at a hit.

    Samples are turned so that y is the normal; the tangent is y less its part along the normal, x where the normal is y.
    Hits without a normal have visibility 1.
    """
    p = _hit_points(rays, hits, CLOSE).withColumn("flat", F.col("ny") == 0)
    up = F.when(F.col("flat"), F.lit(1)).otherwise(F.lit(0))
    tangent = [1 - up, up, F.lit(0)]
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    other = [n[(i + 1) % 3] * tangent[(i + 2) % 3] - n[(i + 2) % 3] * tangent[(i + 1) % 3] for i in range(3)]
    each = p.where("nx <> 0 OR ny <> 0 OR nz <> 0").join(F.broadcast(hemisphere(samples, rays.sparkSession)))  # `samples` rows
    turned = [tangent[i] * F.col("x") + n[i] * F.col("y") + other[i] * F.col("z") for i in range(3)]
    probe = each.select((F.col("ray_id") * samples + F.col("i") - 1).alias("ray_id"), *(F.col(c).alias(o) for c, o in zip(("px", "py", "pz"), RAY[:3])), *(v.alias(d) for v, d in zip(turned, RAY[3:])), F.lit(float(reach)).alias("reach"))
    count = blocked(probe, tree, levels).groupBy(F.floor(F.col("ray_id") / samples).cast("long").alias("ray_id")).agg(F.count("*").alias("blocked"))
    out = p.select("ray_id").join(count, "ray_id", "left").select("ray_id", F.coalesce("blocked", F.lit(0)).alias("blocked"))
    return out.select("ray_id", "blocked", F.round(F.pow(1 - F.col("blocked") / samples, 2), 6).alias("visibility"))


def picked(rays: DataFrame, tree: DataFrame, levels: int, level: int, steps: int = 1024) -> DataFrame:
    """ray_id, step, cell: the first of `steps` steps of half a cell of that level along each ray that stands in a node's cell."""
    side = float(1 << (levels - level))
    long = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    each = rays.where(long > 0).select("ray_id", *RAY[:3], *((F.col(d) / long).alias(d) for d in RAY[3:]), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    at = [F.floor((F.col(o) + F.col(d) * (side / 2) * F.col("step")) / side).cast("long") for o, d in zip(RAY[:3], RAY[3:])]
    here = each.select("ray_id", "step", *(c.alias(a) for c, a in zip(at, "xyz"))).where(" AND ".join(f"{a} BETWEEN 0 AND {(1 << level) - 1}" for a in "xyz"))
    here = here.select("ray_id", "step", interleave(F.col("x"), F.col("y"), F.col("z"), level).alias("cell"))
    return here.join(children(tree, level - 1).select("cell"), "cell").groupBy("ray_id").agg(F.min(F.struct("step", "cell")).alias("h")).select("ray_id", "h.step", "h.cell")


def camera(position: list[float], target: list[float], up: list[float]) -> list[list[float]]:
    """Right, up and forward of a camera that looks at a point."""
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    cross = lambda a, b: [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]
    forward = unit([t - p for t, p in zip(target, position)])
    right = unit(cross(forward, up))
    return [right, cross(right, forward), forward]


def camera_rays(spark, position: list[float], target: list[float], up: list[float], fov: float, width: int, height: int) -> DataFrame:
    """ray_id (row by row), x, y and a ray through the middle of each pixel; fov: the angle of the height in radians."""
    right, above, forward = camera(position, target, up)
    tan = math.tan(fov / 2)
    pixel = spark.range(width * height).select(F.col("id").alias("ray_id"), (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).cast("long").alias("y"))
    sx, sy = ((F.col("x") + 0.5) / width * 2 - 1) * (tan * width / height), ((F.col("y") + 0.5) / height * 2 - 1) * tan
    d = [F.lit(r) * sx + F.lit(u) * sy + F.lit(f) for r, u, f in zip(right, above, forward)]
    long = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return pixel.select("ray_id", "x", "y", *(F.lit(float(p)).alias(o) for p, o in zip(position, RAY[:3])), *((v / long).alias(n) for v, n in zip(d, RAY[3:])))


def projection_factor(fov: float, pixel_tolerance: float, height: int, divisor: float = 1.0) -> float:
    """How often a cell's side a ray may be long before the cell is no larger than the tolerance on the screen."""
    return 1 / (2 * math.tan(fov / 2)) / (pixel_tolerance / (height / divisor))


def shaded(rays: DataFrame, hits: DataFrame, light: tuple[float, float, float], diagonal: float) -> DataFrame:
    """ray_id, depth (t by the scene's diagonal) and diffuse: half by the angle to the light, less a fifth of its distance."""
    p = _hit_points(rays, hits, 0.0).join(hits.select("ray_id", "t"), "ray_id")
    to = [F.lit(float(v)) - F.col(c) for v, c in zip(light, ("px", "py", "pz"))]
    far = F.sqrt(to[0] * to[0] + to[1] * to[1] + to[2] * to[2])
    facing = F.greatest((to[0] * F.col("nx") + to[1] * F.col("ny") + to[2] * F.col("nz")) / far, F.lit(0.0))
    return p.select("ray_id", F.round(F.col("t") / diagonal, 6).alias("depth"), F.round(0.5 + 0.5 * facing - 0.2 * far / diagonal, 6).alias("diffuse"))


def node_colours(ranks: DataFrame) -> DataFrame:
    """level, node_id, r, g, b (by the node's rank) and rare, how much a node of few references is marked (0 to 1)."""
    rank = F.col("rank")
    raw = [(rank % 100) / 100, (3 * rank % 200) / 200, (2 * rank % 300) / 300]
    long = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    size = ranks.groupBy("level").agg(F.count("*").alias("n"))
    rows = ranks.join(F.broadcast(size), "level")  # a row a level
    return rows.select("level", "node_id", *(F.round(F.when(long > 0, c / long).otherwise(0.0), 6).alias(n) for c, n in zip(raw, "rgb")), F.round(1 - F.pow(1 - rank / F.col("n"), 2), 6).alias("rare"))
