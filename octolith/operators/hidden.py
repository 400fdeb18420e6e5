"""Inside and outside: empty octree cells, their neighbours, what the outside reaches, and nodes that look the same from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import axis_of, bits, interleave, prefix, slot
from octolith.operators.clusters import components
from octolith.storage import cut

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _by_level(level: Column, make, levels: int) -> Column:
    out = make(1)
    for v in range(2, levels + 1):
        out = F.when(level == v, make(v)).otherwise(out)
    return out


def empty_cells(tree: DataFrame, levels: int) -> DataFrame:
    """level, key of the largest empty cells: the children that an octree's nodes (level, key, child_mask) lack.

    A cell of level v has a side of 2 ** (levels - v) voxels. As many as the surface needs, not as the grid has voxels.
    """
    missing = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 0)")).alias("slot")
    return tree.select("level", "key", missing).select((F.col("level") + 1).alias("level"), (F.col("key") * 8 + F.col("slot")).alias("key"))


def neighbours(cells: DataFrame, levels: int) -> DataFrame:
    """level, key, near: the cells of the same size beside each face (level, key), inside the grid."""
    x = [_by_level(F.col("level"), lambda v, a=a: axis_of(F.col("key"), a, v), levels) for a in range(3)]
    rows = cells.select("level", "key", *(c.alias(n) for c, n in zip(x, "xyz")), F.expr("shiftleft(1L, level) - 1").alias("last"))
    to = F.explode(F.array(*(F.struct(*((F.col(n) + F.lit(s)).alias(n) for n, s in zip("xyz", step))) for step in STEPS))).alias("to")
    rows = rows.select("level", "key", "last", to).where(" AND ".join(f"to.{n} BETWEEN 0 AND last" for n in "xyz"))
    return rows.select("level", "key", interleave(F.col("to.x"), F.col("to.y"), F.col("to.z"), levels).alias("near"))


def beside(cells: DataFrame, others: DataFrame, levels: int) -> DataFrame:
    """Pairs (level, key) of cells, (other_level, other) of others at a face, the other one as large or larger."""
    near = neighbours(cells, levels)
    upper = F.explode(F.sequence(F.lit(1), F.col("level"))).alias("other_level")
    up = near.select("level", "key", "near", upper).withColumn("other", F.expr("shiftright(near, 3 * (level - other_level))"))
    return up.join(others.select(F.col("level").alias("other_level"), F.col("key").alias("other")), ["other_level", "other"]).select("level", "key", "other_level", "other").distinct()


def _named(level: Column, key: Column) -> Column:
    return key * 32 + level


def outside_cells(tree: DataFrame, levels: int) -> DataFrame:
    """The largest empty cells (level, key) that faces lead to from the cell in the highest corner; none if that is solid."""
    empty = cut(empty_cells(tree, levels), "empty")
    pairs = beside(empty, empty, levels).select(_named(F.col("level"), F.col("key")).alias("src"), _named(F.col("other_level"), F.col("other")).alias("dst"))
    corner = empty.where(F.expr(f"key = shiftleft(1L, 3 * level) - 1"))
    alone = empty.select(_named(F.col("level"), F.col("key")).alias("src")).withColumn("dst", F.col("src"))
    label = components(pairs.union(alone))
    start = corner.select(_named(F.col("level"), F.col("key")).alias("node_id")).join(label, "node_id").select("component")
    out = label.join(F.broadcast(start), "component")  # one row
    return out.select((F.col("node_id") % 32).cast("int").alias("level"), F.floor(F.col("node_id") / 32).cast("long").alias("key"))


def voxels_of(cells: DataFrame, levels: int) -> DataFrame:
    """The keys of the voxels in cells (level, key)."""
    each = F.explode(F.expr(f"sequence(shiftleft(key, 3 * ({levels} - level)), shiftleft(key + 1, 3 * ({levels} - level)) - 1)")).alias("key")
    return cells.select(each)


def outside_masks(tree: DataFrame, levels: int) -> DataFrame:
    """level, key, outside_mask of every node: the children that are outside or have something outside in them.

    Empty children are outside where the outside reaches them, voxels where one of their faces is at such a cell.
    """
    out = cut(outside_cells(tree, levels), "outside")
    leaf = tree.where(F.col("level") == levels - 1)
    voxel = leaf.select(F.lit(levels).alias("level"), "key", F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")).select("level", (F.col("key") * 8 + F.col("slot")).alias("key"))
    seen = beside(voxel, out, levels).select("level", "key").distinct()
    below, every = cut(seen.union(out.where(F.col("level") == levels)), "seen"), None
    for level in range(levels - 1, -1, -1):
        mask = F.bit_or(F.call_function("shiftleft", F.lit(1), slot(F.col("key")))).cast("int").alias("outside_mask")
        own = cut(below.groupBy(prefix(F.col("key"), 1).alias("key")).agg(mask), "masks")
        rows = tree.where(F.col("level") == level).select("level", "key").join(own, "key", "left").select("level", "key", F.coalesce("outside_mask", F.lit(0)).alias("outside_mask"))
        every = rows if every is None else every.unionByName(rows)
        if level:
            up = own.select(F.lit(level).alias("level"), "key")
            below = up.union(out.where(F.col("level") == level))
    return every


def visible_merge(tree: DataFrame, masks: DataFrame, levels: int) -> DataFrame:
    """key, child_mask, new: leaf nodes that look like another from outside take its mask.

    A leaf's visible voxels are its mask under its outside mask. A leaf can be replaced by a mask that agrees with it on
    every child the outside sees; of the leaf masks there are (255 at most), the one that stands for most leaves is taken,
    then the one with more voxels, then the smallest. What is inside of a closed surface may change by that, its looks can't.
    """
    leaf = tree.where(F.col("level") == levels - 1).join(masks.where(F.col("level") == levels - 1).select("key", "outside_mask"), "key").select("key", "child_mask", "outside_mask")
    kinds = leaf.groupBy("child_mask", "outside_mask").agg(F.count("*").alias("n"))
    have = kinds.groupBy(F.col("child_mask").alias("new")).agg(F.sum("n").alias("uses"))
    fits = kinds.join(F.broadcast(have), (F.col("child_mask").bitwiseAND(F.col("outside_mask"))) == (F.col("new").bitwiseAND(F.col("outside_mask"))))  # 255 masks at most
    best = fits.groupBy("child_mask", "outside_mask").agg(F.max(F.struct("uses", bits(F.col("new")).alias("voxels"), (-F.col("new")).alias("m"))).alias("b")).select("child_mask", "outside_mask", (-F.col("b.m")).alias("new"))
    return leaf.join(F.broadcast(best), ["child_mask", "outside_mask"]).select("key", "child_mask", "new")
