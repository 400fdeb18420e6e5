"""Voxel sets, octree levels, and their reduction to graphs of distinct nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import bit, bits, interleave, prefix, slot
from octolith.operators.order import running_sum
from octolith.storage import cut

SLOTS = [f"c{i}" for i in range(8)]


def scene_bbox(points: DataFrame) -> DataFrame:
    return points.agg(*(f(a).cast("double").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def voxelize(points: DataFrame, levels: int, box: list[tuple[float, float]] | None = None, cube: bool = False, mode: str = "clamp") -> DataFrame:
    """Distinct Morton keys of points (x, y, z).

    box: the range of each axis (by default the data's). cube: one cell size for all axes, from the longest, around the
    centre. mode 'clamp' keeps points on the upper faces in the last cell, 'reference' drops them. Null coordinates drop.
    """
    if box is None:
        r = scene_bbox(points).first()
        if r is None or r["min_x"] is None:
            return points.sparkSession.createDataFrame([], "morton long")
        box = [(r[f"min_{a}"], r[f"max_{a}"]) for a in "xyz"]
    if cube:
        side = max(hi - lo for lo, hi in box) or 1.0
        box = [((lo + hi - side) / 2, (lo + hi + side) / 2) for lo, hi in box]
    n = 1 << levels
    cells = []
    for a, (lo, hi) in zip("xyz", box):
        v = F.col(a).cast("double")
        cells.append(F.floor((v - F.lit(float(lo))) / F.lit(float(hi - lo) or 1.0) * n))
    rows = points.select(*(c.alias(a) for c, a in zip(cells, "xyz"))).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if mode == "reference":
        rows = rows.where(" AND ".join(f"{a} >= 0 AND {a} < {n}" for a in "xyz"))
    clamp = lambda a: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(a)))
    return rows.select(interleave(clamp("x"), clamp("y"), clamp("z"), levels).alias("morton")).distinct()


def svo(voxels: DataFrame, levels: int) -> DataFrame:
    """One row for each node: level, key, child_mask. Each level is rolled up from the one below."""
    below = voxels.select(F.col("morton").alias("key"))
    out = None
    for level in range(levels - 1, -1, -1):
        row = below.groupBy(prefix(F.col("key"), 1).alias("key")).agg(F.bit_or(bit(F.col("key"))).cast("int").alias("child_mask"))
        row = cut(row.select(F.lit(level).alias("level"), "key", "child_mask"), "svo")
        out = row if out is None else out.unionByName(row)
        below = row.select("key")
    return out


@dataclass
class Dag:
    """nodes: level, node_id, child_mask, c0..c7 (node ids one level down, -1: none; at the last level -1 throughout).
    cells: level, key, node_id: which node stands for an octree cell."""

    nodes: DataFrame
    cells: DataFrame
    levels: int


def dag(voxels: DataFrame, levels: int) -> Dag:
    """Hash-consing from the last level up: nodes with the same children become the one with the smallest key."""
    leaves = voxels.groupBy(prefix(F.col("morton"), 1).alias("key")).agg(F.bit_or(bit(F.col("morton"))).cast("int").alias("child_mask"))
    none = [F.lit(-1).cast("long").alias(c) for c in SLOTS]
    nodes = cells = None
    rows = cut(leaves.select("key", "child_mask", *none), "children")
    for level in range(levels - 1, -1, -1):
        own = cut(rows.groupBy("child_mask", *SLOTS).agg(F.min("key").alias("node_id")), "nodes")
        cell = cut(rows.join(own, ["child_mask", *SLOTS]).select(F.lit(level).alias("level"), "key", "node_id"), "cells")
        own = own.select(F.lit(level).alias("level"), "node_id", "child_mask", *SLOTS)
        nodes = own if nodes is None else nodes.unionByName(own)
        cells = cell if cells is None else cells.unionByName(cell)
        if level:
            at = slot(F.col("key"))
            child = [F.coalesce(F.max(F.when(at == i, F.col("node_id"))), F.lit(-1)).alias(c) for i, c in enumerate(SLOTS)]
            mask = F.bit_or(bit(F.col("key"))).cast("int").alias("child_mask")
            rows = cut(cell.groupBy(prefix(F.col("key"), 1).alias("key")).agg(mask, *child), "children")
    return Dag(nodes, cells, levels)


def edges(nodes: DataFrame) -> DataFrame:
    """nodes unpivoted: level, node_id, slot, child_id."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.col(c).alias("child_id")) for i, c in enumerate(SLOTS)))).alias("e")
    return nodes.select("level", "node_id", pairs).select("level", "node_id", "e.slot", "e.child_id").where("child_id >= 0")


def expand(d: Dag) -> DataFrame:
    """The voxels of a DAG, from the root down."""
    e = edges(d.nodes)
    front = d.nodes.where("level = 0").select("node_id", F.lit(0).cast("long").alias("key"))
    for level in range(d.levels - 1):
        step = e.where(F.col("level") == level).select("node_id", "slot", "child_id")
        front = front.join(step, "node_id").select(F.col("child_id").alias("node_id"), (F.col("key") * 8 + F.col("slot")).alias("key"))
    last = d.nodes.where(F.col("level") == d.levels - 1).select("node_id", "child_mask")
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")
    return front.join(last, "node_id").select("key", slots).select((F.col("key") * 8 + F.col("slot")).alias("morton"))


def ref_counts(d: Dag) -> DataFrame:
    """level, node_id, refs (pointers to it), paths (ways from the root; 1 for the root)."""
    e = cut(edges(d.nodes), "edges")
    out = d.nodes.where("level = 0").select("level", "node_id", F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("paths"))
    front = out
    for level in range(d.levels - 1):
        step = front.join(e.where(F.col("level") == level).drop("level"), "node_id")
        front = cut(step.groupBy(F.col("child_id").alias("node_id")).agg(F.count("*").alias("refs"), F.sum("paths").alias("paths")).select(F.lit(level + 1).alias("level"), "node_id", "refs", "paths"), "refs")
        out = out.unionByName(front)
    return out


#: At 8 * stabiliser + mirror: the smallest mirror that does the same to a node with that stabiliser.
_LEAST = "".join(str(min((m ^ s for s in range(8) if stab >> s & 1), default=m)) for stab in range(256) for m in range(8))


def _least_mirror(m: Column, stabiliser: Column) -> Column:
    return F.substr(F.lit(_LEAST), 8 * stabiliser + m + 1, F.lit(1)).cast("int")


def sdag(voxels: DataFrame, levels: int) -> DataFrame:
    """level, node_id, refs array: nodes up to mirrors. A child is 8 * node_id + mirror, or -1; at the last level a bit.

    A cell is the mirror image of its node; a node's stabiliser (which mirrors leave it as it is) makes a child's mirror
    unique, so mirrored cells meet in one canonical row whatever their depth.
    """
    at = slot(F.col("key"))
    rows = voxels.select(F.col("morton").alias("key"))
    child = [F.coalesce(F.max(F.when(at == i, F.lit(1).cast("long"))), F.lit(-1)).alias(c) for i, c in enumerate(SLOTS)]
    rows = cut(rows.groupBy(prefix(F.col("key"), 1).alias("key")).agg(*child), "children").withColumns({f"s{i}": F.lit(255) for i in range(8)})
    out = None
    for level in range(levels - 1, -1, -1):
        variants = []
        for g in range(8):
            ref = [F.col(SLOTS[i ^ g]) for i in range(8)]
            if level < levels - 1:
                ref = [F.when(r < 0, r).otherwise(r - r % 8 + _least_mirror((r % 8).cast("int").bitwiseXOR(F.lit(g)), F.col(f"s{i ^ g}"))) for i, r in enumerate(ref)]
            variants.append(F.array(*ref))
        rows = cut(rows.select("key", *(v.alias(f"v{g}") for g, v in enumerate(variants))), "variants")
        # Nothing tells the root's mirror, so it stays as it is.
        best = F.least(*(F.struct(F.col(f"v{g}").alias("refs"), F.lit(g).alias("mirror")) for g in range(8))) if level else F.struct(F.col("v0").alias("refs"), F.lit(0).alias("mirror"))
        keep = F.lit(0)
        for g in range(8):
            keep = keep + F.when(F.col(f"v{g}") == F.col("v0"), F.lit(1 << g)).otherwise(0)
        rows = rows.select("key", best.alias("b"), keep.alias("stab")).select("key", "b.refs", "b.mirror", "stab")
        own = cut(rows.groupBy("refs").agg(F.min("key").alias("node_id")), "sdag")
        cells = cut(rows.join(own, "refs").select("key", "node_id", "mirror", "stab"), "cells")
        own = own.select(F.lit(level).alias("level"), "node_id", "refs")
        out = own if out is None else out.unionByName(own)
        if level:
            child = [F.coalesce(F.max(F.when(at == i, F.col("node_id") * 8 + _least_mirror(F.col("mirror"), F.col("stab")))), F.lit(-1)).alias(c) for i, c in enumerate(SLOTS)]
            stabs = [F.coalesce(F.max(F.when(at == i, F.col("stab"))), F.lit(255)).cast("int").alias(f"s{i}") for i in range(8)]
            rows = cut(cells.groupBy(prefix(F.col("key"), 1).alias("key")).agg(*child, *stabs), "children")
    return out


def subtree_keys(d: Dag, depth: int) -> DataFrame:
    """level, node_id, subtree: an exact name (text) of the top `depth` + 1 levels below each node."""
    names = d.nodes.select("level", "node_id", F.col("child_mask").cast("string").alias("subtree"))
    e = cut(edges(d.nodes), "edges")
    for _ in range(depth):
        named = e.join(names.select((F.col("level") - 1).alias("level"), F.col("node_id").alias("child_id"), "subtree"), ["level", "child_id"])
        joined = named.groupBy("level", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "subtree"))), lambda s: F.concat(s["slot"].cast("string"), F.lit(":"), s["subtree"])), ",").alias("inner"))
        names = cut(d.nodes.select("level", "node_id", "child_mask").join(joined, ["level", "node_id"], "left").select("level", "node_id", F.concat(F.col("child_mask").cast("string"), F.lit("("), F.coalesce("inner", F.lit("")), F.lit(")")).alias("subtree")), "names")
    return names


def svdag_addresses(d: Dag) -> DataFrame:
    """level, node_id, size in words, address: level by level in the order of node_id."""
    size = F.when(F.col("level") == d.levels - 1, F.lit(1).cast("long")).otherwise(1 + bits(F.col("child_mask")))
    rows = d.nodes.select("level", "node_id", "child_mask", size.alias("size"))
    return running_sum(rows, ["level", "node_id"], "size", "address").select("level", "node_id", "child_mask", "size", "address")


def svdag_words(d: Dag) -> DataFrame:
    """address, word: a node's mask, then its children's addresses from slot 7 down."""
    a = cut(svdag_addresses(d), "addresses")
    child = a.select((F.col("level") - 1).alias("level"), F.col("node_id").alias("child_id"), F.col("address").alias("word"))
    e = edges(d.nodes).join(child, ["level", "child_id"]).join(a.select("level", "node_id", "address", "child_mask"), ["level", "node_id"])
    # The place of a slot: one more than the number of children above it.
    above = F.bit_count(F.expr("shiftright(child_mask, slot + 1)"))
    return a.select("address", F.col("child_mask").cast("long").alias("word")).unionByName(e.select((F.col("address") + 1 + above).alias("address"), "word"))
