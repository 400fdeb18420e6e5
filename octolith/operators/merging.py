"""Lossy reduction of a graph of distinct nodes level by level, and merging of sub-trees across levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import bits
from octolith.operators.clusters import hamming1_pairs, leaf_keys, markov_clusters, representatives
from octolith.operators.octree import SLOTS, Dag, edges, ref_counts
from octolith.storage import cut


def _pointed(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """nodes with their children replaced as in `to` (node_id, new); children that aren't in it stay."""
    e = F.explode(F.array(*(F.struct(F.lit(i).alias("slot"), F.col(c).alias("child")) for i, c in enumerate(SLOTS)))).alias("e")
    rows = nodes.select("node_id", "child_mask", e).select("node_id", "child_mask", "e.slot", "e.child")
    rows = rows.join(to.select(F.col("node_id").alias("child"), "new"), "child", "left").withColumn("child", F.coalesce("new", "child"))
    return rows.groupBy("node_id", "child_mask").agg(*(F.max(F.when(F.col("slot") == i, F.col("child"))).alias(c) for i, c in enumerate(SLOTS)))


def tops(d: Dag, level: int, depth: int) -> DataFrame:
    """node_id, top for the nodes of a level: equal tops for equal child masks in `depth` levels from there on.

    top is the smallest node_id with these masks, found from below by grouping, so it needs no hash.
    """
    below = None
    for at in range(level + depth - 1, level - 1, -1):
        nodes = d.nodes.where(F.col("level") == at).drop("level")
        if below is not None:
            nodes = _pointed(nodes, below.select("node_id", F.col("top").alias("new")))
        same = ["child_mask", *(SLOTS if below is not None else [])]
        least = nodes.groupBy(*same).agg(F.min("node_id").alias("top"))
        below = cut(nodes.join(least, same).select("node_id", "top"), "tops")
    return below


def differences(d: Dag, pairs: DataFrame, level: int) -> DataFrame:
    """pairs (a, b) of nodes at `level`: diff, the voxels in which their sub-trees differ, leaves, the leaves compared, and veto.

    veto: some leaf differs in more than 4 voxels, or above the last level but one only one side has a child.
    """
    front = cut(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), "front")
    veto = None
    for lv in range(level, d.levels - 1):
        n = d.nodes.where(F.col("level") == lv)
        both = front.join(n.select(F.col("node_id").alias("x"), F.array(*SLOTS).alias("cx")), "x").join(n.select(F.col("node_id").alias("y"), F.array(*SLOTS).alias("cy")), "y")
        kids = both.select("a", "b", F.explode(F.arrays_zip("cx", "cy")).alias("k")).select("a", "b", F.col("k.cx").alias("x"), F.col("k.cy").alias("y")).where("x >= 0 OR y >= 0")
        if lv < d.levels - 2:
            kids = cut(kids, "kids")
            one = kids.where("x < 0 OR y < 0").select("a", "b").distinct()
            veto = one if veto is None else veto.unionByName(one)
            kids = kids.where("x >= 0 AND y >= 0")
        front = cut(kids, "front")
    leaf = d.nodes.where(F.col("level") == d.levels - 1)
    both = front.join(leaf.select(F.col("node_id").alias("x"), F.col("child_mask").alias("mx")), "x", "left").join(leaf.select(F.col("node_id").alias("y"), F.col("child_mask").alias("my")), "y", "left")
    own = F.bit_count(F.coalesce("mx", F.lit(0)).bitwiseXOR(F.coalesce("my", F.lit(0))))
    out = both.groupBy("a", "b").agg(F.sum(own).cast("long").alias("diff"), F.count("*").alias("leaves"), F.max(own > 4).alias("veto"))
    if veto is not None:
        out = out.join(veto.distinct().withColumn("one", F.lit(True)), ["a", "b"], "left").withColumn("veto", F.col("veto") | F.coalesce("one", F.lit(False))).drop("one")
    return pairs.select("a", "b").join(out, ["a", "b"], "left").na.fill({"diff": 0, "leaves": 0, "veto": False})


def most_different(levels: int, level: int, factor: float) -> int:
    """How many voxels sub-trees of a level may differ in."""
    return int((levels - level) ** 2 * factor + 0.5)


def similar_pairs(d: Dag, level: int, eligible: DataFrame, factor: float = 1.0) -> DataFrame:
    """Pairs src > dst of eligible nodes (node_id) of a level, diff, and weight (1: alike).

    At the last level but one, those that differ in one voxel; above it, those with equal masks but for the leaves that
    differ in few enough voxels.
    """
    if level == d.levels - 2:
        pairs = hamming1_pairs(cut(leaf_keys(d).join(eligible, "node_id"), "keys"))
        return pairs.select("src", "dst", F.lit(1).cast("long").alias("diff"), F.lit(1.0).alias("weight"))
    most = most_different(d.levels, level, factor)
    top = cut(tops(d, level, d.levels - level - 1).join(eligible, "node_id"), "eligible")
    pairs = top.select("top", F.col("node_id").alias("a")).join(top.select("top", F.col("node_id").alias("b")), "top").where("a > b").select("a", "b")
    near = differences(d, cut(pairs, "pairs"), level).where(~F.col("veto") & (F.col("diff") <= most) & (F.col("diff") < 4 * F.col("leaves")))
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"), "diff", (1 - F.col("diff") / (most + 1.0)).alias("weight"))


def consed(d: Dag) -> Dag:
    """Nodes that became equal are one again, from the last level up; nodes that nothing leads to any more go."""
    nodes, to, out = None, None, []
    for level in range(d.levels - 1, -1, -1):
        nodes = d.nodes.where(F.col("level") == level).drop("level")
        if to is not None:
            nodes = _pointed(nodes, to)
        nodes = cut(nodes, "nodes")
        least = nodes.groupBy("child_mask", *SLOTS).agg(F.min("node_id").alias("new"))
        to = cut(nodes.join(least, ["child_mask", *SLOTS]).select("node_id", "new"), "same")
        out.append(least.select(F.lit(level).alias("level"), F.col("new").alias("node_id"), "child_mask", *SLOTS))
    every = cut(out[0].unionByName(out[1]) if d.levels == 2 else _union(out), "consed")
    keep = every.where("level = 0")
    kept = [keep]
    for level in range(1, d.levels):
        used = edges(keep).select(F.col("child_id").alias("node_id")).distinct()
        keep = cut(every.where(F.col("level") == level).join(used, "node_id", "left_semi"), "kept")
        kept.append(keep)
    return Dag(_union(kept), d.cells, d.levels)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lossy_dag(d: Dag, inflation: float = 2.0, factor: float = 1.0, most_refs: int = 1) -> tuple[Dag, DataFrame, DataFrame]:
    """The graph with similar nodes merged from the last level but one up to level 1, replacements and losses.

    At each level, nodes with at most `most_refs` ways from the root (in the graph given) that aren't above a node that
    replaces others are joined to similar ones, clustered by their weights, and replaced by the representative of their
    cluster before the next level is looked at. Replacements: level, node_id, new. Losses: level, clusters, replaced,
    voxels: over the nodes replaced, the voxels in which they differ (at most the level's bound) for each way to them.
    """
    ways = cut(ref_counts(d).select("level", "node_id", "paths"), "ways")
    now, held, replaced, lost = d, None, [], []
    for level in range(d.levels - 2, 0, -1):
        own = now.nodes.where(F.col("level") == level)
        rare = ways.where((F.col("level") == level) & (F.col("paths") <= most_refs)).select("node_id")
        above = None
        if held is not None:  # nodes above representatives stay as they are
            above = cut(edges(own).join(held.select(F.col("node_id").alias("child_id")), "child_id", "left_semi").select("node_id").distinct(), "above")
            rare = rare.join(above, "node_id", "left_anti")
        near = cut(similar_pairs(now, level, cut(rare, "rare"), factor), "similar")
        found = cut(markov_clusters(near.select("src", "dst", "weight"), inflation), "clusters")
        lead = representatives(near.select("src", "dst", "weight"), found).select("cluster", F.col("node_id").alias("new"))
        member = cut(found.join(lead, "cluster"), "members")
        to = cut(member.where("node_id <> new").select("node_id", "new"), "to")
        most = most_different(d.levels, level, factor)
        gone = differences(now, to.select(F.col("new").alias("a"), F.col("node_id").alias("b")), level).join(ways.where(F.col("level") == level).select(F.col("node_id").alias("b"), "paths"), "b")
        each = F.when(F.col("veto"), F.lit(most)).otherwise(F.least("diff", F.lit(most))) * F.col("paths")
        voxels = gone.agg(F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("voxels"), F.count("*").alias("replaced"))
        lost.append(cut(member.agg(F.countDistinct("cluster").alias("clusters")).crossJoin(voxels).select(F.lit(level).alias("level"), "clusters", "replaced", "voxels"), "lost"))
        replaced.append(to.select(F.lit(level).alias("level"), "node_id", "new"))
        rest = own.join(to, "node_id", "left_anti")
        up = now.nodes.where(F.col("level") == level - 1)
        parents = _pointed(up.drop("level"), to).select(F.lit(level - 1).alias("level"), "node_id", "child_mask", *SLOTS)
        others = now.nodes.where((F.col("level") != level) & (F.col("level") != level - 1))
        now = Dag(cut(_union([others, rest.select(others.columns), parents.select(others.columns)]), "nodes"), d.cells, d.levels)
        held = member.select(F.col("new").alias("node_id")).distinct()
        held = cut(held if above is None else held.union(above).distinct(), "held")
    return consed(now), _union(replaced), _union(lost)


# ---- across levels: pointers are level, node_id, slot, child_level, child_id; leaves level, node_id, child_mask ----


@dataclass
class Linked:
    """A graph whose pointers name a level: nodes (level, node_id, child_mask) and pointers between them."""

    nodes: DataFrame
    pointers: DataFrame
    levels: int


def linked(d: Dag) -> Linked:
    """A graph with the next level written down as each pointer's."""
    e = edges(d.nodes).select("level", "node_id", "slot", (F.col("level") + 1).alias("child_level"), "child_id")
    return Linked(d.nodes.select("level", "node_id", "child_mask"), e, d.levels)


def _named(level: Column, node: Column) -> Column:
    """A node of any level as one number; a level has fewer than 2 ** 57 keys up to 19 levels above it."""
    return node * 32 + level


def shapes(g: Linked) -> dict[int, DataFrame]:
    """For each depth, level, node_id, shape of the nodes with so many levels below: equal shapes for equal masks down to there."""
    nodes = g.nodes.where("level > 0")
    out, shape = {}, None
    for depth in range(1, g.levels):
        some = nodes.where(F.col("level") <= g.levels - depth)
        if shape is None:
            rows, same = some, ["child_mask"]
        else:
            child = shape.select(F.col("level").alias("child_level"), F.col("node_id").alias("child_id"), F.col("shape").alias("c"))
            kids = g.pointers.join(child, ["child_level", "child_id"]).groupBy("level", "node_id").agg(*(F.coalesce(F.max(F.when(F.col("slot") == i, F.col("c"))), F.lit(-1)).alias(c) for i, c in enumerate(SLOTS)))
            rows, same = some.join(kids, ["level", "node_id"]), ["child_mask", *SLOTS]
        least = rows.groupBy(*same).agg(F.min(_named(F.col("level"), F.col("node_id"))).alias("shape"))
        shape = cut(rows.join(least, same).select("level", "node_id", "shape"), "shapes")
        out[depth] = shape
    return out


def cross_level_matches(d: Dag) -> DataFrame:
    """level, node_id, to_level, to_id: nodes whose whole sub-tree is the top of one at a higher level.

    Level 1 is looked at first, then the children of nodes without a match. The highest level wins, then the smallest id.
    """
    g = linked(d)
    of, found = shapes(g), []
    look = cut(g.nodes.where("level = 1").select("node_id"), "look")
    for level in range(1, d.levels):
        shape = of[d.levels - level]
        if level > 1:
            first = shape.where(F.col("level") < level).groupBy("shape").agg(F.min(F.struct(F.col("level").alias("to_level"), F.col("node_id").alias("to_id"))).alias("t"))
            own = shape.where(F.col("level") == level).join(look, "node_id", "left_semi")
            found.append(cut(own.join(first, "shape").select("level", "node_id", "t.to_level", "t.to_id"), "matches"))
            look = look.join(found[-1], "node_id", "left_anti")
        if level < d.levels - 1:
            down = g.pointers.where(F.col("level") == level).join(look, "node_id", "left_semi")
            look = cut(down.select(F.col("child_id").alias("node_id")).distinct(), "look")
    return _union(found)


def merge_levels(d: Dag) -> Linked:
    """The graph without the nodes that are the top of others: pointers to them go to where their match stands.

    What hangs below a matched node goes with it, each node to its counterpart below the match (of several, a match of its
    own or else the highest, then the smallest id). Targets that go themselves are followed on. Nodes that nothing leads
    to any more go too. A walk ends after as many nodes as there are levels, so pointers may lead back up.
    """
    g = linked(d)
    direct = cut(cross_level_matches(d).withColumn("rank", F.lit(0)), "matches")
    every = [direct]
    front = direct.drop("rank")
    kid = cut(g.pointers.select("level", "node_id", "slot", "child_id"), "kids")
    for _ in range(d.levels - 2):  # the counterparts of what hangs below
        right = kid.select(F.col("level").alias("to_level"), F.col("node_id").alias("to_id"), "slot", F.col("child_id").alias("to_child"))
        front = cut(front.join(kid, ["level", "node_id"]).join(right, ["to_level", "to_id", "slot"]).select((F.col("level") + 1).alias("level"), F.col("child_id").alias("node_id"), (F.col("to_level") + 1).alias("to_level"), F.col("to_child").alias("to_id")).distinct(), "counterparts")
        every.append(front.withColumn("rank", F.lit(1)))
    moved = _union(every).groupBy("level", "node_id").agg(F.min(F.struct("rank", "to_level", "to_id")).alias("t")).select("level", "node_id", "t.to_level", "t.to_id")
    moved = cut(moved, "moved")
    while True:  # a target that goes itself is replaced by its own
        on = moved.select(F.col("level").alias("to_level"), F.col("node_id").alias("to_id"), F.col("to_level").alias("next_level"), F.col("to_id").alias("next_id"))
        both = cut(moved.join(on, ["to_level", "to_id"], "left"), "moved")
        if not both.where("next_id IS NOT NULL").limit(1).count():
            break
        moved = cut(both.select("level", "node_id", F.coalesce("next_level", "to_level").alias("to_level"), F.coalesce("next_id", "to_id").alias("to_id")), "moved")
    to = moved.select(F.col("level").alias("child_level"), F.col("node_id").alias("child_id"), "to_level", "to_id")
    p = g.pointers.join(to, ["child_level", "child_id"], "left")
    pointers = cut(p.select("level", "node_id", "slot", F.coalesce("to_level", "child_level").alias("child_level"), F.coalesce("to_id", "child_id").alias("child_id")).join(moved, ["level", "node_id"], "left_anti"), "pointers")
    seen = cut(g.nodes.where("level = 0").select("level", "node_id"), "seen")
    front = seen
    for _ in range(2 * d.levels):
        front = front.join(pointers, ["level", "node_id"]).select(F.col("child_level").alias("level"), F.col("child_id").alias("node_id")).distinct()
        front = cut(front.join(seen, ["level", "node_id"], "left_anti"), "front")
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front), "seen")
    return Linked(g.nodes.join(seen, ["level", "node_id"], "left_semi"), pointers.join(seen, ["level", "node_id"], "left_semi"), d.levels)


def expand_linked(g: Linked) -> DataFrame:
    """The voxels of a graph whose pointers name levels: walks of as many nodes as there are levels."""
    front = g.nodes.where("level = 0").select("level", "node_id", F.lit(0).cast("long").alias("key"))
    for _ in range(g.levels - 1):
        front = front.join(g.pointers, ["level", "node_id"]).select(F.col("child_level").alias("level"), F.col("child_id").alias("node_id"), (F.col("key") * 8 + F.col("slot")).alias("key"))
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")
    return front.join(g.nodes, ["level", "node_id"]).select("key", slots).select((F.col("key") * 8 + F.col("slot")).alias("morton"))


def integrity(d: Dag) -> DataFrame:
    """fault, level, node_id: nodes without children, masks that disagree with pointers, pointers to nothing, nodes that nothing leads to."""
    inner = F.col("level") < d.levels - 1
    n = cut(d.nodes, "nodes")
    e = cut(edges(n.where(inner)), "edges")
    mask = F.expr("aggregate(array(" + ", ".join(SLOTS) + "), named_struct('m', 0, 'i', 0), (s, c) -> named_struct('m', s.m | IF(c >= 0, shiftleft(1, s.i), 0), 'i', s.i + 1)).m")
    empty = n.where("child_mask = 0").select(F.lit("empty").alias("fault"), "level", "node_id")
    torn = n.where(inner & (mask != F.col("child_mask"))).select(F.lit("mask").alias("fault"), "level", "node_id")
    there = n.select((F.col("level") - 1).alias("level"), F.col("node_id").alias("child_id"))
    dangling = e.join(there, ["level", "child_id"], "left_anti").select(F.lit("dangling").alias("fault"), "level", "node_id").distinct()
    used = e.select((F.col("level") + 1).alias("level"), F.col("child_id").alias("node_id")).distinct()
    lost = n.where("level > 0").select("level", "node_id").join(used, ["level", "node_id"], "left_anti").select(F.lit("unreferenced").alias("fault"), "level", "node_id")
    return _union([empty, torn, dangling, lost])


def subtree_voxels(d: Dag) -> DataFrame:
    """level, node_id, voxels below each node, from the last level up."""
    below = d.nodes.where(F.col("level") == d.levels - 1).select("level", "node_id", bits(F.col("child_mask")).alias("voxels"))
    out = [below]
    for level in range(d.levels - 2, -1, -1):
        e = edges(d.nodes.where(F.col("level") == level)).join(below.select(F.col("node_id").alias("child_id"), "voxels"), "child_id")
        below = cut(e.groupBy("level", "node_id").agg(F.sum("voxels").alias("voxels")), "voxels")
        out.append(below)
    return _union(out)


def renumbered(d: Dag, refs: DataFrame, by: str = "refs") -> DataFrame:
    """level, node_id, rank within the level (from 0): most references (or ways, by="paths") first, then the smallest id."""
    from octolith.operators.order import running_sum

    rows = running_sum(refs.select("level", "node_id", (-F.col(by)).alias("rarity"), F.lit(1).cast("long").alias("one")), ["level", "rarity", "node_id"], "one", "place")
    first = rows.groupBy("level").agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(first), "level").select("level", "node_id", (F.col("place") - F.col("first")).alias("rank"))
