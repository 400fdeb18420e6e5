"""Similarity edges between nodes, components, Markov clusters and representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.operators.octree import SLOTS, Dag, edges
from octolith.operators.order import running_mean
from octolith.storage import cut


def leaf_keys(d: Dag) -> DataFrame:
    """node_id, k: the eight leaf masks of each node of the last level but one in 64 bits, slot 0 highest."""
    e = edges(d.nodes.where(F.col("level") == d.levels - 2))
    leaf = d.nodes.where(F.col("level") == d.levels - 1).select(F.col("node_id").alias("child_id"), "child_mask")
    part = F.expr("shiftleft(cast(child_mask as bigint), 8 * (7 - slot))")
    return e.join(leaf, "child_id").groupBy("node_id").agg(F.bit_or(part).alias("k"))


def hamming1_pairs(keys: DataFrame) -> DataFrame:
    """Pairs src > dst of nodes whose keys differ in one bit: each of 64 flips of one side is looked up on the other."""
    flips = F.expr("transform(sequence(0, 63), i -> k ^ shiftleft(1L, i))")
    probe = keys.select(F.col("node_id").alias("src"), F.explode(flips).alias("k"))
    return probe.join(keys.select(F.col("node_id").alias("dst"), "k"), "k").where("src > dst").select("src", "dst")


def components(pairs: DataFrame) -> DataFrame:
    """node_id, component: the smallest id that edges (src, dst) lead to, by spreading labels and jumping over them."""
    both = cut(pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct(), "both")
    labels = cut(both.groupBy(F.col("src").alias("node_id")).agg(F.least("src", F.min("dst")).alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node_id").alias("dst"), F.col("component").alias("near")), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("near").alias("near"))
        jump = labels.join(labels.select(F.col("node_id").alias("component"), F.col("component").alias("far")), "component").join(near, "node_id")
        labels = cut(jump.select("node_id", F.least("near", "far").alias("new"), "component").select("node_id", F.col("new").alias("component"), (F.col("new") < F.col("component")).alias("moved")), "labels")
    return labels.select("node_id", "component")


def representatives(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, node_id of the member with most weight inside its cluster; ties to the smallest id.

    pairs (src, dst, weight), clusters (node_id, cluster). A cluster without an inner edge has its smallest member.
    """
    a = clusters.select(F.col("node_id").alias("src"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node_id").alias("dst"), F.col("cluster").alias("cb"))
    inner = pairs.join(a, "src").join(b, "dst").where("ca = cb")
    weight = inner.select(F.explode(F.array("src", "dst")).alias("node_id"), "weight").groupBy("node_id").agg(F.sum("weight").alias("w"))
    rows = clusters.join(weight, "node_id", "left").select("cluster", "node_id", F.coalesce("w", F.lit(0.0)).alias("w"))
    return rows.groupBy("cluster").agg(F.max(F.struct("w", (-F.col("node_id")).alias("m"))).alias("b")).select("cluster", (-F.col("b.m")).alias("node_id"))


#: Smaller values of a flow are put to nought (a column's largest always stay), and a flow that moves by less has ended.
LEAST = 1e-6
#: Values are rounded, so that the order of sums doesn't decide between equal attractors.
DIGITS = 12


def _markov(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, inflation: float) -> np.ndarray:
    m = np.eye(n)
    m[src, dst] = m[dst, src] = weight
    m /= m.sum(0)
    for _ in range(100):
        new = (m @ m) ** inflation
        top = new.max(0)
        new[new < np.where(top < LEAST, LEAST * top, LEAST)] = 0
        new = np.round(new / new.sum(0), DIGITS)
        if np.abs(new - m).max() < LEAST:
            break
        m = new
    return m.argmax(0)  # the attractor of each node


def _markov_joins(pairs: DataFrame, inflation: float) -> DataFrame:
    """The same as joins on (component, row, col, value) for pairs (component, src, dst, weight); node_id, cluster."""
    ends = [F.struct(F.col(a).alias("row"), F.col(b).alias("col"), w.alias("weight")) for a, b, w in (("src", "dst", F.col("weight").cast("double")), ("dst", "src", F.col("weight").cast("double")), ("src", "src", F.lit(None).cast("double")), ("dst", "dst", F.lit(None).cast("double")))]
    rows = pairs.select("component", F.explode(F.array(*ends)).alias("e")).groupBy("component", "e.row", "e.col").agg(F.coalesce(F.max("e.weight"), F.lit(1.0)).alias("value"))
    column = Window.partitionBy("col")
    m = cut(rows.withColumn("value", F.col("value") / F.sum("value").over(column)), "flow")
    ended = []
    for _ in range(100):
        left = m.select("component", "row", F.col("col").alias("k"), F.col("value").alias("x"))
        right = m.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
        new = left.join(right, "k").groupBy("component", "row", "col").agg(F.pow(F.sum(F.col("x") * F.col("y")), F.lit(inflation)).alias("new"))
        new = new.withColumn("top", F.max("new").over(column)).where(F.col("new") >= F.when(F.col("top") < LEAST, LEAST * F.col("top")).otherwise(LEAST))
        new = new.select("component", "row", "col", F.round(F.col("new") / F.sum("new").over(column), DIGITS).alias("new"))
        both = cut(m.join(new, ["component", "row", "col"], "full"), "flow")
        moved = F.max(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("value", F.lit(0.0)))) >= LEAST
        state = cut(both.groupBy("component").agg(moved.alias("moved")), "moved")
        rest = state.where("moved").select("component")
        if state.where("NOT moved").limit(1).count():
            ended.append(m.join(rest, "component", "left_anti"))
        if not rest.limit(1).count():
            break
        m = both.join(rest, "component", "left_semi").where("new > 0").select("component", "row", "col", F.col("new").alias("value"))
    else:
        ended.append(m)
    flow = ended[0]
    for e in ended[1:]:
        flow = flow.unionByName(e)
    # The attractor of each node; ties to the smallest.
    to = cut(flow.groupBy("col").agg(F.max(F.struct("value", (-F.col("row")).alias("m"))).alias("b")).select(F.col("col").alias("node_id"), F.col("b.m").alias("to")), "to")
    return to.join(to.groupBy("to").agg(F.min("node_id").alias("cluster")), "to").select("node_id", "cluster")


def markov_clusters(pairs: DataFrame, inflation: float = 2.0, most: int = 2000) -> DataFrame:
    """node_id, cluster (its smallest member): expansion and inflation of each component's flow, self loops added.

    Components of more than `most` nodes, whose matrix would be too large for a task, go through joins by the same law.
    """
    parts = cut(components(pairs), "components")
    large = parts.groupBy("component").count().where(F.col("count") > most).select("component")
    rows = pairs.join(parts.withColumnRenamed("node_id", "src"), "src").join(large, "component", "left_anti")

    def flow(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, index = np.unique(np.r_[pdf["src"], pdf["dst"]], return_inverse=True)
        to = _markov(len(ids), index[: len(pdf)], index[len(pdf) :], pdf["weight"].to_numpy(float), inflation)
        out = pd.DataFrame({"node_id": ids, "to": to})
        out["cluster"] = out.groupby("to")["node_id"].transform("min")
        return out[["node_id", "cluster"]]

    out = rows.groupBy("component").applyInPandas(flow, "node_id long, cluster long")
    if large.limit(1).count():
        wide = pairs.join(parts.withColumnRenamed("node_id", "src"), "src").join(large, "component", "left_semi")
        out = out.unionByName(_markov_joins(wide, inflation))
    return out


def lossy(d: Dag, inflation: float = 2.0, most_refs: int = 1) -> tuple[Dag, DataFrame]:
    """merging.lossy_dag without its losses."""
    from octolith.operators.merging import lossy_dag

    return lossy_dag(d, inflation, most_refs=most_refs)[:2]


def subtree_diff(d: Dag, pairs: DataFrame, level: int) -> DataFrame:
    """pairs (a, b) of nodes at `level`: diff, the voxels in which their sub-trees differ; a side may lack a child."""
    front = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
    for lv in range(level, d.levels - 1):
        n = d.nodes.where(F.col("level") == lv)
        left = n.select(F.col("node_id").alias("x"), F.array(*SLOTS).alias("cx"))
        right = n.select(F.col("node_id").alias("y"), F.array(*SLOTS).alias("cy"))
        both = front.join(left, "x", "left").join(right, "y", "left")
        none = F.array(*[F.lit(-1).cast("long")] * 8)
        kids = both.select("a", "b", F.explode(F.arrays_zip(F.coalesce("cx", none).alias("cx"), F.coalesce("cy", none).alias("cy"))).alias("k"))
        front = cut(kids.select("a", "b", F.col("k.cx").alias("x"), F.col("k.cy").alias("y")).where("x <> y"), "front")
    leaf = d.nodes.where(F.col("level") == d.levels - 1)
    both = front.join(leaf.select(F.col("node_id").alias("x"), F.col("child_mask").alias("mx")), "x", "left").join(leaf.select(F.col("node_id").alias("y"), F.col("child_mask").alias("my")), "y", "left")
    diff = both.groupBy("a", "b").agg(F.sum(F.bit_count(F.coalesce("mx", F.lit(0)).bitwiseXOR(F.coalesce("my", F.lit(0))))).alias("diff"))
    return pairs.select("a", "b").join(diff, ["a", "b"], "left").select("a", "b", F.coalesce("diff", F.lit(0)).cast("long").alias("diff"))


def size_histogram(clusters: DataFrame, width: int = 5, bins: int = 16) -> DataFrame:
    n = clusters.groupBy("component").agg(F.count("*").alias("n"))
    return n.groupBy(F.least(F.floor(F.col("n") / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("components"))


def smoothed(keys: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Walkthrough keys (key_idx without gaps) averaged over n consecutive ones; only complete frames."""
    return running_mean(keys, "key_idx", columns, n)
