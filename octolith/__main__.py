"""python -m octolith SCENE LEVELS OUT...: a mesh (.obj) or a point table (Parquet with x, y, z) to encoded octrees.

Outputs go by their ending: .svo, .svdag, .ussvdag, .ssvdag (with mirrors) or .esvdag (without). A .svdag file can be the
scene as well. --lossy merges similar sub-trees first, --cross-level merges across levels and prints what is left;
--stats appends the figures to a Parquet table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.operators import encodings, merging, octree, search
from octolith.sources import files, meshes
from octolith.storage import cut


def scene(spark: SparkSession, path: str, levels: int) -> tuple[DataFrame, dict]:
    """The voxels of a scene in its cube, and the head of its files."""
    if path.endswith(".svdag"):
        head = files.read_head(spark, path, "svdag")
        return svdag_voxels(cut(files.read_words(spark, path, "svdag"), "words"), head["levels"]), head
    mesh = path.endswith(".obj")
    points = meshes.triangle_soup(*files.read_obj(spark, path)) if mesh else spark.read.parquet(path)
    points = cut(points, "points")
    corners = "abc" if mesh else [""]
    low, high = ([min(r) if f is F.min else max(r) for r in zip(*[points.agg(*(f(f"{c}{a}").cast("double") for a in "xyz")).first() for c in corners])] for f in (F.min, F.max))
    side = max(h - x for x, h in zip(low, high)) or 1.0
    start = [(x + h - side) / 2 for x, h in zip(low, high)]
    head = {"box": [*low, *high], "side": side, "levels": levels, "nodes": 0, "first_leaf": 0}
    if not mesh:
        return octree.voxelize(points, levels, [(x, x + side) for x in start]), head
    cells = [((F.col(f"{c}{a}") - x) / side * (1 << levels)).alias(f"{c}{a}") for c in corners for a, x in zip("xyz", start)]
    triangles = points.select(F.col("line_no").alias("tri_id"), *cells)
    return search.voxelize_triangles(triangles, levels).select("morton").distinct(), head


def svdag_voxels(words: DataFrame, levels: int) -> DataFrame:
    """The voxels of the words of a graph without mirrors (address, word)."""
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(word, i) & 1) = 1)")).alias("slot")
    front = words.where("address = 0").select("address", "word", F.lit(0).cast("long").alias("key"))
    for level in range(levels):
        each = front.select("address", "word", "key", slots)
        here = F.col("key") * 8 + F.col("slot")
        if level == levels - 1:
            return each.select(here.alias("morton"))
        at = F.expr("address + 1 + bit_count(shiftright(word & 255, slot + 1))")
        to = each.select(at.alias("address"), here.alias("key")).join(words.withColumnRenamed("word", "to"), "address")
        front = to.select(F.col("to").alias("address"), "key").join(words, "address")
    return front


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="octolith", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("scene")
    p.add_argument("levels", type=int)
    p.add_argument("out", nargs="*")
    p.add_argument("--lossy", action="store_true")
    p.add_argument("--inflation", type=float, default=2.0)
    p.add_argument("--factor", type=float, default=1.0)
    p.add_argument("--references", type=int, default=1)
    p.add_argument("--cross-level", action="store_true")
    p.add_argument("--stats")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("octolith").getOrCreate()
    voxels, head = scene(spark, a.scene, a.levels)
    voxels, levels = cut(voxels, "voxels"), head["levels"]
    d = octree.dag(voxels, levels)
    if a.lossy:
        # Within the bounds that the options have.
        d, _, lost = merging.lossy_dag(d, min(max(a.inflation, 1.1), 10), min(max(a.factor, 0.01), 32), min(max(a.references, 1), 10**6))
        lost.show()
    head["nodes"] = d.nodes.count()
    figures = {"scene": a.scene, "levels": levels, "voxels": voxels.count(), "nodes": head["nodes"]}
    if a.cross_level:
        figures["across"] = merging.merge_levels(d).nodes.count()
    mirrors = None
    for path in a.out:
        kind = path.rsplit(".", 1)[-1]
        if kind == "svo":
            files.write_words(cut(encodings.svo_words(cut(octree.svo(octree.expand(d), levels), "svo"), levels), "words"), path, "svo", head)
            continue
        if kind == "svdag":
            first = octree.svdag_addresses(d).where(F.col("level") == levels - 1).agg(F.min("address").alias("a")).first().a
            files.write_words(cut(octree.svdag_words(d), "words"), path, "svdag", {**head, "first_leaf": first})
            continue
        if kind != "esvdag" and mirrors is None:
            mirrors = cut(octree.sdag(octree.expand(d), levels), "sdag")
        if kind == "ussvdag":
            words = cut(encodings.ussvdag_words(mirrors, levels), "words")
            leaves = mirrors.where(F.col("level") == levels - 1).count()
            files.write_words(words, path, "ussvdag", {**head, "nodes": mirrors.count(), "first_leaf": words.count() - leaves})
        elif kind in ("ssvdag", "esvdag"):
            graph = mirrors if kind == "ssvdag" else encodings.mirrored(d)
            files.write_ssvdag(encodings.ssvdag(graph, levels), path, {**head, "nodes": graph.count()})
        else:
            p.error(f"unknown ending: {path}")
    print(figures)
    if a.stats:
        files.write_statistics(spark.createDataFrame([figures]), a.stats)


if __name__ == "__main__":
    main()
