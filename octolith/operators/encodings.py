"""Encodings of octrees and of graphs of distinct nodes, as tables of words, and what they decode to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions.morton import bits, mirror_mask, prefix
from octolith.operators.octree import SLOTS, Dag
from octolith.operators.order import running_sum
from octolith.storage import cut

#: Addresses from here on take two 16-bit words, and from there on the bit beside the mirror bits.
SHORT, LONG_BIT = 1 << 13, 1 << 29


# ---- octrees ----


def svo_words(tree: DataFrame, levels: int) -> DataFrame:
    """index, ptr, data of each node of an octree (level, key, child_mask).

    A node's children stand together, from slot 7 down; blocks follow each other as their parents do depth first. ptr is
    the first child's index, 0 at the last level, data the number of children above the child mask.
    """
    inner = F.col("level") < levels - 1
    first = F.expr(f"shiftleft(key, 3 * ({levels - 1} - level))")  # the first cell of the last level below
    rows = tree.select("level", "key", "child_mask", first.alias("first"), F.when(inner, bits(F.col("child_mask"))).otherwise(0).alias("size"))
    rows = cut(running_sum(rows, ["first", "level"], "size", "before").withColumn("block", F.col("before") + 1), "blocks")
    parent = rows.select((F.col("level") + 1).alias("level"), F.col("key").alias("up"), F.col("block").alias("at"), F.col("child_mask").alias("brothers"))
    placed = rows.withColumn("up", prefix(F.col("key"), 1)).join(parent, ["level", "up"], "left")
    above = F.bit_count(F.expr("shiftright(brothers, cast(key & 7 as int) + 1)"))
    index = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.col("at") + above).cast("long")
    return placed.select(index.alias("index"), F.when(inner, F.col("block")).otherwise(0).cast("long").alias("ptr"), (bits(F.col("child_mask")) * 65536 + F.col("child_mask")).alias("data"))


def compact_svo(words: DataFrame) -> DataFrame:
    """Three nodes in four words: block, three ptrs (0 where there is none) and their masks in one word."""
    place = F.col("index") % 3
    ptr = [F.coalesce(F.max(F.when(place == i, F.col("ptr"))), F.lit(0)).alias(f"ptr{i}") for i in range(3)]
    masks = F.sum(F.col("data").bitwiseAND(F.lit(255).cast("long")) * F.when(place == 0, 1).when(place == 1, 256).otherwise(65536)).alias("masks")
    return words.groupBy(F.floor(F.col("index") / 3).cast("long").alias("block")).agg(*ptr, masks)


def svo_decoded(words: DataFrame, levels: int) -> DataFrame:
    """The voxels of octree words."""
    front = words.where("index = 0").select("ptr", "data", F.lit(0).cast("long").alias("key"))
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(data, i) & 1) = 1)")).alias("slot")
    for level in range(levels):
        each = front.select("ptr", "data", "key", slots)
        if level == levels - 1:
            return each.select((F.col("key") * 8 + F.col("slot")).alias("morton"))
        at = F.col("ptr") + F.bit_count(F.expr("shiftright(data & 255, slot + 1)"))
        front = each.select(at.alias("index"), (F.col("key") * 8 + F.col("slot")).alias("key")).join(words, "index").select("ptr", "data", "key")
    return front


# ---- graphs, with or without mirrors: level, node_id, refs (8 * child + mirror, -1: none; at the last level 1: a voxel) ----


def mirrored(d: Dag) -> DataFrame:
    """A graph without mirrors in the form that octree.sdag has."""
    last = F.col("level") == d.levels - 1
    refs = [F.when(last, F.when(F.expr(f"(shiftright(child_mask, {i}) & 1) = 1"), F.lit(1)).otherwise(-1)).otherwise(F.when(F.col(c) < 0, F.lit(-1)).otherwise(F.col(c) * 8)).cast("long") for i, c in enumerate(SLOTS)]
    return d.nodes.select("level", "node_id", F.array(*refs).alias("refs"))


def _mask(refs: str = "refs") -> Column:
    """The child mask of refs."""
    return F.expr(f"aggregate(sequence(0, 7), 0, (m, i) -> m | IF({refs}[i] >= 0, shiftleft(1, i), 0))")


def _mirrors(axis: int) -> Column:
    """Which children's mirrors have the bit of an axis (4, 2, 1: x, y, z)."""
    return F.expr(f"aggregate(sequence(0, 7), 0L, (m, i) -> m | IF(refs[i] >= 0 AND (refs[i] & {axis}) <> 0, shiftleft(1L, i), 0L))")


def links(graph: DataFrame) -> DataFrame:
    """level, node_id, slot, child_id, mirror of inner nodes."""
    return graph.select("level", "node_id", F.posexplode("refs").alias("slot", "ref")).where("ref >= 0").select("level", "node_id", "slot", F.floor(F.col("ref") / 8).cast("long").alias("child_id"), (F.col("ref") % 8).cast("int").alias("mirror"))


def ussvdag_words(graph: DataFrame, levels: int) -> DataFrame:
    """address, word: a node's mirrors of the z, y and x axis and its child mask in a byte each, then its children's addresses from slot 7 down."""
    last = levels - 1
    rows = graph.withColumn("child_mask", _mask()).withColumn("size", F.when(F.col("level") == last, F.lit(1)).otherwise(1 + F.bit_count("child_mask")).cast("long"))
    rows = cut(running_sum(rows, ["level", "node_id"], "size", "address"), "addresses")
    inner = F.col("level") < last
    header = F.when(inner, _mirrors(1) * (1 << 24) + _mirrors(2) * (1 << 16) + _mirrors(4) * (1 << 8)).otherwise(0) + F.col("child_mask")
    child = rows.select((F.col("level") - 1).alias("level"), F.col("node_id").alias("child_id"), F.col("address").alias("word"))
    pointers = links(graph.where(inner)).join(child, ["level", "child_id"]).join(rows.select("level", "node_id", "address", "child_mask"), ["level", "node_id"])
    above = F.bit_count(F.expr("shiftright(child_mask, slot + 1)"))
    return rows.select("address", header.cast("long").alias("word")).unionByName(pointers.select((F.col("address") + 1 + above).alias("address"), "word"))


def ussvdag_decoded(words: DataFrame, levels: int) -> DataFrame:
    """The voxels of such words. A child is seen in the mirror of all that led to it and of its own pointer."""
    front = words.where("address = 0").select("address", "word", F.lit(0).alias("seen"), F.lit(0).cast("long").alias("key"))
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(word, i) & 1) = 1)")).alias("slot")
    for level in range(levels):
        each = front.select("address", "word", "seen", "key", slots)
        here = F.col("key") * 8 + F.col("slot").bitwiseXOR(F.col("seen"))
        if level == levels - 1:
            return each.select(here.alias("morton"))
        own = F.expr("(shiftright(word, 8 + slot) & 1) * 4 + (shiftright(word, 16 + slot) & 1) * 2 + (shiftright(word, 24 + slot) & 1)").cast("int")
        at = F.expr("address + 1 + bit_count(shiftright(word & 255, slot + 1))")
        step = each.select(at.alias("address"), F.col("seen").bitwiseXOR(own).alias("seen"), here.alias("key")).join(words.withColumnRenamed("word", "to"), "address")
        front = step.select(F.col("to").alias("address"), "seen", "key").join(words, "address")
    return front


class Ssvdag:
    """bricks: rank, brick (the 64 voxels of a node of the last level but one, bit 16 * x + 4 * y + z).
    inner: level, node_id, address within its level, header, words (16 bits each, the header first).
    pointers: level, slot, address, words it takes, whether bit 29 of the address is told by the header."""

    def __init__(self, bricks: DataFrame, inner: DataFrame, pointers: DataFrame, ranks: DataFrame):
        self.bricks, self.inner, self.pointers, self.ranks = bricks, inner, pointers, ranks


def ssvdag(graph: DataFrame, levels: int) -> Ssvdag:
    """Nodes of a level by number of pointers to them (most first, then node_id); the last two levels as bricks.

    A level's pointers are as wide as the addresses below need, so levels are laid out from the last up.
    """
    graph = cut(graph, "graph")
    every = cut(links(graph.where(F.col("level") < levels - 1)), "links")
    used = every.groupBy((F.col("level") + 1).alias("level"), F.col("child_id").alias("node_id")).agg(F.count("*").alias("times"))
    times = F.coalesce("times", F.lit(0))
    rows = cut(graph.join(used, ["level", "node_id"], "left").select("level", "node_id", times.alias("refs"), (-times).alias("rarity")), "used")
    last = levels - 2
    ranks = running_sum(rows.where(F.col("level") == last).withColumn("one", F.lit(1).cast("long")), ["rarity", "node_id"], "one", "address")
    ranks = cut(ranks.select("level", "node_id", "refs", "address"), "ranks")
    leaf = graph.where(F.col("level") == levels - 1).select(F.col("node_id").alias("child_id"), _mask().alias("m"))
    own = every.where(F.col("level") == last).join(leaf, "child_id")
    seen = F.lit(None).cast("int")
    for g in range(8):
        seen = F.when(F.col("mirror") == g, mirror_mask(F.col("m"), g)).otherwise(seen)
    place = [F.expr(f"shiftleft(shiftright(slot, {2 - a}) & 1, 1) + (shiftright(j, {2 - a}) & 1)") for a in range(3)]
    voxel = own.select("node_id", "slot", seen.alias("m")).select("node_id", "slot", F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(m, i) & 1) = 1)")).alias("j"))
    brick = voxel.groupBy("node_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place[0] * 16 + place[1] * 4 + place[2]).cast("int"))).alias("brick"))
    bricks = ranks.join(brick, "node_id").select(F.col("address").alias("rank"), "brick")
    placed, below, inner, pointers = ranks, ranks, None, None
    for level in range(last - 1, -1, -1):
        to = below.select(F.col("node_id").alias("child_id"), F.col("address").alias("to"))
        at = every.where(F.col("level") == level).join(to, "child_id").select("level", "node_id", "slot", "mirror", "to", F.when(F.col("to") < SHORT, 1).otherwise(2).alias("n"))
        at = cut(at.withColumn("high", (F.col("to") >= SHORT) & (F.col("to").bitwiseAND(F.lit(LONG_BIT).cast("long")) != 0)), "pointers")
        mirror = F.expr("(shiftright(mirror, 2) & 1) + (shiftright(mirror, 1) & 1) * 2 + (mirror & 1) * 4").cast("long")
        code = F.when(F.col("n") == 1, 1).when(F.col("high"), 3).otherwise(2)
        short = F.array((F.col("to") + mirror * (1 << 13)).cast("long"))
        low = F.col("to").bitwiseAND(F.lit(LONG_BIT - 1).cast("long")) + mirror * (1 << 29)
        long = F.array(F.shiftright(low, 16), low.bitwiseAND(F.lit(65535).cast("long")))
        body = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.when(F.col("n") == 1, short).otherwise(long).alias("w"))), asc=False), lambda x: x["w"]))
        made = at.groupBy("level", "node_id").agg(F.sum(code.cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), (2 * F.col("slot")).cast("int"))).alias("header"), (1 + F.sum("n")).alias("size"), body.alias("body"))
        made = made.join(rows, ["level", "node_id"])
        made = cut(running_sum(made, ["rarity", "node_id"], "size", "address"), "level")
        below = made.select("level", "node_id", "refs", "address")
        own = made.select("level", "node_id", "address", "header", F.concat(F.array("header"), "body").alias("words"))
        inner, pointers, placed = (own, at, placed.unionByName(below)) if inner is None else (inner.unionByName(own), pointers.unionByName(at), placed.unionByName(below))
    return Ssvdag(bricks, inner, pointers, placed)


def ssvdag_decoded(inner: DataFrame, bricks: DataFrame, levels: int) -> DataFrame:
    """The voxels of inner nodes (level, address, words) and bricks (rank, brick)."""
    front = inner.where("level = 0").select(F.lit(0).cast("long").alias("address"), F.lit(0).alias("seen"), F.lit(0).cast("long").alias("key"))
    for level in range(levels - 2):
        own = front.join(inner.where(F.col("level") == level).select("address", "words"), "address")
        each = own.select("seen", "key", "words", F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(words[0], 2 * i) & 3) <> 0)")).alias("slot"))
        # Words before a child's: one or two for each child of a higher slot.
        each = each.withColumn("at", F.expr("aggregate(filter(sequence(0, 7), i -> i > slot), 1L, (n, i) -> n + least(shiftright(words[0], 2 * i) & 3, 2L))"))
        each = each.withColumn("code", F.expr("shiftright(words[0], 2 * slot) & 3")).withColumn("w", F.expr("IF(code = 1, words[cast(at as int)], words[cast(at as int)] * 65536 + words[cast(at as int) + 1])"))
        address = F.expr(f"IF(code = 1, w & {SHORT - 1}, (w & {LONG_BIT - 1}) + IF(code = 3, {LONG_BIT}L, 0L))")
        mirror = F.expr("IF(code = 1, shiftright(w, 13), shiftright(w, 29)) & 7")
        mirror = (mirror.bitwiseAND(F.lit(1).cast("long")) * 4 + mirror.bitwiseAND(F.lit(2).cast("long")) + F.shiftright(mirror, 2)).cast("int")
        front = each.select(address.cast("long").alias("address"), F.col("seen").bitwiseXOR(mirror).alias("seen"), (F.col("key") * 8 + F.col("slot").bitwiseXOR(F.col("seen"))).alias("key"))
    cells = front.join(bricks.withColumnRenamed("rank", "address"), "address").select("key", "seen", F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(brick, i) & 1) = 1)")).alias("i"))
    # Bit 16 x + 4 y + z to a slot and the slot in it, each seen in the mirror.
    digit = [F.expr(f"(shiftright(i, {4 + h}) & 1) * 4 + (shiftright(i, {2 + h}) & 1) * 2 + (shiftright(i, {h}) & 1)").bitwiseXOR(F.col("seen")) for h in (1, 0)]
    return cells.select((F.col("key") * 64 + digit[0] * 8 + digit[1]).cast("long").alias("morton"))


def pointer_statistics(s: Ssvdag) -> DataFrame:
    """level, nodes, ptr16, ptr28, ptr29, words of the inner levels."""
    p = s.pointers.groupBy("level").agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("ptr16", F.col("n") == 1), ("ptr28", (F.col("n") == 2) & ~F.col("high")), ("ptr29", F.col("high")))))
    return s.inner.groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.size("words")).alias("words")).join(p, "level").select("level", "nodes", "ptr16", "ptr28", "ptr29", "words")


def reference_shares(s: Ssvdag) -> DataFrame:
    """level, bin, share: of ten bins of a level's nodes by references, the percentage (whole) of those in the bins.

    A bin has a tenth of the level's nodes, at least one; nodes beyond ten such bins are in none.
    """
    n = s.ranks.groupBy("level").agg(F.count("*").alias("n"))
    rows = running_sum(s.ranks.withColumn("one", F.lit(1).cast("long")).withColumn("rarity", -F.col("refs")), ["level", "rarity", "node_id"], "one", "place")
    first = rows.groupBy("level").agg(F.min("place").alias("first"))
    rows = rows.join(F.broadcast(n.join(first, "level")), "level").withColumn("bin", F.floor((F.col("place") - F.col("first")) / F.greatest(F.floor(F.col("n") / 10), F.lit(1))).cast("long")).where("bin < 10")
    total = rows.groupBy("level", "bin").agg(F.sum("refs").alias("refs"))
    whole = total.groupBy("level").agg(F.sum("refs").alias("all"))
    return total.join(whole, "level").where("all > 0").select("level", "bin", F.floor(F.col("refs") * 100 / F.col("all")).cast("long").alias("share"))
