"""OBJ and MTL text, walkthrough files, edge lists, and the binary DAG format."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.operators.order import carried, running_sum

EDGES = "src long, dst long, weight float"


def parse_obj(lines: DataFrame, strict_quads: bool = True) -> tuple[DataFrame, DataFrame]:
    """lines (line_no, value) of an OBJ text: vertices (v, x, y, z), v from 1, and faces (line_no, part, i, j, k, material).

    Faces name vertices as `i`, `i/t/n` or `i//n`; negative ones count back from the last vertex before the face. A
    quad gives two triangles; with strict_quads=False only the first. Other lines are skipped.
    """
    rows = lines.select("line_no", F.split(F.trim("value"), r"\s+").alias("w"))
    kind = F.col("w")[0]
    rows = rows.where(kind.isin("v", "f", "usemtl")).withColumn("own", F.when(kind == "v", 1).otherwise(0).cast("long"))
    rows = running_sum(rows, ["line_no"], "own", "v").withColumn("v", F.col("v") + F.col("own"))
    rows = carried(rows, "line_no", F.when(kind == "usemtl", F.get("w", F.lit(1))), "material")
    vertices = rows.where(kind == "v").select("v", *(F.col("w")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")))
    index = F.transform(F.slice("w", 2, 8), lambda t: F.split(t, "/")[0].cast("long"))
    index = F.transform(index, lambda i: F.when(i < 0, F.col("v") + 1 + i).otherwise(i))
    faces = rows.where(kind == "f").select("line_no", "material", index.alias("i"))
    second = F.when((F.size("i") > 3) & F.lit(strict_quads), F.array(F.struct(F.lit(1).alias("part"), F.col("i")[2].alias("a"), F.col("i")[3].alias("b"), F.col("i")[0].alias("c")))).otherwise(F.array())
    first = F.array(F.struct(F.lit(0).alias("part"), F.col("i")[0].alias("a"), F.col("i")[1].alias("b"), F.col("i")[2].alias("c")))
    faces = faces.select("line_no", "material", F.explode(F.concat(first, second)).alias("t"))
    return vertices, faces.select("line_no", "t.part", F.col("t.a").alias("i"), F.col("t.b").alias("j"), F.col("t.c").alias("k"), "material")


def triangle_soup(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Corner coordinates of each face; faces with unknown vertices go."""
    out = faces
    for name, corner in zip("ijk", "abc"):
        out = out.join(vertices.select(F.col("v").alias(name), *(F.col(a).alias(f"{corner}{a}") for a in "xyz")), name)
    return out.select("line_no", "part", *(f"{c}{a}" for c in "abc" for a in "xyz"))


def parse_mtl(lines: DataFrame) -> DataFrame:
    """line_no, name, property, value rows of an MTL text: a property belongs to the last `newmtl` before it."""
    rows = lines.select("line_no", F.split(F.trim("value"), r"\s+", 2).alias("w"))
    rows = carried(rows, "line_no", F.when(F.col("w")[0] == "newmtl", F.get("w", F.lit(1))), "name")
    return rows.where(F.col("w")[0].isin("Ka", "Kd", "Ks", "Ns", "d", "Ts")).select("line_no", "name", F.col("w")[0].alias("property"), F.col("w")[1].alias("value"))


def materials(properties: DataFrame) -> DataFrame:
    """A row a material of parse_mtl's rows: name, ambient, diffuse and specular colour, exponent, opacity; the last of each counts."""
    value = lambda *keys: F.max_by(F.when(F.col("property").isin(*keys), F.col("value")), F.when(F.col("property").isin(*keys), F.col("line_no")))
    colour = lambda c: F.transform(F.slice(F.split(c, r"\s+"), 1, 3), lambda x: x.cast("float"))
    out = properties.groupBy("name").agg(*(value(*k).alias(n) for n, k in (("ambient", ["Ka"]), ("diffuse", ["Kd"]), ("specular", ["Ks"]), ("exponent", ["Ns"]), ("opacity", ["d", "Ts"]))))
    return out.select("name", *(colour(F.col(c)).alias(c) for c in ("ambient", "diffuse", "specular")), F.col("exponent").cast("float").alias("exponent"), F.col("opacity").cast("float").alias("opacity"))


def normals(soup: DataFrame) -> DataFrame:
    """line_no, part and the normal of each face of triangle_soup's rows: the cross product of its sides, not of length 1."""
    u, v = [[F.col(f"{c}{a}") - F.col(f"a{a}") for a in "xyz"] for c in "bc"]
    cross = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    return soup.select("line_no", "part", *(c.alias(f"n{a}") for c, a in zip(cross, "xyz")))


def parse_walkthrough(lines: DataFrame) -> DataFrame:
    """key_idx, px..tz of a walkthrough text, whose first line (line_no 0) is its header."""
    w = F.split(F.trim("value"), r"\s+")
    return lines.where("line_no > 0").select((F.col("line_no") - 1).alias("key_idx"), *(w[i].cast("double").alias(n) for i, n in enumerate(("px", "py", "pz", "tx", "ty", "tz"))))


def read_edges(spark, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema=EDGES)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "weight").write.csv(path, sep=" ")


def read_clusters(spark, path: str) -> DataFrame:
    """cluster (its first id), node_id of a text with a cluster's ids a line, parted by tabs."""
    ids = F.transform(F.split(F.trim("value"), r"\t"), lambda x: x.cast("long"))
    return spark.read.text(path).where("trim(value) <> ''").select(ids.alias("ids")).select(F.col("ids")[0].alias("cluster"), F.explode("ids").alias("node_id"))


def write_walkthrough(keys: DataFrame, header: str, path: str) -> None:
    """Keys (key_idx, px..tz) as text after a header line, in their order."""
    value = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("px", "py", "pz", "tx", "ty", "tz")))
    first = keys.sparkSession.range(1).select(F.lit(-1).cast("long").alias("key_idx"), F.lit(header).alias("value"))
    first.unionByName(keys.select("key_idx", value.alias("value"))).repartitionByRange("key_idx").sortWithinPartitions("key_idx").select("value").write.text(path)


def svdag_bytes(box: list[float], side: float, levels: int, nodes: int, first_leaf: int, words: list[int]) -> bytes:
    """A DAG file: bounding box, side, levels, nodes, first leaf, number of words, words (little-endian)."""
    return struct.pack(f"<7f4I{len(words)}I", *box, side, levels, nodes, first_leaf, len(words), *words)


def svdag_read(data: bytes) -> dict:
    *head, levels, nodes, first_leaf, n = struct.unpack_from("<7f4I", data)
    return {"box": head[:6], "side": head[6], "levels": levels, "nodes": nodes, "first_leaf": first_leaf, "words": list(struct.unpack_from(f"<{n}I", data, 44))}


def svdag_decoded(words: DataFrame, levels: int) -> DataFrame:
    """(level, address, child_mask, slot, child) of words (address, word), level by level from the root at address 0."""
    front = words.where("address = 0").select(F.lit(0).alias("level"), "address")
    out = None
    for level in range(levels):
        mask = front.join(words, "address").select("level", "address", F.col("word").cast("int").alias("child_mask"))
        if level == levels - 1:
            rows = mask.select("level", "address", "child_mask", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("child"))
        else:
            slots = mask.select("level", "address", "child_mask", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")).where("(shiftright(child_mask, slot) & 1) = 1")
            at = slots.withColumn("at", F.col("address") + 1 + F.bit_count(F.expr("shiftright(child_mask, slot + 1)")))
            rows = at.join(words.select(F.col("address").alias("at"), F.col("word").alias("child")), "at").select("level", "address", "child_mask", "slot", "child")
            front = rows.select(F.lit(level + 1).alias("level"), F.col("child").alias("address")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out
