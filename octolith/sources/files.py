"""Text and binary files of meshes and encoded octrees, read and written through Spark's file systems.

A binary file is read whole by one task (2 GB at most, as Spark's binaryFile has it); it is written in chunks that the
executors pack, one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.operators.order import running_sum

#: What stands in each file's head after the box (six floats) and the side (a float), little-endian.
HEADS = {"svo": ["levels", "nodes", "count"], "svdag": ["levels", "nodes", "first_leaf", "count"], "ussvdag": ["levels", "nodes", "first_leaf", "count"], "ssvdag": ["levels", "nodes"]}
CHUNK = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in file order) and value of a text file, whatever the splits it is read in."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value", F.lit(1).cast("long").alias("one"))
    return running_sum(rows, ["file", "block", "id"], "one", "line_no").select("line_no", "value")


def _stream(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)


def _packed(rows: DataFrame, by: str, columns: dict[str, str]) -> Iterator[bytes]:
    """The columns (name: numpy type) of all rows in the order `by`, packed on the executors, a chunk at a time."""
    kind = np.dtype([(c, t) for c, t in columns.items()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros(b.num_rows, kind)
            for i, c in enumerate(columns, 1):
                x[c] = np.asarray(b.column(i))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([x.tobytes()], pa.binary())], names=["at", "data"])

    n = max(1, -(-rows.count() // CHUNK))
    dealt = rows.select(F.col(by).cast("long").alias("__at"), *columns).repartitionByRange(n, "__at").sortWithinPartitions("__at")
    for r in dealt.mapInArrow(pack, "at long, data binary").toLocalIterator():
        yield bytes(r.data)


def _head(kind: str, head: dict, **more: int) -> bytes:
    return struct.pack(f"<7f{len(HEADS[kind])}I", *head["box"], head["side"], *(int({**head, **more}[c]) for c in HEADS[kind]))


def write_words(words: DataFrame, path: str, kind: str, head: dict) -> None:
    """words (address, word; for an octree index, ptr, data) as a file of that kind; head: box, side, levels, nodes, first_leaf."""
    out = _stream(words.sparkSession, path)
    try:
        out.write(bytearray(_head(kind, head, count=words.count())))
        for chunk in _packed(words, "index", {"ptr": "<u4", "data": "<u4"}) if kind == "svo" else _packed(words, "address", {"word": "<u4"}):
            out.write(bytearray(chunk))
    finally:
        out.close()


def write_ssvdag(encoded, path: str, head: dict) -> None:
    """An encodings.Ssvdag as a file: 16-bit words of the inner levels, bricks, and where each inner level begins."""
    inner = encoded.inner.select("level", "address", F.posexplode("words").alias("i", "word"))
    sizes = {r.level: r.n for r in inner.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    starts = [sum(sizes[v] for v in range(level)) for level in range(len(sizes))]
    start = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("level") + 1)
    spark = inner.sparkSession
    out = _stream(spark, path)
    try:
        out.write(bytearray(_head("ssvdag", head) + struct.pack("<I", sum(sizes.values()))))
        for chunk in _packed(inner.select((start + F.col("address") + F.col("i")).alias("at"), "word"), "at", {"word": "<u2"}):
            out.write(bytearray(chunk))
        out.write(bytearray(struct.pack("<I", 8 * encoded.bricks.count())))
        for chunk in _packed(encoded.bricks, "rank", {"brick": "<i8"}):
            out.write(bytearray(chunk))
        out.write(bytearray(struct.pack(f"<I{len(starts)}I", len(starts), *starts)))
    finally:
        out.close()


def read_head(spark: SparkSession, path: str, kind: str) -> dict:
    """box, side and the counts in a file's head."""
    size = 28 + 4 * len(HEADS[kind])
    data = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("h")).first().h
    x = struct.unpack(f"<7f{len(HEADS[kind])}I", bytes(data))
    return {"box": list(x[:6]), "side": x[6], **dict(zip(HEADS[kind], x[7:]))}


def read_words(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The words of a file that write_words wrote."""
    skip = 28 + 4 * len(HEADS[kind])
    names = ["index", "ptr", "data"] if kind == "svo" else ["address", "word"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = np.frombuffer(data.as_buffer(), "<u4", -1, skip).reshape(-1, len(names) - 1).astype(np.int64)
                for i in range(0, len(x), CHUNK):
                    part = x[i : i + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), *(pa.array(np.ascontiguousarray(c)) for c in part.T)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, ", ".join(f"{c} long" for c in names))


def read_ssvdag(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """inner (level, address, words) and bricks (rank, brick) of a file that write_ssvdag wrote."""

    def parts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = 28 + 4 * len(HEADS["ssvdag"])
        out = []
        for kind in ("<u2", "u1", "<u4"):
            n = struct.unpack_from("<I", data, at)[0]
            out.append(np.frombuffer(data, kind, n, at + 4))
            at += 4 + n * np.dtype(kind).itemsize
        return tuple(out)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                words, _, starts = parts(data.as_py())
                for level, (a, z) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(words)])):
                    rows, at = [], a
                    while at < z:  # a node's header tells its size
                        size = 1 + sum(min(int(words[at]) >> 2 * s & 3, 2) for s in range(8))
                        rows.append((level, at - a, words[at : at + size].tolist()))
                        at += size
                    for i in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), (pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["level", "address", "words"])

    def bricks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = parts(data.as_py())[1].view("<i8")
                for i in range(0, len(x), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, min(len(x), i + CHUNK))), pa.array(x[i : i + CHUNK].copy())], names=["rank", "brick"])

    file = spark.read.format("binaryFile").load(path).select("content")
    return file.mapInArrow(inner, "level int, address long, words array<long>"), file.mapInArrow(bricks, "rank long, brick long")


def write_statistics(rows: DataFrame, path: str) -> None:
    """Appends a run's figures (any columns) to a table of them."""
    rows.write.mode("append").parquet(path)


def read_obj(spark: SparkSession, path: str, cache: str | None = None, strict_quads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of an OBJ file (meshes.parse_obj); with `cache`, from the tables there if they are whole, else written to it."""
    from octolith.sources.meshes import parse_obj

    if cache:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/faces/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            vertices, faces = parse_obj(read_lines(spark, path), strict_quads)
            vertices.write.mode("overwrite").parquet(f"{cache}/vertices")
            faces.write.mode("overwrite").parquet(f"{cache}/faces")
        return spark.read.parquet(f"{cache}/vertices"), spark.read.parquet(f"{cache}/faces")
    return parse_obj(read_lines(spark, path), strict_quads)


def write_coloured_obj(points: DataFrame, faces: DataFrame, path: str) -> None:
    """Text lines `v x y z r g b` (points: v, x, y, z, r, g, b) and `f i j k` (faces: i, j, k), vertices first."""
    v = points.select(F.lit(0).alias("kind"), F.col("v").alias("n"), F.concat_ws(" ", F.lit("v"), *("x y z r g b".split())).alias("value"))
    f = faces.select(F.lit(1).alias("kind"), F.col("i").alias("n"), F.concat_ws(" ", F.lit("f"), "i", "j", "k").alias("value"))
    v.unionByName(f).repartitionByRange("kind", "n").sortWithinPartitions("kind", "n").select("value").write.text(path)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """point_id, x, y, z of a LAS file (uncompressed, any point format): its scale and offset applied."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                raw = data.as_buffer()
                if bytes(raw[:4]) != b"LASF":
                    raise ValueError("not a LAS file")
                start, = struct.unpack_from("<I", raw, 96)
                size, n = struct.unpack_from("<HI", raw, 105)
                if raw[25:26].to_pybytes() >= b"\x04" and not n:
                    n, = struct.unpack_from("<Q", raw, 247)
                scale, offset = (np.array(struct.unpack_from("<3d", raw, at)) for at in (131, 155))
                rows = np.frombuffer(raw, np.uint8, n * size, start).reshape(n, size)[:, :12]
                for i in range(0, n, CHUNK):
                    p = np.ascontiguousarray(rows[i : i + CHUNK]).view("<i4") * scale + offset
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(p))), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=["point_id", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "point_id long, x double, y double, z double")
