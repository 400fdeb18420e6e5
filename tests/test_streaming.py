"""Voxels of a stream: each once, whatever arrives again."""

from octolith.streaming.ingest import stream_voxels


def test_each_voxel_once(spark, tmp_path):
    box = [(0.0, 8.0)] * 3
    first = [(0.5, 0.5, 0.5), (0.7, 0.1, 0.2), (7.9, 0.0, 3.0), (None, 1.0, 1.0)]
    second = [(0.5, 0.5, 0.5), (1.5, 0.5, 0.5), (8.0, 9.0, -1.0)]
    for rows in (first, second):
        spark.createDataFrame(rows, "x double, y double, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("x double, y double, z double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream_voxels(points, 3, box).writeStream.format("memory").queryName("voxels").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    got = [r.morton for r in spark.table("voxels").collect()]
    key = lambda *c: sum((c[a] >> i & 1) << 3 * i + 2 - a for i in range(3) for a in range(3))
    assert sorted(got) == sorted({key(0, 0, 0), key(7, 0, 3), key(1, 0, 0), key(7, 7, 0)})
    batch = spark.createDataFrame(first + second, "x double, y double, z double")
    assert sorted(r.morton for r in stream_voxels(batch, 3, box).collect()) == sorted(got)
