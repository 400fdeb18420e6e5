"""The command line on a point table, and on a file that it wrote."""

from octolith import __main__ as command
from octolith.sources import files


def test_points_to_files_and_back(spark, tmp_path):
    points = [(x + 0.5, y + 0.5, 0.5) for x in range(4) for y in range(4) if x + y < 4] + [(0.0, 0.0, 0.0), (4.0, 4.0, 1.0)]
    spark.createDataFrame(points, "x double, y double, z double").coalesce(1).write.parquet(str(tmp_path / "points"))
    out = [str(tmp_path / f"a.{k}") for k in ("svdag", "esvdag")]
    command.main([str(tmp_path / "points"), "3", *out, "--stats", str(tmp_path / "stats")])
    figures = spark.read.parquet(str(tmp_path / "stats")).first()
    head = files.read_head(spark, out[0], "svdag")
    assert head["side"] == 4.0 and head["levels"] == 3 and head["nodes"] == figures.nodes and figures.voxels == 12
    again, _ = command.scene(spark, out[0], 3)
    assert again.count() == 12
