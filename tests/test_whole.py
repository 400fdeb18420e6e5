"""Queries over whole tables: rows beyond what a prefix of ids holds, against brute force."""

import itertools

import numpy as np

from octolith.plans import catalogue


def touches(tri, low):
    """The separating-axis test of a triangle and the unit cube at low, closed."""
    v = tri - (low + 0.5)
    e = [v[1] - v[0], v[2] - v[1], v[0] - v[2]]
    axes = [*np.eye(3), np.cross(e[0], e[1]), *(np.cross(u, x) for u in np.eye(3) for x in e)]
    return all(min(v @ a) <= 0.5 * abs(a).sum() and max(v @ a) >= -0.5 * abs(a).sum() for a in axes)


def test_every_triangle_is_voxelised(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = {i: rng.uniform(-1, 1, 9) for i in (0, 7, 199, 200, 201, 1999, 10**9)}
    table = spark.createDataFrame([(i, r.tolist()) for i, r in rows.items()], "vec_id long, embedding array<double>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    key = lambda c: sum((c[a] >> i & 1) << 3 * i + 2 - a for i in range(3) for a in range(3))
    want = {(i, key(c)) for i, r in rows.items() for c in itertools.product(range(8), repeat=3) if touches((r.reshape(3, 3) + 1) * 4, np.array(c))}
    got = catalogue.QUERIES["voxelize_triangles"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_subtrees_of_the_whole_level_are_compared(spark, tmp_path):
    cells = [(0, 0, 0), (1, 0, 0), (9, 8, 7), (20, 33, 5), (21, 35, 4), (63, 63, 63), (62, 63, 60), (63, 60, 61), (60, 61, 63)]
    rows = [((x + 0.5), (y + 0.5), (z + 0.5) / 640) for x, y, z in cells] + [(0.0, 0.0, 0.0), (64.0, 64.0, 0.1)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    at = {}
    for x, y, z in cells:
        key = sum((x >> i & 1) << 3 * i + 2 | (y >> i & 1) << 3 * i + 1 | (z >> i & 1) << 3 * i for i in range(6))
        at.setdefault(key >> 6, set()).add(key & 63)
    nodes = {}  # the smallest key of each shape
    for key, shape in sorted(at.items()):
        nodes.setdefault(frozenset(shape), key)
    want = sorted((min(a, b), max(a, b), len(x ^ y)) for (x, a), (y, b) in itertools.combinations(nodes.items(), 2))
    assert max(nodes.values()) == 4095
    assert sorted(map(tuple, catalogue.QUERIES["subtree_diff"](spark, str(tmp_path)).collect())) == want
