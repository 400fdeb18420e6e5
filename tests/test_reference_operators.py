"""Encoders, files, merging, hidden geometry and the viewer against brute force on small grids."""

import collections
import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from octolith.operators import encodings, hidden, merging, octree, order, viewer
from octolith.sources import files, meshes
from octolith.storage import cut

L = 3


def key(c, levels=L):
    return sum((c[a] >> i & 1) << 3 * i + 2 - a for i in range(levels) for a in range(3))


def grid(seed, share):
    rng = np.random.default_rng(seed)
    return [c for c in itertools.product(range(8), repeat=3) if rng.random() < share] or [(1, 2, 3)]


CELLS = {"sparse": grid(1, 0.03), "half": grid(2, 0.5), "one": [(7, 0, 3)], "halves": [(x, y, z) for x, y, z in itertools.product(range(8), repeat=3) if (x & 3) + (y & 3) < 3]}


def frame(spark, cells):
    return cut(spark.createDataFrame([(key(c),) for c in cells], "morton long"), "voxels")


def keys(df):
    rows = [r.morton for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("name", CELLS)
def test_encodings_and_files_come_back(spark, tmp_path, name):
    v = frame(spark, CELLS[name])
    want = {key(c) for c in CELLS[name]}
    head = {"box": [0.0] * 3 + [1.0] * 3, "side": 2.0, "levels": L, "nodes": 5, "first_leaf": 6}
    tree, graph, mirrors = cut(octree.svo(v, L), "svo"), octree.dag(v, L), cut(octree.sdag(v, L), "sdag")
    words = cut(encodings.svo_words(tree, L), "words")
    files.write_words(words, f"{tmp_path}/a.svo", "svo", head)
    assert (tmp_path / "a.svo").stat().st_size == 40 + 8 * words.count()
    assert keys(encodings.svo_decoded(files.read_words(spark, f"{tmp_path}/a.svo", "svo"), L)) == want
    words = cut(encodings.ussvdag_words(mirrors, L), "words")
    files.write_words(words, f"{tmp_path}/a.ussvdag", "ussvdag", head)
    assert (tmp_path / "a.ussvdag").stat().st_size == 44 + 4 * words.count()
    assert files.read_head(spark, f"{tmp_path}/a.ussvdag", "ussvdag") == {**head, "count": words.count()}
    assert keys(encodings.ussvdag_decoded(files.read_words(spark, f"{tmp_path}/a.ussvdag", "ussvdag"), L)) == want
    for k, g in enumerate((mirrors, encodings.mirrored(graph))):
        files.write_ssvdag(encodings.ssvdag(g, L), f"{tmp_path}/{k}.ssvdag", head)
        assert keys(encodings.ssvdag_decoded(*files.read_ssvdag(spark, f"{tmp_path}/{k}.ssvdag"), L)) == want


def test_wide_pointers_come_back(spark, monkeypatch):
    """Addresses from 2 on take two words."""
    monkeypatch.setattr(encodings, "SHORT", 2)
    s = encodings.ssvdag(cut(octree.sdag(frame(spark, CELLS["half"]), L), "sdag"), L)
    assert sum(r.ptr28 for r in encodings.pointer_statistics(s).collect()) > 0
    assert keys(encodings.ssvdag_decoded(s.inner.select("level", "address", "words"), s.bricks, L)) == {key(c) for c in CELLS["half"]}


@pytest.mark.parametrize("name", CELLS)
def test_subtrees_merge_across_levels(spark, name):
    v = frame(spark, CELLS[name])
    d = octree.dag(v, L)
    assert merging.integrity(d).count() == 0
    g = merging.merge_levels(d)
    assert keys(merging.expand_linked(g)) == {key(c) for c in CELLS[name]}
    assert g.nodes.count() <= d.nodes.count()
    below = {(r.level, r.node_id): r.voxels for r in merging.subtree_voxels(d).collect()}
    assert below[0, 0] == len(CELLS[name])


def test_lossy_loses_no_more_than_it_says(spark):
    """Blocks that differ from the first in one voxel each."""
    rng = np.random.default_rng(5)
    cells = set()
    for bx, by, bz in itertools.product((0, 4), repeat=3):
        block = {(x, y, z) for x, y, z in itertools.product(range(4), repeat=3) if x + y < 4}
        block ^= {tuple(int(i) for i in rng.integers(0, 4, 3))} if cells else set()
        cells |= {(bx + x, by + y, bz + z) for x, y, z in block}
    v = frame(spark, sorted(cells))
    d = octree.dag(v, L)
    less, to, lost = merging.lossy_dag(d, most_refs=10**6)
    after, voxels = keys(octree.expand(less)), sum(r.voxels for r in lost.collect())
    assert less.nodes.count() < d.nodes.count() and merging.integrity(less).count() == 0
    assert 0 < len(after ^ {key(c) for c in cells}) <= voxels
    same, _, none = merging.lossy_dag(d, most_refs=0)
    assert keys(octree.expand(same)) == {key(c) for c in cells} and sum(r.replaced for r in none.collect()) == 0


def test_differences_are_counted(spark):
    v = frame(spark, CELLS["half"])
    d = octree.dag(v, L)
    ids = [r.node_id for r in d.nodes.where("level = 1").collect()]
    pairs = spark.createDataFrame(list(itertools.combinations(ids, 2)), "a long, b long")
    at = collections.defaultdict(set)
    for k in (key(c) for c in CELLS["half"]):
        at[k >> 6].add(k & 63)
    got = {(r.a, r.b): r for r in merging.differences(d, pairs, 1).collect()}
    for (a, b), r in got.items():
        assert r.diff == len(at[a] ^ at[b])
        leaves = [(sum(x >> 3 == s for x in at[a]), sum(x >> 3 == s for x in at[b]), len({x for x in at[a] ^ at[b] if x >> 3 == s})) for s in range(8)]
        assert r.leaves >= sum(1 for x, y, n in leaves if n) and r.veto == any(n > 4 for *_, n in leaves)


def outside(cells):
    solid, seen, todo = set(cells), set(), [(7, 7, 7)]
    touched = set()
    while todo:
        c = todo.pop()
        if c in seen or c in solid:
            touched |= {c} & solid
            continue
        seen.add(c)
        todo += [n for a in range(3) for s in (1, -1) if 0 <= (n := tuple(v + s * (i == a) for i, v in enumerate(c)))[a] < 8]
    return seen, touched


SHELL = [c for c in itertools.product(range(1, 7), repeat=3) if any(x in (1, 6) for x in c)]


@pytest.mark.parametrize("cells", [SHELL, CELLS["half"], CELLS["one"], [*SHELL, (3, 3, 3)], [(7, 7, 7)]])
def test_outside(spark, cells):
    tree = cut(octree.svo(frame(spark, cells), L), "svo")
    seen, touched = outside(cells) if (7, 7, 7) not in cells else (set(), set())
    assert {r.key for r in hidden.voxels_of(hidden.outside_cells(tree, L), L).collect()} == {key(c) for c in seen}
    masks = {(r.level, r.key): r.outside_mask for r in hidden.outside_masks(tree, L).collect()}
    want = collections.Counter()
    for k in (key(c) for c in seen | touched):
        for level in range(L):
            want[level, k >> 3 * (L - level)] |= 1 << (k >> 3 * (L - level - 1) & 7)
    assert masks == {at: want[at] for at in masks}
    merged = hidden.visible_merge(tree, cut(hidden.outside_masks(tree, L), "masks"), L).collect()
    assert all(not (r.child_mask ^ r.new) & masks[L - 1, r.key] for r in merged)
    assert len({r.new for r in merged}) <= len({r.child_mask for r in merged})


def test_rays_and_occlusion(spark):
    rng = np.random.default_rng(9)
    cells = CELLS["sparse"]
    rows = [(i, *rng.uniform(-4, 12, 3).tolist(), *rng.normal(0, 1, 3).tolist()) for i in range(150)] + [(999, 4.5, 20.0, 4.5, 0.0, -1.0, 0.0)]
    rays = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    tree = cut(octree.svo(frame(spark, cells), L), "svo")

    def enter(o, d, c):
        near, far = -np.inf, np.inf
        for a in range(3):
            s = d[a] if abs(d[a]) >= 1e-12 else 1e-12
            t = sorted(((c[a] - o[a]) / s, (c[a] + 1 - o[a]) / s))
            near, far = max(near, t[0]), min(far, t[1])
        return near, far

    got = {r.ray_id: r for r in viewer.first_hits(rays, tree, L).collect()}
    for i, *r in rows:
        o, d = r[:3], r[3:]
        hits = sorted((round(max(n, 0), 6), key(c)) for c in cells for n, f in [enter(o, d, c)] if f >= max(n, 0))
        assert (i in got) == bool(hits) and (not hits or (got[i].t, got[i].cell) == hits[0])
    hits = cut(viewer.first_hits(rays, tree, L), "hits")
    seen = viewer.occlusion(rays, hits, tree, L, 4, 2.0).collect()
    assert len(seen) == len(got) and all(0 <= r.visibility <= 1 and 0 <= r.blocked <= 4 for r in seen)
    assert viewer.shadows(rays, hits, tree, L, (100.0, 100.0, 100.0)).count() == len(got)
    assert viewer.projection_factor(0.5, 1.0, 100) == pytest.approx(100 / (2 * np.tan(0.25)))


def test_running_values(spark):
    rng = np.random.default_rng(3)
    value = [int(x) for x in rng.integers(0, 9, 400)]
    name = [f"m{i}" if rng.random() < 0.1 else None for i in range(400)]
    rows = [(i, value[i], name[i]) for i in rng.permutation(400).tolist()]
    df = spark.createDataFrame(rows, "i long, v long, name string").repartition(7)
    got = {r.i: r for r in order.carried(order.running_sum(df, ["i"], "v", "before"), "i", F.col("name"), "last").collect()}
    last = None
    for i in range(400):
        last = name[i] or last
        assert (got[i].before, got[i].last) == (sum(value[:i]), last)
    mean = {r.i: r.v for r in order.running_mean(df, "i", ["v"], 15).collect()}
    assert len(mean) == 386 and all(mean[i] == pytest.approx(np.mean(value[i : i + 15])) for i in mean)


def test_text_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    lines, faces, count = [], [], 0
    for k in range(3000):
        if k % 7 == 0:
            lines.append(f"usemtl m{k}")
        lines += [f"v {x:.3f} {x + 1:.3f} 0.5" for x in rng.random(3)]
        count += 3
        lines.append("f -3//1 -2//1 -1//1" if k % 2 else f"f {count - 2}/1/1 {count - 1}/1/1 {count}/1/1")
        faces.append((count - 2, count - 1, count, f"m{k - k % 7}"))
    (tmp_path / "a.obj").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = files.read_lines(spark, str(tmp_path / "a.obj"))
        assert [r.value for r in read.orderBy("line_no").collect()] == lines
        for _ in range(2):  # the second time from the cache
            vertices, got = files.read_obj(spark, str(tmp_path / "a.obj"), str(tmp_path / "cache"))
            assert vertices.count() == count
            assert [(r.i, r.j, r.k, r.material) for r in got.orderBy("line_no").collect()] == faces
        normal = meshes.normals(meshes.triangle_soup(vertices, got)).first()
        assert normal.nz == pytest.approx(0, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mtl = enumerate(["newmtl a", "Kd 0.1 0.2 0.3", "Ns 5", "newmtl b", "d 0.5", "Kd 1 1 1"])
    got = {r.name: r for r in meshes.materials(meshes.parse_mtl(spark.createDataFrame(mtl, "line_no long, value string"))).collect()}
    assert [round(x, 3) for x in got["a"].diffuse] == [0.1, 0.2, 0.3] and got["a"].exponent == 5 and got["b"].opacity == 0.5


def test_las_points(spark, tmp_path):
    points = [(1, 2, 3), (-4, 5, -6), (100, 200, 300)]
    head = bytearray(227)
    head[:4], head[25] = b"LASF", 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, len(points))
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.25, 10.0, 20.0, 30.0)
    (tmp_path / "a.las").write_bytes(bytes(head) + b"".join(struct.pack("<3i8x", *p) for p in points))
    got = files.read_las(spark, str(tmp_path / "a.las")).collect()
    assert [(r.x, r.y, r.z) for r in got] == [(x * 0.5 + 10, y * 0.5 + 20, z * 0.25 + 30) for x, y, z in points]
