"""Queries of the encoders, of merging, of hidden geometry and of the viewer, and the same in SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from octolith.operators import clusters as C
from octolith.operators import encodings as E
from octolith.operators import hidden as H
from octolith.operators import merging as M
from octolith.operators import octree as O
from octolith.operators import search as S
from octolith.operators import viewer as V
from octolith.plans.catalogue import _D, _TE, ADDR, DAG_SQL, GRID, KEYS, LEVELS, PEV, RAYS_SQL, REF_SQL, SQL, SVO_SQL, VOX, _axis, _key, _sat, box_of, pe_rays, pe_voxels, pl_dag, pv_points, query, voxels
from octolith.sources import files, meshes, tables
from octolith.storage import cut, shared

HEAD = {"box": [0.0] * 3 + [1.0] * 3, "side": 1.0, "levels": LEVELS, "nodes": 0, "first_leaf": 0}


def _path(spark, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


# ---- encoders ----


@query(f"""WITH {SVO_SQL}, o AS MATERIALIZED (SELECT *, (1 + sum(size) OVER (ORDER BY f, level) - size)::BIGINT AS block FROM
(SELECT level, key, child_mask, CASE WHEN level < {LEVELS - 1} THEN bit_count(child_mask) ELSE 0 END::BIGINT AS size, key << (3 * ({LEVELS - 1} - level)) AS f FROM svo))
SELECT (CASE WHEN c.level = 0 THEN 0 ELSE p.block + bit_count(p.child_mask >> ((c.key & 7)::INT + 1)) END)::BIGINT AS index,
(CASE WHEN c.level < {LEVELS - 1} THEN c.block ELSE 0 END)::BIGINT AS ptr, (bit_count(c.child_mask) * 65536 + c.child_mask)::BIGINT AS data FROM o c LEFT JOIN o p ON p.level = c.level - 1 AND p.key = c.key >> 3""")
def svo_words(spark, sf):
    return E.svo_words(cut(O.svo(voxels(spark, sf), LEVELS), "svo"), LEVELS)


def svo_sql() -> str:
    return SQL["svo_words"].replace("SELECT (CASE WHEN c.level = 0", ", w AS (SELECT (CASE WHEN c.level = 0", 1) + ")"


@query(f"{svo_sql()} SELECT index // 3 AS block, " + ", ".join(f"coalesce(max(CASE WHEN index % 3 = {i} THEN ptr END), 0)::BIGINT AS ptr{i}" for i in range(3)) + ", sum((data & 255) << (8 * (index % 3)))::BIGINT AS masks FROM w GROUP BY 1")
def svo_compact(spark, sf):
    return E.compact_svo(cut(svo_words(spark, sf), "words"))


@query(f"WITH {VOX} SELECT morton FROM vox")
def svo_file_roundtrip(spark, sf):
    path = _path(spark, "tree.svo")
    files.write_words(cut(svo_words(spark, sf), "words"), path, "svo", HEAD)
    return E.svo_decoded(cut(files.read_words(spark, path, "svo"), "words"), LEVELS)


@query(f"WITH {VOX} SELECT morton FROM vox")
def svdag_file_roundtrip(spark, sf):
    path = _path(spark, "graph.svdag")
    files.write_words(cut(O.svdag_words(pl_dag(spark, sf)), "words"), path, "svdag", HEAD)
    return svdag_voxels(spark, cut(files.read_words(spark, path, "svdag"), "words"))


def svdag_voxels(spark, words):
    rows = cut(meshes.svdag_decoded(words, LEVELS), "decoded")
    front = spark.range(1).select(F.lit(0).cast("long").alias("address"), F.lit(0).cast("long").alias("key"))
    for level in range(LEVELS - 1):
        step = rows.where(F.col("level") == level).select("address", "slot", "child")
        front = front.join(step, "address").select(F.col("child").alias("address"), (F.col("key") * 8 + F.col("slot")).alias("key"))
    leaf = front.join(rows.where(F.col("level") == LEVELS - 1).select("address", "child_mask"), "address")
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")
    return leaf.select("key", slots).select((F.col("key") * 8 + F.col("slot")).alias("morton"))


def pl_sdag(spark, sf):
    return cut(O.sdag(voxels(spark, sf), LEVELS), "sdag")


@query(f"WITH {VOX} SELECT morton FROM vox")
def ussvdag_file_roundtrip(spark, sf):
    path = _path(spark, "graph.ussvdag")
    files.write_words(cut(E.ussvdag_words(pl_sdag(spark, sf), LEVELS), "words"), path, "ussvdag", HEAD)
    return E.ussvdag_decoded(cut(files.read_words(spark, path, "ussvdag"), "words"), LEVELS)


@query(f"WITH {VOX} SELECT morton FROM vox")
def ssvdag_file_roundtrip(spark, sf):
    path = _path(spark, "graph.ssvdag")
    files.write_ssvdag(E.ssvdag(pl_sdag(spark, sf), LEVELS), path, HEAD)
    inner, bricks = files.read_ssvdag(spark, path)
    return E.ssvdag_decoded(cut(inner, "inner"), cut(bricks, "bricks"), LEVELS)


def _esvdag() -> str:
    last = LEVELS - 2
    out = [f"a{last} AS MATERIALIZED (SELECT node_id, refs, (row_number() OVER (ORDER BY refs DESC, node_id) - 1)::BIGINT AS addr, 8::BIGINT AS size, 0::BIGINT AS header FROM refs WHERE level = {last})"]
    for v in range(last - 1, -1, -1):
        out.append(f"""z{v} AS (SELECT e.node_id, (1 + sum(CASE WHEN c.addr < 8192 THEN 1 ELSE 2 END))::BIGINT AS size, sum((CASE WHEN c.addr < 8192 THEN 1 WHEN (c.addr & 536870912) <> 0 THEN 3 ELSE 2 END)::BIGINT << (2 * slot))::BIGINT AS header,
  sum(CASE WHEN c.addr < 8192 THEN 1 ELSE 0 END)::BIGINT AS p16, sum(CASE WHEN c.addr >= 8192 AND (c.addr & 536870912) = 0 THEN 1 ELSE 0 END)::BIGINT AS p28, sum(CASE WHEN (c.addr & 536870912) <> 0 THEN 1 ELSE 0 END)::BIGINT AS p29
  FROM edge e JOIN a{v + 1} c ON c.node_id = e.child_id WHERE e.level = {v} GROUP BY 1),
a{v} AS MATERIALIZED (SELECT node_id, refs, (sum(size) OVER (ORDER BY refs DESC, node_id) - size)::BIGINT AS addr, size, header, p16, p28, p29 FROM z{v} JOIN refs USING (node_id) WHERE refs.level = {v})""")
    return f"{REF_SQL}, {', '.join(out)}"


ESVDAG = _esvdag()


def pl_esvdag(spark, sf):
    return E.ssvdag(E.mirrored(pl_dag(spark, sf)), LEVELS)


@query(f"WITH {ESVDAG} " + " UNION ALL ".join(f"SELECT {v} AS level, node_id, addr AS address, header, size FROM a{v}" for v in range(LEVELS - 2)))
def esvdag_nodes(spark, sf):
    return pl_esvdag(spark, sf).inner.select("level", "node_id", "address", "header", F.size("words").cast("long").alias("size"))


_OFF = "(16 * (2 * ((slot >> 2) & 1) + ((j >> 2) & 1)) + 4 * (2 * ((slot >> 1) & 1) + ((j >> 1) & 1)) + 2 * (slot & 1) + (j & 1))"


@query(f"""WITH {ESVDAG}, b AS (SELECT e.node_id, {_OFF} AS off FROM edge e JOIN nodes m ON m.level = {LEVELS - 1} AND m.node_id = e.child_id, range(8) t(j) WHERE e.level = {LEVELS - 2} AND ((m.child_mask >> j::INT) & 1) = 1)
SELECT addr AS rank, bit_or(CASE WHEN off < 32 THEN 1::BIGINT << off ELSE 0 END)::BIGINT AS low, bit_or(CASE WHEN off >= 32 THEN 1::BIGINT << (off - 32) ELSE 0 END)::BIGINT AS high FROM b JOIN a{LEVELS - 2} USING (node_id) GROUP BY 1""")
def esvdag_bricks(spark, sf):
    low = F.lit(0xFFFFFFFF).cast("long")
    return pl_esvdag(spark, sf).bricks.select("rank", F.col("brick").bitwiseAND(low).alias("low"), F.shiftright("brick", 32).bitwiseAND(low).alias("high"))


@query(f"WITH {ESVDAG} " + " UNION ALL ".join(f"SELECT {v} AS level, count(*) AS nodes, sum(p16)::BIGINT AS ptr16, sum(p28)::BIGINT AS ptr28, sum(p29)::BIGINT AS ptr29, sum(size)::BIGINT AS words FROM a{v}" for v in range(LEVELS - 2)))
def esvdag_pointers(spark, sf):
    out = E.pointer_statistics(pl_esvdag(spark, sf))
    return out.select("level", *(F.col(c).cast("long").alias(c) for c in out.columns[1:]))


@query(f"""WITH {ESVDAG}, k AS (SELECT level, refs, (row_number() OVER (PARTITION BY level ORDER BY refs DESC, node_id) - 1) // greatest(count(*) OVER (PARTITION BY level) // 10, 1) AS bin FROM refs WHERE level < {LEVELS - 1}),
b AS (SELECT level, bin, sum(refs) AS refs FROM k WHERE bin < 10 GROUP BY 1, 2)
SELECT level, bin::BIGINT AS bin, floor(refs * 100 / t)::BIGINT AS share FROM (SELECT *, sum(refs) OVER (PARTITION BY level) AS t FROM b) WHERE t > 0""")
def reference_shares(spark, sf):
    return E.reference_shares(pl_esvdag(spark, sf))


# ---- nodes ----


@query(f"WITH {SVO_SQL}, o AS (" + " UNION ALL ".join(f"SELECT {v} AS level, morton >> {3 * (LEVELS - v)} AS k, list(morton & {8 ** (LEVELS - v) - 1}) AS m FROM vox GROUP BY 1, 2" for v in range(LEVELS)) + ") SELECT level, count(DISTINCT least(" + ", ".join(f"list_sort(list_transform(m, lambda x: xor(x, {g} * {(8 ** LEVELS - 1) // 7} & (8 ** ({LEVELS} - level) - 1)::BIGINT)))" for g in range(8)) + ")) AS sdag_nodes FROM o GROUP BY level")
def sdag_levels(spark, sf):
    return O.sdag(voxels(spark, sf), LEVELS).groupBy("level").agg(F.count("*").alias("sdag_nodes"))


@query(f"WITH {DAG_SQL} SELECT level, node_id, (SELECT count(*) FROM vox WHERE morton >> (3 * ({LEVELS} - level)) = node_id) AS voxels FROM nodes")
def subtree_voxels(spark, sf):
    return M.subtree_voxels(pl_dag(spark, sf))


@query(f"WITH {REF_SQL} SELECT level, node_id, row_number() OVER (PARTITION BY level ORDER BY paths DESC, node_id) - 1 AS rank FROM refs")
def node_ranks(spark, sf):
    d = pl_dag(spark, sf)
    return M.renumbered(d, O.ref_counts(d), "paths")


@query(f"WITH {DAG_SQL} SELECT 'empty' AS fault, level, node_id FROM nodes WHERE child_mask = 0 UNION ALL SELECT 'unreferenced', level, node_id FROM nodes n WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.level = n.level - 1 AND e.child_id = n.node_id)")
def integrity(spark, sf):
    return M.integrity(pl_dag(spark, sf))


# ---- merging ----

_L3 = LEVELS - 3
SIMILAR = f"""{DAG_SQL}, top AS MATERIALIZED (SELECT e.node_id, list(e.slot * 256 + m.child_mask ORDER BY e.slot) AS shape FROM edge e JOIN nodes m ON m.level = {_L3 + 1} AND m.node_id = e.child_id WHERE e.level = {_L3} GROUP BY 1),
leaf AS MATERIALIZED (SELECT e.node_id, e.slot * 8 + f.slot AS place, m.child_mask AS mask FROM edge e JOIN edge f ON f.level = {_L3 + 1} AND f.node_id = e.child_id JOIN nodes m ON m.level = {_L3 + 2} AND m.node_id = f.child_id WHERE e.level = {_L3}),
cand AS MATERIALIZED (SELECT p.node_id AS a, q.node_id AS b FROM top p JOIN top q ON p.shape = q.shape AND p.node_id > q.node_id),
near AS (SELECT a, b, sum(bit_count(xor(x.mask, y.mask)))::BIGINT AS diff, count(*) AS leaves, max(bit_count(xor(x.mask, y.mask))) AS most FROM cand JOIN leaf x ON x.node_id = a JOIN leaf y ON y.node_id = b AND y.place = x.place GROUP BY 1, 2)"""


@query(f"WITH {SIMILAR} SELECT a AS src, b AS dst, diff, round(1 - diff / 10, 6) AS weight FROM near WHERE most <= 4 AND diff <= 9 AND diff < 4 * leaves")
def similar_subtrees(spark, sf):
    d = pl_dag(spark, sf)
    every = d.nodes.where(F.col("level") == _L3).select("node_id")
    return M.similar_pairs(d, _L3, every).withColumn("weight", F.round("weight", 6))


@query()
def lossy_levels(spark, sf):
    d, _, _ = M.lossy_dag(pl_dag(spark, sf))
    return d.nodes.groupBy("level").agg(F.count("*").alias("nodes"))


@query()
def lossy_losses(spark, sf):
    return M.lossy_dag(pl_dag(spark, sf))[2]


def _matches() -> str:
    out = [DAG_SQL, "t1 AS MATERIALIZED (SELECT level, node_id, child_mask::VARCHAR AS n FROM nodes WHERE level > 0)"]
    for d in range(2, LEVELS):
        out.append(f"t{d} AS MATERIALIZED (SELECT e.level, e.node_id, any_value(m.child_mask)::VARCHAR || '(' || string_agg(slot || ':' || c.n, ',' ORDER BY slot) || ')' AS n FROM edge e JOIN t{d - 1} c ON c.level = e.level + 1 AND c.node_id = e.child_id JOIN nodes m ON m.level = e.level AND m.node_id = e.node_id WHERE e.level BETWEEN 1 AND {LEVELS - d} GROUP BY 1, 2)")
    out.append("look2 AS (SELECT DISTINCT child_id AS node_id FROM edge WHERE level = 1)")
    for v in range(2, LEVELS):
        out.append(f"m{v}x AS MATERIALIZED (SELECT node_id, to_level, to_id FROM (SELECT a.node_id, b.level AS to_level, b.node_id AS to_id, row_number() OVER (PARTITION BY a.node_id ORDER BY b.level, b.node_id) AS r FROM t{LEVELS - v} a JOIN t{LEVELS - v} b ON a.n = b.n AND b.level < {v} WHERE a.level = {v} AND a.node_id IN (SELECT node_id FROM look{v})) WHERE r = 1)")
        if v < LEVELS - 1:
            out.append(f"look{v + 1} AS MATERIALIZED (SELECT DISTINCT child_id AS node_id FROM edge WHERE level = {v} AND node_id IN (SELECT node_id FROM look{v}) AND node_id NOT IN (SELECT node_id FROM m{v}x))")
    return ", ".join(out)


@query(f"WITH {_matches()} " + " UNION ALL ".join(f"SELECT {v} AS level, node_id, to_level, to_id FROM m{v}x" for v in range(2, LEVELS)))
def cross_level_matches(spark, sf):
    return M.cross_level_matches(pl_dag(spark, sf))


@query(f"WITH {VOX} SELECT morton FROM vox")
def cross_level_roundtrip(spark, sf):
    return M.expand_linked(M.merge_levels(pl_dag(spark, sf)))


@query()
def cross_level_levels(spark, sf):
    return M.merge_levels(pl_dag(spark, sf)).nodes.groupBy("level").agg(F.count("*").alias("nodes"))


@query(f"WITH RECURSIVE {KEYS}, pairs AS MATERIALIZED (SELECT a.node_id AS src, b.node_id AS dst FROM k a JOIN k b ON a.node_id > b.node_id AND {' + '.join(f'bit_count(xor(a.w{i}, b.w{i}))' for i in range(8))} = 1), e AS (SELECT src AS n FROM pairs UNION ALL SELECT dst FROM pairs), d AS (SELECT n, count(*) AS links FROM e GROUP BY 1) SELECT links, count(*) AS nodes FROM d GROUP BY 1")
def link_counts(spark, sf):
    p = cut(C.hamming1_pairs(cut(C.leaf_keys(pl_dag(spark, sf)), "keys")), "pairs")
    each = p.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("links"))
    return each.groupBy("links").agg(F.count("*").alias("nodes"))


# ---- hidden geometry ----

_GRID = f"""{PEV}, g AS MATERIALIZED (SELECT i::BIGINT AS key, {", ".join(f"{_axis('i', k, GRID)} AS {a}" for k, a in enumerate("xyz"))}, i IN (SELECT morton FROM vox) AS solid FROM range({8**GRID}) t(i)),
near AS MATERIALIZED (SELECT a.key, b.key AS other FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
f(key) AS (SELECT key FROM g WHERE key = {8**GRID - 1} AND NOT solid UNION SELECT other FROM f JOIN near USING (key) JOIN g ON g.key = other WHERE NOT g.solid)"""


@query(f"WITH RECURSIVE {_GRID}, seen AS MATERIALIZED (SELECT key FROM f UNION SELECT other FROM f JOIN near USING (key)), n AS (" + " UNION ALL ".join(f"SELECT DISTINCT {v} AS level, morton >> {3 * (GRID - v)} AS key FROM vox" for v in range(GRID)) + ") SELECT level, key, coalesce(" + "CASE level " + " ".join(f"WHEN {v} THEN (SELECT bit_or(1 << ((seen.key >> {3 * (GRID - v - 1)}) & 7)::INT) FROM seen WHERE seen.key >> {3 * (GRID - v)} = n.key)" for v in range(GRID)) + " END, 0)::INT AS outside_mask FROM n")
def outside_masks(spark, sf):
    return H.outside_masks(cut(O.svo(pe_voxels(spark, sf), GRID), "svo"), GRID)


@query()
def visible_merge(spark, sf):
    tree = cut(O.svo(pe_voxels(spark, sf), GRID), "svo")
    return H.visible_merge(tree, cut(H.outside_masks(tree, GRID), "masks"), GRID)


# ---- viewer ----


@query(f"WITH {DAG_SQL}, pv AS (SELECT event_id AS id, ({_key('(user_id % 64)::BIGINT', '(floor(value) % 64)::BIGINT', '(event_id % 64)::BIGINT', 6)})::BIGINT AS morton FROM events) SELECT id, coalesce((SELECT node_id FROM cells WHERE level = 4 AND key = morton >> 6), -1) AS node_id FROM pv")
def node_at_level(spark, sf):
    d = pl_dag(spark, sf)
    at = d.cells.where("level = 4").select("key", "node_id")
    p = pv_points(spark, sf).withColumn("key", F.shiftright("morton", 6))
    return p.join(at, "key", "left").select("id", F.coalesce("node_id", F.lit(-1)).alias("node_id"))


def _tree(spark, sf):
    return cut(O.svo(pe_voxels(spark, sf), GRID), "svo")


_CELLS = " UNION ALL ".join(f"SELECT DISTINCT {v} AS level, morton >> {3 * (GRID - v)} AS cell FROM vox" for v in range(1, GRID + 1))
_LOW = {a: "(CASE level " + " ".join(f"WHEN {v} THEN {_axis('cell', k, v)} * {1 << (GRID - v)}" for v in range(1, GRID + 1)) + " END)::DOUBLE" for k, a in enumerate("xyz")}
LOD = 0.35
_RAY_CELLS = f"""{RAYS_SQL}, c AS MATERIALIZED (SELECT level, cell, (1 << ({GRID} - level))::DOUBLE AS size, {", ".join(f"{v} AS {a}" for a, v in _LOW.items())} FROM ({_CELLS})),
s AS (SELECT ray_id, level, cell, size, greatest({", ".join(f"least(({a} - o{a}) / {d}, ({a} + size - o{a}) / {d})" for a, d in zip("xyz", _D))}) AS near, least({", ".join(f"greatest(({a} - o{a}) / {d}, ({a} + size - o{a}) / {d})" for a, d in zip("xyz", _D))}) AS far FROM ray, c),
h AS MATERIALIZED (SELECT *, greatest(near, 0) AS t, level = {GRID} OR size * {LOD} < greatest(near, 0) AS stop FROM s WHERE far >= greatest(near, 0))"""


@query(f"WITH {_RAY_CELLS} SELECT ray_id, min(round(t, 6)) AS t, arg_min(level, (round(t, 6), level, cell))::INT AS level, arg_min(cell, (round(t, 6), level, cell)) AS cell FROM h WHERE stop AND NOT EXISTS (SELECT 1 FROM h u WHERE u.ray_id = h.ray_id AND u.level < h.level AND u.stop AND u.cell = h.cell >> (3 * (h.level - u.level))) GROUP BY 1")
def ray_lod(spark, sf):
    return V.first_hits(pe_rays(spark, sf), _tree(spark, sf), GRID, projection=LOD).select("ray_id", "t", "level", "cell")


#: The first voxel of each ray with the normal of the side it is entered by.
_ENTER = {a: f"least(({a} - o{a}) / {d}, ({a} + 1 - o{a}) / {d})" for a, d in zip("xyz", _D)}
HITS = f"""{RAYS_SQL}, fh AS MATERIALIZED (SELECT ray_id, min(t) AS t, arg_min(morton, (t, morton)) AS cell FROM hit GROUP BY 1),
en AS (SELECT ray_id, fh.t, cell, ox, oy, oz, dx, dy, dz, {", ".join(f"{v} AS e{a}" for a, v in _ENTER.items())} FROM fh JOIN ray USING (ray_id) JOIN v ON v.morton = fh.cell),
hn AS MATERIALIZED (SELECT *, (CASE WHEN greatest(ex, ey, ez) > 0 AND ex >= ey AND ex >= ez THEN -sign(dx) ELSE 0 END)::INT AS nx, (CASE WHEN greatest(ex, ey, ez) > 0 AND ey > ex AND ey >= ez THEN -sign(dy) ELSE 0 END)::INT AS ny, (CASE WHEN greatest(ex, ey, ez) > 0 AND ez > ex AND ez > ey THEN -sign(dz) ELSE 0 END)::INT AS nz FROM en)"""


@query(f"WITH {HITS} SELECT ray_id, t, cell, nx, ny, nz FROM hn")
def ray_normals(spark, sf):
    return V.first_hits(pe_rays(spark, sf), _tree(spark, sf), GRID).select("ray_id", "t", "cell", "nx", "ny", "nz")


LIGHT = (40.0, 55.0, 25.0)


def _slabs(o: list[str], d: list[str]) -> tuple[str, str]:
    safe = [f"(CASE WHEN abs({x}) < 1e-12 THEN 1e-12 ELSE {x} END)" for x in d]
    return tuple(f"{outer}({', '.join(f'{inner}((v.{a} - {p}) / {s}, (v.{a} + 1 - {p}) / {s})' for a, p, s in zip('xyz', o, safe))})" for outer, inner in (("greatest", "least"), ("least", "greatest")))


_SN, _SF = _slabs(["px", "py", "pz"], ["qx", "qy", "qz"])


@query(f"""WITH {HITS}, p AS (SELECT ray_id, {", ".join(f"o{a} + t * d{a} + n{a} * 0.5 AS p{a}" for a in "xyz")} FROM hn),
l AS (SELECT *, sqrt({" + ".join(f"({v} - p{a}) * ({v} - p{a})" for v, a in zip(LIGHT, "xyz"))}) AS reach FROM p), q AS MATERIALIZED (SELECT *, {", ".join(f"({v} - p{a}) / reach AS q{a}" for v, a in zip(LIGHT, "xyz"))} FROM l)
SELECT ray_id, EXISTS (SELECT 1 FROM v WHERE greatest({_SN}, {V.CLOSE}) <= least({_SF}, reach)) AS shadow FROM q""")
def ray_shadows(spark, sf):
    rays, tree = cut(pe_rays(spark, sf), "rays"), _tree(spark, sf)
    return V.shadows(rays, cut(V.first_hits(rays, tree, GRID), "hits"), tree, GRID, LIGHT)


SAMPLES, REACH = 8, 3.0
_HALTON = """h AS (SELECT i, b, i AS n, 1.0::DOUBLE / b AS f, 0.0::DOUBLE AS r FROM range(1, {n} + 1) a(i), (VALUES (2), (3)) w(b) UNION ALL SELECT i, b, n // b, f / b, r + f * (n % b) FROM h WHERE n > 0),
hs AS MATERIALIZED (SELECT x.i, sqrt(1 - x.r) * cos(y.r * 2 * pi()) AS sx, sqrt(x.r) AS sy, sqrt(1 - x.r) * sin(y.r * 2 * pi()) AS sz FROM h x JOIN h y ON x.i = y.i AND x.b = 2 AND y.b = 3 AND x.n = 0 AND y.n = 0)"""


@query(f"WITH RECURSIVE {_HALTON.replace('{n}', '256')} SELECT i::BIGINT AS i, round(sx, 6) AS x, round(sy, 6) AS y, round(sz, 6) AS z FROM hs")
def hemisphere(spark, sf):
    return V.hemisphere(256, spark).select("i", *(F.round(a, 6).alias(a) for a in "xyz"))


@query(f"""WITH RECURSIVE {HITS}, {_HALTON.replace('{n}', str(SAMPLES))}, p AS (SELECT ray_id, nx, ny, nz, {", ".join(f"o{a} + t * d{a} + n{a} * {V.CLOSE} AS p{a}" for a in "xyz")}, (CASE WHEN ny = 0 THEN 1 ELSE 0 END) AS up FROM hn),
q AS MATERIALIZED (SELECT ray_id, px, py, pz, (1 - up) * sx + nx * sy + (ny * 0 - nz * up) * sz AS qx, up * sx + ny * sy + (nz * (1 - up) - nx * 0) * sz AS qy, nz * sy + (nx * up - ny * (1 - up)) * sz AS qz FROM p, hs WHERE nx <> 0 OR ny <> 0 OR nz <> 0),
k AS (SELECT ray_id, count(*) AS n FROM q WHERE EXISTS (SELECT 1 FROM v WHERE greatest({_SN}, {V.CLOSE}) <= least({_SF}, {REACH})) GROUP BY 1)
SELECT ray_id, coalesce(n, 0) AS blocked, round(pow(1 - coalesce(n, 0) / {SAMPLES}, 2), 6) AS visibility FROM p LEFT JOIN k USING (ray_id)""")
def ray_occlusion(spark, sf):
    rays, tree = cut(pe_rays(spark, sf), "rays"), _tree(spark, sf)
    return V.occlusion(rays, cut(V.first_hits(rays, tree, GRID), "hits"), tree, GRID, SAMPLES, REACH)


@query(f"""WITH {RAYS_SQL}, u AS (SELECT ray_id, ox, oy, oz, {", ".join(f"d{a} / sqrt(dx * dx + dy * dy + dz * dz) AS u{a}" for a in "xyz")} FROM ray), m AS (SELECT ray_id, step, {", ".join(f"floor(o{a} + u{a} * 0.5 * step)::BIGINT AS {a}" for a in "xyz")} FROM u, range(1, 1025) r(step)),
i AS (SELECT ray_id, step, ({_key("x", "y", "z", GRID)})::BIGINT AS cell FROM m WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 AND z BETWEEN 0 AND 15)
SELECT ray_id, min(step)::INT AS step, arg_min(cell, step) AS cell FROM i WHERE cell IN (SELECT morton FROM vox) GROUP BY 1""")
def march_pick(spark, sf):
    return V.picked(pe_rays(spark, sf), _tree(spark, sf), GRID, GRID)


CAMERA = {"position": [40.0, 30.0, 50.0], "target": [8.0, 8.0, 8.0], "up": [0.0, 1.0, 0.0], "fov": 0.6, "width": 48, "height": 32}


def _camera_sql() -> str:
    right, above, forward = V.camera(CAMERA["position"], CAMERA["target"], CAMERA["up"])
    tan, w, h = math.tan(CAMERA["fov"] / 2), CAMERA["width"], CAMERA["height"]
    d = [f"{r!r}::DOUBLE * sx + {u!r}::DOUBLE * sy + {f!r}::DOUBLE AS d{a}" for r, u, f, a in zip(right, above, forward, "xyz")]
    return f"p AS (SELECT id AS ray_id, id % {w} AS x, id // {w} AS y FROM range({w * h}) g(id)), s AS (SELECT *, ((x + 0.5::DOUBLE) / {w} * 2 - 1) * {tan * w / h!r}::DOUBLE AS sx, ((y + 0.5::DOUBLE) / {h} * 2 - 1) * {tan!r}::DOUBLE AS sy FROM p), c AS (SELECT ray_id, x, y, {', '.join(d)} FROM s)"


@query(f"WITH {_camera_sql()} SELECT ray_id, x, y, " + ", ".join(f"round(d{a} / sqrt(dx * dx + dy * dy + dz * dz), 6) AS d{a}" for a in "xyz") + " FROM c")
def camera_rays(spark, sf):
    return V.camera_rays(spark, **CAMERA).select("ray_id", "x", "y", *(F.round(f"d{a}", 6).alias(f"d{a}") for a in "xyz"))


@query(f"""WITH {HITS}, p AS (SELECT ray_id, t, nx, ny, nz, {", ".join(f"{v} - (o{a} + t * d{a}) AS l{a}" for v, a in zip(LIGHT, "xyz"))} FROM hn), q AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS r FROM p)
SELECT ray_id, round(t / 27.5, 6) AS depth, round(0.5 + 0.5 * greatest((lx * nx + ly * ny + lz * nz) / r, 0) - 0.2 * r / 27.5, 6) AS diffuse FROM q""")
def ray_shading(spark, sf):
    rays = cut(pe_rays(spark, sf), "rays")
    return V.shaded(rays, cut(V.first_hits(rays, _tree(spark, sf), GRID), "hits"), LIGHT, 27.5)


@query(f"WITH {REF_SQL}, k AS (SELECT level, node_id, row_number() OVER (PARTITION BY level ORDER BY paths DESC, node_id) - 1 AS rank, count(*) OVER (PARTITION BY level) AS n FROM refs), c AS (SELECT *, (rank % 100) / 100 AS x, (3 * rank % 200) / 200 AS y, (2 * rank % 300) / 300 AS z FROM k) SELECT level, node_id, " + ", ".join(f"round(CASE WHEN x * x + y * y + z * z > 0 THEN {v} / sqrt(x * x + y * y + z * z) ELSE 0 END, 6) AS {n}" for v, n in zip("xyz", "rgb")) + ", round(1 - pow(1 - rank / n, 2), 6) AS rare FROM c")
def node_colours(spark, sf):
    return V.node_colours(cut(node_ranks(spark, sf), "ranks"))


# ---- geometry ----


@query(f"""WITH r AS (SELECT {", ".join(f"min({c}) {a}0, max({c}) {a}1" for a, c in (("x", "l_quantity"), ("y", "l_extendedprice"), ("z", "l_discount")))} FROM lineitem), b AS (SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) AS side FROM r),
c AS (SELECT {", ".join(f"floor(({c} - ({a}0 + {a}1 - side) / 2) / (({a}0 + {a}1 + side) / 2 - ({a}0 + {a}1 - side) / 2) * 64)::BIGINT AS {a}" for a, c in (("x", "l_quantity"), ("y", "l_extendedprice"), ("z", "l_discount")))} FROM lineitem, b)
SELECT DISTINCT ({_key("x", "y", "z", LEVELS)})::BIGINT AS morton FROM c WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 AND z BETWEEN 0 AND 63""")
def voxelize_cube(spark, sf):
    return O.voxelize(tables.points_lineitem(spark, sf), LEVELS, cube=True, mode="reference")


@query(f"""WITH t AS (SELECT vec_id AS tri_id, {", ".join(f"(embedding[{i + 1}]::DOUBLE + 1) * 4 AS {chr(34)}{n}{chr(34)}" for i, n in enumerate(_TE))} FROM embeddings),
cell AS (SELECT i AS morton, {", ".join(f"{_axis('i', k, 3)} + 0.5 AS m{a}" for k, a in enumerate("xyz"))} FROM range(512) g(i))
SELECT morton::BIGINT AS morton, arg_max(tri_id % 7, tri_id)::BIGINT AS material FROM t, cell WHERE {_sat(["mx", "my", "mz"], "0.5")} GROUP BY 1""")
def voxel_materials(spark, sf):
    t = tables.embedding_columns(spark, sf, _TE, 4.0, 1.0).withColumnRenamed("vec_id", "tri_id")
    return S.voxelize_triangles(t, 3).groupBy("morton").agg(F.max_by(F.col("tri_id") % 7, "tri_id").alias("material"))


@query(f"WITH {VOX} SELECT morton, " + ", ".join(f"round(x0 + (x1 - x0) * ({_axis('morton', 0, 6)} + 0.5) / 64, 6) AS x" if a == "x" else f"round(({_axis('morton', k, 6)} + 0.5) / 64, 6) AS {a}" for k, a in enumerate("xyz")) + " FROM vox, r")
def voxel_centres(spark, sf):
    box = box_of(tables.points_lineitem(spark, sf))
    return S.centres(voxels(spark, sf), LEVELS, [box[0], (0.0, 1.0), (0.0, 1.0)]).select("morton", *(F.round(a, 6).alias(a) for a in "xyz"))


@query(f"""WITH r AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem),
c AS (SELECT DISTINCT greatest(0, least(63, floor((l_quantity - x0) / (x1 - x0) * 64)))::BIGINT x, greatest(0, least(63, floor((l_extendedprice - y0) / (y1 - y0) * 64)))::BIGINT y FROM lineitem, r)
SELECT level, count(*) AS nodes FROM (SELECT DISTINCT v AS level, x >> (6 - v) AS x, y >> (6 - v) AS y FROM c, range(6) t(v)) GROUP BY 1""")
def quadtree_levels(spark, sf):
    box = box_of(tables.points_lineitem(spark, sf))[:2]
    flat = tables.points_lineitem(spark, sf).withColumn("z", F.lit(0.0))
    return O.svo(cut(O.voxelize(flat, LEVELS, [*box, (0.0, 1.0)]), "flat"), LEVELS).groupBy("level").agg(F.count("*").alias("nodes"))


@query(f"WITH {ADDR} SELECT sum(size)::BIGINT AS words, min(CASE WHEN level = {LEVELS - 1} THEN address END)::BIGINT AS first_leaf FROM addr")
def svdag_head(spark, sf):
    a = O.svdag_addresses(pl_dag(spark, sf))
    return a.agg(F.sum("size").alias("words"), F.min(F.when(F.col("level") == LEVELS - 1, F.col("address"))).alias("first_leaf"))
