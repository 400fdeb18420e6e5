"""The queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.functions.morton import axis_of, bits, canonical_mask, interleave, mirror_mask
from octolith.operators import clusters as C
from octolith.operators import octree as O
from octolith.operators import search as S
from octolith.operators import viewer as V
from octolith.sources import meshes, tables
from octolith.storage import cut

LEVELS = 6
#: Elements of the embeddings lie within (-1, 1); PE voxels are a grid of 16 over that range.
GRID = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def box_of(points: DataFrame) -> list[tuple[float, float]]:
    r = O.scene_bbox(points).first()
    return [(r["min_x"], r["max_x"]), (r["min_y"], r["max_y"]), (0.0, 0.1)]


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points_lineitem(spark, sf_dir)
    return cut(O.voxelize(p, LEVELS, box_of(p)), "voxels")


def pl_dag(spark: SparkSession, sf_dir: str) -> O.Dag:
    return O.dag(voxels(spark, sf_dir), LEVELS)


def pe_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(O.voxelize(tables.points_embeddings(spark, sf_dir), GRID, [(-1.0, 1.0)] * 3), "voxels")


# ---- the same in SQL ----


def _key(x: str, y: str, z: str, levels: int) -> str:
    return " | ".join(f"((({a} >> {i}) & 1) << {3 * i + b})" for i in range(levels) for a, b in ((x, 2), (y, 1), (z, 0)))


def _axis(key: str, axis: int, levels: int) -> str:
    return "(" + " | ".join(f"((({key} >> {3 * i + 2 - axis}) & 1) << {i})" for i in range(levels)) + ")"


VOX = f"""r AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem),
cell AS (SELECT greatest(0, least(63, floor((l_quantity - x0) / (x1 - x0) * 64)))::BIGINT x, greatest(0, least(63, floor((l_extendedprice - y0) / (y1 - y0) * 64)))::BIGINT y,
  greatest(0, least(63, floor(l_discount / 0.1 * 64)))::BIGINT z FROM lineitem, r),
vox AS MATERIALIZED (SELECT DISTINCT ({_key("x", "y", "z", 6)})::BIGINT AS morton FROM cell)"""
PEV = f"""vox AS MATERIALIZED (SELECT DISTINCT ({_key("x", "y", "z", 4)})::BIGINT AS morton FROM (SELECT {", ".join(f"greatest(0, least(15, floor((embedding[{i + 1}]::DOUBLE + 1) / 2 * 16)))::BIGINT {a}" for i, a in enumerate("xyz"))} FROM embeddings))"""


def _svo() -> str:
    out, below = [], "SELECT morton AS key FROM vox"
    for level in range(LEVELS - 1, -1, -1):
        out.append(f"s{level} AS MATERIALIZED (SELECT key >> 3 AS key, bit_or(1 << (key & 7)::INT)::INT AS child_mask FROM ({below}) GROUP BY 1)")
        below = f"SELECT key FROM s{level}"
    union = " UNION ALL ".join(f"SELECT {v} AS level, key, child_mask FROM s{v}" for v in range(LEVELS))
    return f"{VOX}, {', '.join(out)}, svo AS ({union})"


def _dag() -> str:
    cs = ", ".join(O.SLOTS)
    out = [f"h{LEVELS - 1} AS (SELECT key, child_mask, {', '.join(f'-1::BIGINT AS {c}' for c in O.SLOTS)} FROM s{LEVELS - 1})"]
    for level in range(LEVELS - 1, -1, -1):
        if level < LEVELS - 1:
            kids = ", ".join(f"coalesce(max(CASE WHEN (key & 7) = {i} THEN node_id END), -1) AS {c}" for i, c in enumerate(O.SLOTS))
            out.append(f"h{level} AS (SELECT key >> 3 AS key, bit_or(1 << (key & 7)::INT)::INT AS child_mask, {kids} FROM m{level + 1} GROUP BY 1)")
        out.append(f"m{level} AS MATERIALIZED (SELECT key, child_mask, {cs}, min(key) OVER (PARTITION BY child_mask, {cs}) AS node_id FROM h{level})")
    cells = " UNION ALL ".join(f"SELECT {v} AS level, key, node_id FROM m{v}" for v in range(LEVELS))
    nodes = " UNION ALL ".join(f"SELECT {v} AS level, node_id, child_mask, {cs} FROM m{v} WHERE key = node_id" for v in range(LEVELS))
    edge = " UNION ALL ".join(f"SELECT level, node_id, {i} AS slot, {c} AS child_id FROM nodes WHERE {c} >= 0" for i, c in enumerate(O.SLOTS))
    return f"{_svo()}, {', '.join(out)}, cells AS ({cells}), nodes AS MATERIALIZED ({nodes}), edge AS MATERIALIZED ({edge})"


def _refs() -> str:
    out = ["p0 AS (SELECT node_id, 0::BIGINT AS refs, 1::BIGINT AS paths FROM nodes WHERE level = 0)"]
    out += [f"p{v} AS MATERIALIZED (SELECT child_id AS node_id, count(*) AS refs, sum(paths)::BIGINT AS paths FROM p{v - 1} JOIN edge USING (node_id) WHERE level = {v - 1} GROUP BY 1)" for v in range(1, LEVELS)]
    union = " UNION ALL ".join(f"SELECT {v} AS level, node_id, refs, paths FROM p{v}" for v in range(LEVELS))
    return f"{_dag()}, {', '.join(out)}, refs AS ({union})"


SVO_SQL, DAG_SQL, REF_SQL = _svo(), _dag(), _refs()
ADDR = f"""{DAG_SQL}, addr AS MATERIALIZED (SELECT level, node_id, child_mask, size, (sum(size) OVER (ORDER BY level, node_id) - size)::BIGINT AS address
  FROM (SELECT *, (CASE WHEN level = {LEVELS - 1} THEN 1 ELSE 1 + bit_count(child_mask) END)::BIGINT AS size FROM nodes))"""


# ---- sources and voxels ----


@query("""SELECT 'lineitem' AS source, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_extendedprice) AS min_y, max(l_extendedprice) AS max_y, min(l_discount) AS min_z, max(l_discount) AS max_z FROM lineitem
UNION ALL SELECT 'embeddings', min(embedding[1])::DOUBLE, max(embedding[1])::DOUBLE, min(embedding[2])::DOUBLE, max(embedding[2])::DOUBLE, min(embedding[3])::DOUBLE, max(embedding[3])::DOUBLE FROM embeddings
UNION ALL SELECT 'events', min(floor(epoch(ts))), max(floor(epoch(ts))), min(user_id)::DOUBLE, max(user_id)::DOUBLE, min(value), max(value) FROM events""")
def scene_bbox(spark, sf):
    parts = [("lineitem", tables.points_lineitem), ("embeddings", tables.points_embeddings), ("events", tables.points_events)]
    rows = [O.scene_bbox(f(spark, sf)).withColumn("source", F.lit(n)) for n, f in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {VOX} SELECT morton FROM vox")
def voxelize_points(spark, sf):
    p = tables.points_lineitem(spark, sf)
    return O.voxelize(p, LEVELS, box_of(p))


@query(f"WITH {SVO_SQL} SELECT sum(bit_count(child_mask))::BIGINT AS voxels FROM s{LEVELS - 1}")
def voxel_count(spark, sf):
    return O.svo(voxels(spark, sf), LEVELS).where(F.col("level") == LEVELS - 1).agg(F.sum(bits(F.col("child_mask"))).alias("voxels"))


@query(f"WITH {VOX} SELECT DISTINCT x, y, z, ({_key('x', 'y', 'z', 6)})::BIGINT AS again FROM cell")
def morton_roundtrip(spark, sf):
    x = voxels(spark, sf).select(*(axis_of(F.col("morton"), i, LEVELS).alias(a) for i, a in enumerate("xyz")))
    return x.withColumn("again", interleave(F.col("x"), F.col("y"), F.col("z"), LEVELS))


@query(f"WITH {SVO_SQL} SELECT level, count(*) AS svo_nodes FROM svo GROUP BY level")
def svo_levels(spark, sf):
    return O.svo(voxels(spark, sf), LEVELS).groupBy("level").agg(F.count("*").alias("svo_nodes"))


@query(f"WITH {SVO_SQL} SELECT level, key, child_mask FROM svo")
def svo_child_masks(spark, sf):
    return O.svo(voxels(spark, sf), LEVELS)


@query(f"WITH {SVO_SQL} SELECT level, sum(bit_count(child_mask))::BIGINT AS children FROM svo GROUP BY level")
def popcount_by_level(spark, sf):
    return O.svo(voxels(spark, sf), LEVELS).groupBy("level").agg(F.sum(bits(F.col("child_mask"))).alias("children"))


# ---- graphs of distinct nodes ----


@query(f"WITH {DAG_SQL} SELECT level, count(*) AS svo_nodes, count(DISTINCT node_id) AS dag_nodes FROM cells GROUP BY level")
def dag_levels(spark, sf):
    return pl_dag(spark, sf).cells.groupBy("level").agg(F.count("*").alias("svo_nodes"), F.countDistinct("node_id").alias("dag_nodes"))


@query(f"WITH {DAG_SQL} SELECT * FROM nodes")
def dag_nodes(spark, sf):
    return pl_dag(spark, sf).nodes


@query(f"WITH {DAG_SQL} SELECT count(*) AS svo_nodes, (SELECT count(*) FROM nodes) AS dag_nodes, round(count(*) / (SELECT count(*) FROM nodes), 6) AS ratio FROM cells")
def dag_compression_ratio(spark, sf):
    d = pl_dag(spark, sf)
    n = d.nodes.agg(F.count("*").alias("dag_nodes"))
    return d.cells.agg(F.count("*").alias("svo_nodes")).crossJoin(n).select("svo_nodes", "dag_nodes", F.round(F.col("svo_nodes") / F.col("dag_nodes"), 6).alias("ratio"))


@query(f"WITH {DAG_SQL} SELECT level, node_id FROM nodes n WHERE level > 0 AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.level = n.level - 1 AND e.child_id = n.node_id)")
def integrity_unreferenced(spark, sf):
    d = pl_dag(spark, sf)
    e = O.edges(d.nodes).select((F.col("level") + 1).alias("level"), F.col("child_id").alias("node_id"))
    return d.nodes.where("level > 0").select("level", "node_id").join(e, ["level", "node_id"], "left_anti")


_M = tuple((lambda m, h=h, w=w, b=b: f"(((({m}) & {h}) >> {b}) | ((({m}) & {w}) << {b}))") for h, w, b in ((240, 15, 4), (204, 51, 2), (170, 85, 1)))


def _mirror(m: str, g: int) -> str:
    for bit, f in zip((4, 2, 1), _M):
        if g & bit:
            m = f(m)
    return m


@query(f"SELECT m::INT AS mask, g::INT AS mirror, (CASE g {' '.join(f'WHEN {g} THEN {_mirror("m", g)}' for g in range(8))} END)::INT AS mirrored FROM range(256) a(m), range(8) b(g)")
def mirror_masks(spark, sf):
    rows = spark.range(256).select(F.col("id").cast("int").alias("mask"))
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("mirror"), mirror_mask(F.col("mask"), g).alias("mirrored")) for g in range(8)))).alias("e")
    return rows.select("mask", each).select("mask", "e.mirror", "e.mirrored")


@query(f"WITH {SVO_SQL} SELECT least({', '.join(_mirror('child_mask', g) for g in range(8))})::INT AS orbit, count(*) AS leaves FROM s{LEVELS - 1} GROUP BY 1")
def leaf_orbits(spark, sf):
    return O.svo(voxels(spark, sf), LEVELS).where(F.col("level") == LEVELS - 1).groupBy(canonical_mask(F.col("child_mask")).alias("orbit")).agg(F.count("*").alias("leaves"))


@query(f"WITH {VOX} SELECT morton FROM vox")
def expand_dag(spark, sf):
    return O.expand(pl_dag(spark, sf))


@query(f"WITH {REF_SQL} SELECT level, node_id, refs FROM refs")
def ref_count(spark, sf):
    return O.ref_counts(pl_dag(spark, sf)).select("level", "node_id", "refs")


@query(f"WITH {REF_SQL} SELECT level, node_id, paths FROM refs")
def effective_ref_count(spark, sf):
    return O.ref_counts(pl_dag(spark, sf)).select("level", "node_id", "paths")


@query(f"WITH {REF_SQL} SELECT level, least(paths, 9) AS bin, count(*) AS nodes FROM refs GROUP BY 1, 2")
def ref_histogram(spark, sf):
    return O.ref_counts(pl_dag(spark, sf)).groupBy("level", F.least("paths", F.lit(9)).alias("bin")).agg(F.count("*").alias("nodes"))


# ---- encodings ----


@query(f"WITH {ADDR} SELECT level, node_id, child_mask, size, address FROM addr")
def svdag_addresses(spark, sf):
    return O.svdag_addresses(pl_dag(spark, sf))


@query(f"""WITH {ADDR} SELECT address, child_mask::BIGINT AS word FROM addr UNION ALL
SELECT a.address + 1 + bit_count(a.child_mask >> (e.slot + 1)), c.address FROM edge e JOIN addr a ON a.level = e.level AND a.node_id = e.node_id JOIN addr c ON c.level = e.level + 1 AND c.node_id = e.child_id""")
def svdag_words(spark, sf):
    return O.svdag_words(pl_dag(spark, sf))


@query(f"WITH {VOX} SELECT morton FROM vox")
def svdag_roundtrip(spark, sf):
    rows = cut(meshes.svdag_decoded(cut(O.svdag_words(pl_dag(spark, sf)), "words"), LEVELS), "decoded")
    front = spark.range(1).select(F.lit(0).cast("long").alias("address"), F.lit(0).cast("long").alias("key"))
    for level in range(LEVELS - 1):
        step = rows.where(F.col("level") == level).select("address", "slot", "child")
        front = front.join(step, "address").select(F.col("child").alias("address"), (F.col("key") * 8 + F.col("slot")).alias("key"))
    leaf = front.join(rows.where(F.col("level") == LEVELS - 1).select("address", "child_mask"), "address")
    slots = F.explode(F.expr("filter(sequence(0, 7), i -> (shiftright(child_mask, i) & 1) = 1)")).alias("slot")
    return leaf.select("key", slots).select((F.col("key") * 8 + F.col("slot")).alias("morton"))


@query(f"WITH {ADDR} SELECT count(*) AS nodes, sum(size)::BIGINT AS words, (4 * sum(size))::BIGINT AS svdag_bytes, round(32 * sum(size) / (SELECT count(*) FROM vox), 6) AS bits_per_voxel, (SELECT count(*) FROM svo) AS pointerless_bytes, (8 * (SELECT count(*) FROM svo))::BIGINT AS svo_bytes FROM addr")
def encoded_sizes(spark, sf):
    v = voxels(spark, sf)
    d = O.dag(v, LEVELS)
    n, cells = v.agg(F.count("*").alias("v")), d.cells.agg(F.count("*").alias("c"))
    total = O.svdag_addresses(d).agg(F.count("*").alias("nodes"), F.sum("size").alias("words"))
    return total.crossJoin(n).crossJoin(cells).select("nodes", "words", (F.col("words") * 4).alias("svdag_bytes"), F.round(F.col("words") * 32 / F.col("v"), 6).alias("bits_per_voxel"), F.col("c").alias("pointerless_bytes"), (F.col("c") * 8).alias("svo_bytes"))


# ---- lookups ----

PV = f"""pv AS (SELECT event_id AS id, {_key("x", "y", "z", 6)} AS morton FROM (SELECT event_id, (user_id % 64)::BIGINT x, (floor(value) % 64)::BIGINT y, (event_id % 64)::BIGINT z FROM events))"""


def pv_points(spark, sf):
    t = spark.read.parquet(f"{sf}/events.parquet")
    return t.select(F.col("event_id").alias("id"), interleave(F.col("user_id") % 64, F.floor("value") % 64, F.col("event_id") % 64, LEVELS).alias("morton"))


_DEPTH = "coalesce(" + ", ".join(f"(SELECT {v} FROM s{v} WHERE key = pv.morton >> {3 * (LEVELS - v)})" for v in range(LEVELS - 1, -1, -1)) + ", -1)"


@query(f"WITH {SVO_SQL}, {PV} SELECT id, morton::BIGINT AS morton, ({_DEPTH})::INT AS depth FROM pv")
def locate_points(spark, sf):
    return S.locate(pv_points(spark, sf), O.svo(voxels(spark, sf), LEVELS), LEVELS).select("id", "morton", "depth")


@query(f"WITH {VOX}, {PV} SELECT id, morton IN (SELECT morton FROM vox) AS has_voxel FROM pv")
def has_voxel(spark, sf):
    return S.locate(pv_points(spark, sf), O.svo(voxels(spark, sf), LEVELS), LEVELS).select("id", "has_voxel")


def halves(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    box = box_of(tables.points_lineitem(spark, sf))
    cols = [F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z")]
    return [O.voxelize(t.where(F.col("l_orderkey") % 2 == k).select(*cols), LEVELS, box) for k in (0, 1)]


_HALF = VOX.replace("SELECT greatest(0", "SELECT l_orderkey % 2 AS half, greatest(0", 1).replace("vox AS MATERIALIZED (SELECT DISTINCT", "hv AS (SELECT DISTINCT half,")


@query(f"WITH {_HALF} SELECT morton FROM hv WHERE half = 0 UNION SELECT morton FROM hv WHERE half = 1")
def voxel_union(spark, sf):
    a, b = halves(spark, sf)
    return a.union(b).distinct()


@query(f"WITH {_HALF} SELECT morton FROM hv WHERE half = 0 INTERSECT SELECT morton FROM hv WHERE half = 1")
def voxel_intersect(spark, sf):
    a, b = halves(spark, sf)
    return a.intersect(b)


@query(f"WITH {_HALF} SELECT morton FROM hv WHERE half = 0 EXCEPT SELECT morton FROM hv WHERE half = 1")
def voxel_except(spark, sf):
    a, b = halves(spark, sf)
    return a.exceptAll(b)


# ---- similarity ----

KEYS = f"{DAG_SQL}, k AS MATERIALIZED (SELECT edge.node_id, list_sort(list(slot * 256 + m.child_mask)) AS w, {', '.join(f'coalesce(max(CASE WHEN slot = {i} THEN m.child_mask END), 0) AS w{i}' for i in range(8))} FROM edge JOIN nodes m ON m.level = 5 AND m.node_id = edge.child_id WHERE edge.level = 4 GROUP BY 1)"
PAIRS = f"{KEYS}, pairs AS MATERIALIZED (SELECT a.node_id AS src, b.node_id AS dst FROM k a JOIN k b ON a.node_id > b.node_id AND {' + '.join(f'bit_count(xor(a.w{i}, b.w{i}))' for i in range(8))} = 1)"
COMP = f"{PAIRS}, both_ AS MATERIALIZED (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), reach(a, b) AS (SELECT src, src FROM both_ UNION SELECT a, dst FROM reach JOIN both_ ON src = b), comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY 1)"


@query(f"WITH {PAIRS} SELECT src, dst FROM pairs")
def hamming1_pairs(spark, sf):
    return C.hamming1_pairs(cut(C.leaf_keys(pl_dag(spark, sf)), "keys"))


@query(f"WITH RECURSIVE {COMP} SELECT node_id, component FROM comp")
def components(spark, sf):
    return C.components(hamming1_pairs(spark, sf))


@query(f"WITH RECURSIVE {COMP}, n AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) SELECT least(n // 5, 15)::BIGINT AS bin, count(*) AS components FROM n GROUP BY 1")
def component_sizes(spark, sf):
    return C.size_histogram(components(spark, sf))


@query(f"""WITH RECURSIVE {COMP}, w AS (SELECT node_id, component, (SELECT count(*) FROM both_ WHERE src = comp.node_id) AS w FROM comp)
SELECT component AS cluster, arg_max(node_id, (w, -node_id)) AS node_id FROM w GROUP BY 1""")
def cluster_rep(spark, sf):
    p = cut(hamming1_pairs(spark, sf), "pairs")
    return C.representatives(p.withColumn("weight", F.lit(1.0)), C.components(p).withColumnRenamed("component", "cluster"))


@query()
def mcl_clusters(spark, sf):
    return C.markov_clusters(hamming1_pairs(spark, sf).withColumn("weight", F.lit(1.0)))


@query(f"WITH {KEYS}, g AS (SELECT w, count(*) AS n FROM k GROUP BY w) SELECT n AS same, count(*) AS keys FROM g GROUP BY 1")
def subtree_hash_groups(spark, sf):
    names = O.subtree_keys(pl_dag(spark, sf), 1).where(F.col("level") == LEVELS - 2)
    return names.groupBy("subtree").agg(F.count("*").alias("same")).groupBy("same").agg(F.count("*").alias("keys"))


@query(f"WITH {KEYS} SELECT a.node_id AS a, b.node_id AS b, ({' + '.join(f'bit_count(xor(a.w{i}, b.w{i}))' for i in range(8))})::BIGINT AS diff FROM k a, k b WHERE a.node_id < b.node_id")
def subtree_diff(spark, sf):
    d = pl_dag(spark, sf)
    ids = d.nodes.where(F.col("level") == LEVELS - 2).select("node_id")
    pairs = cut(ids.select(F.col("node_id").alias("a")).join(ids.select(F.col("node_id").alias("b")), F.col("a") < F.col("b")), "pairs")
    return C.subtree_diff(d, pairs, LEVELS - 2)


# ---- geometry ----


@query(f"""WITH RECURSIVE {PEV}, cell AS (SELECT i::BIGINT AS key FROM range(4096) t(i) WHERE i NOT IN (SELECT morton FROM vox)),
near AS MATERIALIZED (SELECT a.key, b.key AS other FROM cell a JOIN cell b ON abs({_axis("a.key", 0, 4)} - {_axis("b.key", 0, 4)}) + abs({_axis("a.key", 1, 4)} - {_axis("b.key", 1, 4)}) + abs({_axis("a.key", 2, 4)} - {_axis("b.key", 2, 4)}) = 1),
f(key) AS (SELECT key FROM cell WHERE key = 4095 UNION SELECT other FROM f JOIN near USING (key)) SELECT key FROM f""")
def flood_outside(spark, sf):
    return S.flood_outside(pe_voxels(spark, sf), GRID)


RAY = ["ox", "oy", "oz", "dx", "dy", "dz"]
_D = [f"(CASE WHEN abs(d{a}) < 1e-12 THEN 1e-12 ELSE d{a} END)" for a in "xyz"]
RAYS_SQL = f"""{PEV}, ray AS (SELECT vec_id AS ray_id, {", ".join(f"(embedding[{i + 1}]::DOUBLE + 1) * 8 AS {n}" if i < 3 else f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(RAY))} FROM embeddings),
v AS MATERIALIZED (SELECT morton, {", ".join(f"{_axis('morton', i, 4)}::DOUBLE AS {a}" for i, a in enumerate("xyz"))} FROM vox),
slab AS (SELECT ray_id, morton, greatest({", ".join(f"least(({a} - o{a}) / {d}, ({a} + 1 - o{a}) / {d})" for a, d in zip("xyz", _D))}) AS near, least({", ".join(f"greatest(({a} - o{a}) / {d}, ({a} + 1 - o{a}) / {d})" for a, d in zip("xyz", _D))}) AS far FROM ray, v),
hit AS MATERIALIZED (SELECT ray_id, morton, round(greatest(near, 0), 6) AS t FROM slab WHERE far >= greatest(near, 0))"""


def pe_rays(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    return t.select(F.col("vec_id").alias("ray_id"), *(((F.col("embedding")[i].cast("double") + 1) * 8 if i < 3 else F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate(RAY)))


@query(f"WITH {RAYS_SQL} SELECT ray_id, min(t) AS t, arg_min(morton, (t, morton)) AS morton FROM hit GROUP BY 1")
def ray_hits(spark, sf):
    return S.cast_rays(pe_rays(spark, sf), pe_voxels(spark, sf), GRID)


_TE = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def _sat(c: list[str], half: str) -> str:
    v = [[f'("{p}{a}" - {m})' for a, m in zip("xyz", c)] for p in "abc"]
    e = [[f"({b} - {a})" for a, b in zip(v[i], v[(i + 1) % 3])] for i in range(3)]
    cross = lambda a, b: [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]
    u = [["1", "0", "0"], ["0", "1", "0"], ["0", "0", "1"]]
    out = []
    for axis in [*u, cross(e[0], e[1]), *(cross(x, y) for x in u for y in e)]:
        p = [" + ".join(f"{a} * {b}" for a, b in zip(axis, q)) for q in v]
        r = f"{half} * ({' + '.join(f'abs({a})' for a in axis)})"
        out.append(f"least({', '.join(p)}) <= {r} AND greatest({', '.join(p)}) >= -({r})")
    return " AND ".join(out)


@query(f"""WITH t AS (SELECT vec_id AS tri_id, {", ".join(f"(embedding[{i + 1}]::DOUBLE + 1) * 4 AS {chr(34)}{n}{chr(34)}" for i, n in enumerate(_TE))} FROM embeddings),
cell AS (SELECT i AS morton, {", ".join(f"{_axis('i', k, 3)} + 0.5 AS m{a}" for k, a in enumerate("xyz"))} FROM range(512) g(i))
SELECT tri_id, morton::BIGINT AS morton FROM t, cell WHERE {_sat(["mx", "my", "mz"], "0.5")}""")
def voxelize_triangles(spark, sf):
    t = tables.embedding_columns(spark, sf, _TE, 4.0, 1.0).withColumnRenamed("vec_id", "tri_id")
    return S.voxelize_triangles(t, 3)


@query("""WITH RECURSIVE h(i, base, n, f, r) AS (SELECT i, b, i, 1.0 / b, 0.0::DOUBLE FROM range(1, 257) a(i), (VALUES (2), (3), (5)) v(b)
UNION ALL SELECT i, base, n // base, f / base, r + f * (n % base) FROM h WHERE n > 0) SELECT i::BIGINT AS i, base::INT AS base, round(r, 6) AS r FROM h WHERE n = 0""".replace("1.0 / b", "1.0::DOUBLE / b"))
def halton(spark, sf):
    rows = spark.range(1, 257).select(F.col("id").alias("i"), F.explode(F.array(*(F.lit(b) for b in (2, 3, 5)))).alias("base"))
    return rows.select("i", "base", F.round(V.halton(F.col("i"), F.col("base")), 6).alias("r"))


@query("SELECT event_id AS key_idx, round(avg(value) OVER w, 6) AS value FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) QUALIFY count(*) OVER w = 15")
def walk_smooth(spark, sf):
    keys = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("key_idx"), "value")
    return C.smoothed(keys, ["value"], 15).select("key_idx", F.round("value", 6).alias("value"))


# ---- mesh text made from the embeddings: three vertices and a face for each ----


def obj_lines(spark, sf):
    t = tables.embedding_columns(spark, sf, _TE, 1.0, 0.0)
    v = [F.concat_ws(" ", F.lit("v"), *(F.round(F.col(c), 6).cast("decimal(12,6)").cast("string") for c in _TE[i : i + 3])) for i in (0, 3, 6)]
    face = F.when(F.col("vec_id") % 2 == 0, F.lit("f -3 -2 -1")).otherwise(F.concat_ws(" ", F.lit("f"), *((F.col("vec_id") * 3 + k).cast("string") for k in (1, 2, 3))))
    mtl = F.concat(F.lit("usemtl m"), (F.col("vec_id") % 7).cast("string"))
    return t.select(F.explode(F.array(*(F.struct((F.col("vec_id") * 5 + k).alias("line_no"), x.alias("value")) for k, x in enumerate((*v, mtl, face))))).alias("l")).select("l.line_no", "l.value")


@query("SELECT vec_id * 5 + 4 AS line_no, 0 AS part, vec_id * 3 + 1 AS i, vec_id * 3 + 2 AS j, vec_id * 3 + 3 AS k, 'm' || (vec_id % 7) AS material FROM embeddings")
def obj_parse(spark, sf):
    return meshes.parse_obj(obj_lines(spark, sf))[1]


@query("SELECT vec_id * 5 + 4 AS line_no, 0 AS part, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS {n}" for i, n in enumerate(_TE)) + " FROM embeddings")
def tri_soup(spark, sf):
    return meshes.triangle_soup(*meshes.parse_obj(obj_lines(spark, sf)))


@query("SELECT 'm' || vec_id AS name, 'Ns' AS property, vec_id::VARCHAR AS value FROM embeddings")
def mtl_forward_fill(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    two = F.array(F.struct((F.col("vec_id") * 2).alias("line_no"), F.concat(F.lit("newmtl m"), F.col("vec_id").cast("string")).alias("value")), F.struct((F.col("vec_id") * 2 + 1).alias("line_no"), F.concat(F.lit("Ns "), F.col("vec_id").cast("string")).alias("value")))
    return meshes.parse_mtl(t.select(F.explode(two).alias("l")).select("l.line_no", "l.value")).drop("line_no")


from octolith.plans import more  # noqa: E402, F401  its queries join these
