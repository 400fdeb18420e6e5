"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets of sizes a and b have a Jaccard similarity of 3/4 or more exactly if they differ in at most (a + b) / 7
elements. Sizes fall into bands [l, 4l/3]; a set meets the sets of its own band and of the next one, each band
with its own partition of the 64-bit shingle hashes into n parts. A set of size a differs from any partner in at
most k elements, so of its parts in order it enumerates those with elements until it has k + 1: of the parts
that two similar sets both list, at most k differ, so one part with elements agrees, and its content is a
signature that both have (the subsets of PartEnum's second level have one part here, the fewest signatures).

Equal sets are one class. Classes that share a signature are candidates: first each with the smallest class of the
signature (the links found so give provisional components), then every pair in different components. A signature
with more than `HOT` classes isn't paired up. It isn't needed for a set that lists enough other parts: each lists
some more than k + 1, and the argument holds as long as k + 1 of them aren't hot. Sets for which they are, or with
too few parts that have elements, are joined by a prefix filter (the rarest shingles of each set, by their count over
these sets; similar sets share one, early enough in both for the rest to suffice). Where many sets share a shingle this
goes in rounds: each shingle's sets are paired with a few of them, links found merge components, and sets of one component
needn't be paired any more. When no crowd is left, or a round finds few links, every pair across components is. Candidate pairs are sifted by counts of their shingles in bins, whose differences can't exceed the
sets', and then verified on the sets themselves.

Cases: null, empty and blank texts have the empty set and are linked with nothing; a text of one to four words has
its whole sequence as one shingle. Rows that repeat a doc_id are reported each; a null doc_id takes part in
links, but names a component only if there is no other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.common import by_row, drop, keyed, only, parts, release, text_slices, texts_only, written
from octolith.llm.graph import components
from octolith.llm.words import SPACED, Words, mix, windows

#: More classes than this behind one signature go the second way.
HOT = 48
#: Rounds over the rarest shingles go on while there are more than CROWD pairs across components for each row, and
#: while a round finds a link for every FEW of the sets.
CROWD, FEW = 100, 1000
#: Classes of a shingle that a round pairs with the others.
LEADS = 8
#: 2 ** COUNTERS counters tell which shingles are rare.
COUNTERS = 20
#: Signatures that a task gathers before it sends them on.
FLUSH = 1_500_000
NULL_ID = -(2**63)
_BLOCK = 1024


def sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    w = Words(texts, SPACED)
    h = w.hashes()
    win = windows(h, n)
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield np.unique(win[a : z - n + 1] if z - a >= n else windows(h[a:z], z - a) if z > a else win[:0])


def class_of(u: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    x = int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(u) * 0x14057B7EF767814F
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=1)
def bands() -> list[tuple[int, int]]:
    out, low = [], 1
    while low < 1 << 31:
        out.append((low, low * 4 // 3))
        low = low * 4 // 3 + 1
    return out


def _instances(s: int) -> Iterator[tuple[int, int, int, int]]:
    """For the own band of a size and the next: number, parts, most differences from a partner, signatures."""
    if not s:
        return
    all_bands = bands()
    own = next(i for i, (_, high) in enumerate(all_bands) if s <= high)
    for j in (own, own + 1):
        low, high = all_bands[j]
        partner = min(high, s * 4 // 3)
        if j == own or partner >= low:
            k = (s + partner) // 7
            yield j, -(-4 * high // 10) + 6, k, k + 1 + max(3, k // 7)


def signatures(u: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's signatures in its band and the next, and how many of a band's it could spare (below 0: too few)."""
    out, slack = [], len(u)
    for j, n, k, most in _instances(len(u)):
        part = (mix(u + np.uint64(j)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: most + 1]
        content = np.add.reduceat(mix(u[order] ^ np.uint64(0x2545F4914F6CDD1D)), at)[:most]
        used = part[at][:most].astype(np.uint64)
        slack = min(slack, len(used) - k - 1)
        out.append(mix(content + used * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j * 0x632BE5AB)))
    return np.concatenate(out), slack


def spare(u: np.ndarray) -> int:
    """The second value of signatures(), by counting alone."""
    s, out = len(u), len(u)
    for j, n, k, most in _instances(s):
        part = (mix(u + np.uint64(j)) % np.uint64(n)).astype(np.int64)
        out = min(out, min(most, int(np.count_nonzero(np.bincount(part)))) - k - 1)
    return out


def sketch(u: np.ndarray) -> bytes:
    """The set's size, and its counts by the first bits of the shingle hash: 256 bins or, for large sets, one for 4 to 8."""
    bits = max(8, len(u).bit_length() - 2)
    bins = np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.int64(len(u)).tobytes() + (bins.astype(np.uint8).tobytes() if bins.max() < 256 else b"")


def _bins(data: bytes) -> tuple[int, np.ndarray]:
    return int(np.frombuffer(data, np.int64, 1)[0]), np.frombuffer(data, np.uint8, -1, 8).astype(np.int64)


def _folded(bins: np.ndarray, n: int) -> np.ndarray:
    return bins.reshape(n, -1).sum(1)


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, texts in text_slices(b):
                rows = [(class_of(u), len(u), spare(u), sketch(u)) for u in sets(texts, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), b.column(2).slice(row, end - row), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary())))], names=["doc_id", "h", "class", "n", "slack", "sketch"])

    return run


def _signed(n: int, buckets: int):
    """Rows (bucket, payload): the classes met, their sizes, and the bucket's signatures with the class of each."""

    def flush(sigs: list, ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        sig = np.concatenate(sigs)
        owner = np.repeat(np.arange(len(sigs), dtype=np.uint16), [len(x) for x in sigs])
        bucket = (sig >> np.uint64(48)).astype(np.int64) * buckets >> 16
        order = np.argsort(bucket, kind="stable")
        sig, owner, bucket = sig[order], owner[order], bucket[order]
        ids_, sizes_ = np.array(ids, np.int64), np.array(sizes, np.int32)
        keys, at = np.unique(bucket, return_index=True)
        payload = []
        for a, z in zip(at, [*at[1:], len(sig)]):
            have, index = np.unique(owner[a:z], return_inverse=True)
            x = sig[a:z]
            payload.append(b"".join((np.array([len(have), z - a], np.uint32).tobytes(), ids_[have].tobytes(), sizes_[have].tobytes(), index.astype(np.uint16).tobytes(), x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, sizes, total, met = [], [], [], 0, set()
        for b in batches:
            for _, _, texts in text_slices(b):
                for u in sets(texts, n):
                    if not len(u) or (c := class_of(u)) in met:
                        continue
                    met.add(c)
                    x = signatures(u)[0]
                    sigs.append(x)
                    ids.append(c)
                    sizes.append(len(u))
                    total += len(x)
                    if total >= FLUSH or len(sigs) == 65_000:
                        yield flush(sigs, ids, sizes)
                        sigs, ids, sizes, total = [], [], [], 0
        if sigs:
            yield flush(sigs, ids, sizes)

    return run


GROUPS = "gid long, hot boolean, times long, members array<long>, sizes array<int>"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lists of the classes behind one signature, smallest class first; hot ones in blocks, each with that first."""

    def groups(payloads: list[bytes]) -> list[tuple]:
        key, owner, size = [], [], []
        for p in payloads:
            n, m = np.frombuffer(p, np.uint32, 2)
            ids = np.frombuffer(p, np.int64, n, 8)
            sizes = np.frombuffer(p, np.int32, n, at := 8 + 8 * int(n))
            index = np.frombuffer(p, np.uint16, m, at := at + 4 * int(n))
            low = np.frombuffer(p, np.uint32, m, at := at + 2 * int(m))
            high = np.frombuffer(p, np.uint16, m, at + 4 * int(m))
            key.append(low.astype(np.int64) | high.astype(np.int64) << 32)
            owner.append(ids[index])
            size.append(sizes[index])
        key, owner, size = np.concatenate(key), np.concatenate(owner), np.concatenate(size)
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        order = order[np.r_[same, False] | np.r_[False, same]]
        if not len(order):
            return []
        key, owner, size = key[order], owner[order], size[order]
        order = np.lexsort((owner, key))
        key, owner, size = key[order], owner[order], size[order]
        new = np.r_[True, (np.diff(key) != 0) | (np.diff(owner) != 0)]
        key, owner, size = key[new], owner[new], size[new]
        at = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        n = np.diff(np.r_[at, len(key)])
        gid = mix(np.add.reduceat(mix(owner.view(np.uint64)), at)).view(np.int64)
        _, first, times = np.unique(gid, return_index=True, return_counts=True)
        out = []
        for g, k in zip(first[n[first] > 1], times[n[first] > 1]):
            a, z = at[g], at[g] + n[g]
            if n[g] <= HOT:
                out.append((gid[g], False, k, owner[a:z], size[a:z]))
            else:
                out += [(gid[g], True, k, np.r_[owner[a], owner[x : min(z, x + _BLOCK)]], np.r_[size[a], size[x : min(z, x + _BLOCK)]]) for x in range(a + 1, z, _BLOCK)]
        return out

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[i : i + 20_000]), (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())))], names=["gid", "hot", "times", "members", "sizes"])

    now, held = None, []
    for b in batches:
        for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now and held:
                yield from rows(groups(held))
                held = []
            now = bucket
            held.append(payload.as_buffer())
    if held:
        yield from rows(groups(held))


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(both) - common)


def _as_is(_: int, data: bytes) -> bytes:
    return data


def _near(x: bytes, y: bytes) -> bool:
    (m, a), (n, b) = _bins(x), _bins(y)
    least = min(len(a), len(b))
    return not least or 7 * int(np.abs(_folded(a, least) - _folded(b, least)).sum()) <= m + n


def _set_of(n: int):
    """The set of a text, if it is of the class: rows that repeat a doc_id may bring another text."""

    def own(c: int, data: bytes) -> np.ndarray | None:
        u = next(sets(pa.array([data.decode()]), n))
        return u if class_of(u) == c else None

    return own


def passing(pairs: DataFrame, table: DataFrame, read, test) -> DataFrame:
    """The pairs (a, b) whose data in table (class, data), as read, pass test. One `a` is dealt to as many as 64 places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, center = None, None
        for rows in batches:
            out = []
            for a, salt, b, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3)):
                x = read(a if b is None else b, data.as_buffer().to_pybytes())
                if x is None:
                    continue
                if b is None:
                    now, center = (a, salt), x
                elif (a, salt) == now and test(center, x):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(64)).alias("salt"), "b")
    member = dealt.join(table.withColumnRenamed("class", "b"), "b").select("a", "salt", "b", "data")
    center = dealt.select("a", "salt").distinct().join(table.withColumnRenamed("class", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "data")
    return member.union(center).repartition(parts(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, class, comp, sketch) of groups of at most HOT: the pairs in different components that may link."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[0])
        ids = [r[0] for r in rows]
        comp = np.unique([r[1] for r in rows], return_inverse=True)[1]
        every = [_bins(r[2]) for r in rows]
        n = np.array([x[0] for x in every])
        least = min(len(x[1]) for x in every)
        bins = np.stack([_folded(x[1], least) for x in every]) if least else np.zeros((len(rows), 1), np.int64)
        for i in range(len(rows) - 1):
            differ = np.abs(bins[i + 1 :] - bins[i]).sum(1)
            fit = (7 * differ <= n[i + 1 :] + n[i]) & (comp[i + 1 :] != comp[i]) & (4 * np.minimum(n[i + 1 :], n[i]) >= 3 * np.maximum(n[i + 1 :], n[i]))
            yield from ((ids[i], ids[i + 1 + j]) for j in np.flatnonzero(fit))

    now, held = None, []
    for b in batches:
        out = []
        for gid, c, comp, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            if gid != now:
                out += pairs(held)
                now, held = gid, []
            held.append((c, comp, data.as_buffer()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
    if out := list(pairs(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _own_sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Each class of rows (class, text) with its set, once in a task."""
    met, own = set(), _set_of(n)
    for b in batches:
        for c, data in zip(b.column(0).to_pylist(), b.column(1)):
            if c not in met and (u := own(c, data.as_buffer().to_pybytes())) is not None:
                met.add(c)
                yield c, u


def _slot(u: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return (u >> np.uint64(64 - COUNTERS)).astype(np.int64)


#: Counters travel in so many parts.
_PARTS = 64


def _counted(n: int):
    """Rows (class, text) to (part, counts): how many of the task's sets have a shingle at each counter of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for _, u in _own_sets(n, batches):
            np.add.at(total, _slot(u), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array([_thin(x) for x in total.reshape(_PARTS, -1)], pa.binary())], names=["part", "counts"])

    return run


def _thin(counts: np.ndarray) -> bytes:
    """Places and values of what isn't 0."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint32).tobytes() + counts[at].tobytes()


def _thick(data: bytes) -> np.ndarray:
    n = len(data) // 12
    out = np.zeros((1 << COUNTERS) // _PARTS, np.int64)
    out[np.frombuffer(data, np.uint32, n)] = np.frombuffer(data, np.int64, n, 4 * n)
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1)):
            total[part] = total.get(part, 0) + _thick(data.as_py())
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_thin(x) for x in total.values()], pa.binary())], names=["part", "counts"])


def _prefixes(n: int, counts):
    """Rows (class, text) to (class, n, i, shingle): the rarest shingles of each set, i their place in its order.

    As many as it takes for two sets that link to share one. A shingle alone at its counter is in no other set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, u in _own_sets(n, batches):
            many = counts.value[_slot(u)]
            i = np.lexsort((u, many))[: len(u) - -(-3 * len(u) // 4) + 1]
            place = np.flatnonzero(many[i] > 1)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), x)) for x in (c, len(u))] + [pa.array(place), pa.array(u[i[place]].view(np.int64))], names=["class", "n", "i", "shingle"])

    return run


def _fits(x: str, y: str):
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def _early():
    """What two sets share begins with their first shared shingle, so no more than the rest of either can be common."""
    return 7 * F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= 3 * (F.col("na") + F.col("nb"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key has more than one component."""
    several = written(rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(key), "several")
    return rows.join(several, key, "left_semi")


def jaccard_links(docs: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class, n) of every document, and links (a, b) whose components are those of all links between classes."""
    spark = docs.sparkSession
    t = texts_only(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    # Many rows may have one doc_id, or none: a text is found again by doc_id and a hash of itself.
    t = t.withColumn("h", F.xxhash64("text"))
    classes = written(t.mapInArrow(_classes(n), "doc_id long, h long, class long, n long, slack int, sketch binary"), "classes")
    buckets = min(65536, 2 * parts(spark))
    signed = t.select("text").mapInArrow(_signed(n, buckets), "bucket int, payload binary").repartition(parts(spark), "bucket")
    groups = written(signed.sortWithinPartitions("bucket").mapInArrow(_grouped, GROUPS), "groups")
    del signed
    release(spark)
    # Classes that can't do without hot signatures.
    heat = groups.where("hot").select(F.explode("members").alias("class"), "times").groupBy("class").agg(F.sum("times").alias("heat"))
    one = classes.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.first("n").alias("n"), F.first("slack").alias("slack"), F.first("sketch").alias("data"))
    one = written(one.join(heat, "class", "left").withColumn("second", F.coalesce("heat", F.lit(0)) > F.col("slack")).drop("heat", "slack"), "one")
    sketches = one.select("class", "data")
    second = written(one.where("second").select("class", "n"), "second")

    def data(wanted: DataFrame) -> DataFrame:
        at = one.select("class", "at.doc_id", "at.h").join(wanted, "class", "left_semi")
        return written(t.join(at, ["doc_id", "h"]).select("class", F.col("text").cast("binary").alias("data")), "texts")

    # Each class with the smallest one of its signatures.
    star = groups.select("hot", F.element_at("members", 1).alias("a"), F.element_at("sizes", 1).alias("na"), F.explode(F.expr("slice(arrays_zip(members, sizes), 2, size(members))")).alias("m"))
    star = star.select("hot", "a", F.col("m.members").alias("b"), "na", F.col("m.sizes").alias("nb")).where(_fits("na", "nb"))
    needed = star.where("hot").select("a", "b").distinct().join(second.select(F.col("class").alias("b")), "b", "left_semi").select("a", "b")
    star = written(star.where("NOT hot").select("a", "b").union(needed).distinct(), "star")
    near = written(passing(star, sketches, _as_is, _near), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("class")).union(second.select("class")).distinct()
    texts = data(ends)
    release(spark)
    links = written(passing(near, texts, _set_of(n), _linked), "links")
    release(spark)
    found = [links]
    label = components(links)
    with_comp = lambda rows: rows.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("label", "class")).drop("label")
    # By rarest shingles; what is rare is told by a fixed number of counters, as any order that all sets share will do.
    crowded = texts.join(second.select("class"), "class", "left_semi")
    counters = crowded.mapInArrow(_counted(n), "part int, counts binary").repartition(_PARTS, "part").mapInArrow(_summed, "part int, counts binary")
    counts = np.zeros((_PARTS, (1 << COUNTERS) // _PARTS), np.int64)
    for r in counters.collect():  # a row a part
        counts[r.part] = _thick(bytes(r.counts))
    counts = counts.ravel()
    prefix = written(crowded.mapInArrow(_prefixes(n, spark.sparkContext.broadcast(counts)), "class long, n long, i long, shingle long"), "prefix")
    classes_there = second.count()
    tested = star
    while True:
        across = written(_several(written(with_comp(prefix), "across"), "shingle"), "across")
        each = across.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("s"))
        rows, crowd = each.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * F.col("k") - F.col("s")) / 2, F.lit(0))).first()
        if crowd <= CROWD * rows:
            break
        # A few classes of each shingle, others in each round, with the rest: LEADS pairs at most for each row. Those that
        # have the shingle early enough for sets of their own size come first.
        turn = F.struct(7 * F.col("i") > F.col("n"), F.xxhash64("class", "shingle", F.lit(len(found))))
        lead = across.groupBy("shingle", F.pmod(F.xxhash64("class", F.lit(len(found))), F.lit(LEADS)).alias("salt")).agg(F.min_by(F.struct(F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("ca")), turn).alias("l")).select("shingle", "l.*")
        pairs = across.withColumnsRenamed({"class": "b", "n": "nb", "i": "ib", "comp": "cb"}).join(lead, "shingle").where((F.col("ca") != F.col("cb")) & _fits("na", "nb") & _early())
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(passing(written(passing(pairs, sketches, _as_is, _near), "near"), texts, _set_of(n), _linked), "links")
        release(spark)
        tested, found = tested.union(pairs), [*found, more]
        label = components(_all(found))
        if FEW * more.count() < classes_there:
            across = written(_several(written(with_comp(prefix), "across"), "shingle"), "across")
            break
    # Pairs across components behind a signature, and what the rounds left.
    small = groups.where("NOT hot").dropDuplicates(["gid"]).select("gid", F.explode("members").alias("class"))
    small = _several(written(with_comp(small), "small"), "gid").join(sketches, "class").select("gid", "class", "comp", "data")
    pairs = small.repartition(parts(spark), "gid").sortWithinPartitions("gid").mapInArrow(_sifted, "a long, b long")
    x = across.select("shingle", F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("comp").alias("ca"))
    y = across.select("shingle", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("comp").alias("cb"))
    by_prefix = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _fits("na", "nb") & _early()).select("a", "b").distinct()
    pairs = pairs.union(passing(by_prefix, sketches, _as_is, _near)).distinct().join(tested, ["a", "b"], "left_anti")
    pairs = written(pairs, "pairs")
    drop(groups, prefix, across)
    rest = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(ends, "class", "left_anti")
    more = written(passing(pairs, texts.union(data(rest)), _set_of(n), _linked), "links")
    return classes.select("doc_id", "class", "n"), _all([*found, more])


def jaccard_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    classes, links = jaccard_links(docs, n)
    label = components(links)
    rows = classes.join(label.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", F.coalesce("label", "class").alias("comp"))
    rows = written(rows, "rows")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    least = written(rows.where("n > 0").groupBy("comp").agg(F.min(own).alias("least")), "least")
    out = rows.join(least, "comp", "left")
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(own).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """Of each component the row with the smallest doc_id (a null one is the last; equal ones: the first row), all columns as they were."""
    rows = keyed(docs)
    own = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("own"))
    found = jaccard_components(by_row(rows), n).select(F.col("doc_id").alias("row"), "component_id").join(own, "row")
    return only(rows, found.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "row")).alias("k")).select("k.row"))
