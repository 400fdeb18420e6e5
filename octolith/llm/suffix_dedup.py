"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

Only strings that can repeat reach the suffix construction. Each window of `length` bytes is put down to its anchor,
the 32-byte gram in it with the smallest hash (the first, if equal), so equal windows have equal anchors; neighbouring
windows with one anchor form a piece. Pieces are dealt by anchor. Where pieces of an anchor are equal, all but the
earliest are covered. Where they differ, the earliest of each go on. They are split: a window has half of its other
bytes or more either before the anchor or after it, so it goes by the anchor with that half, which equal windows
share. For pieces that share these a Burrows-Wheeler transform of the collection is built column by column: round j
inserts the suffix of length j + 1 of every piece, whose place follows from the place of the suffix before it and the
symbols already there. The order then has equal windows side by side; the earliest of them stays.

A collection holds about `COLLECTION` pieces of at most 2 * length - 32 bytes, so it is built in memory; its columns are
the files that the published method keeps outside. Of more pieces than that with one half, equal ones are settled and
the others split again by a half of what is left, until the whole window is known; so no task has to hold a hot group.

Cases: a null text is empty; texts shorter than `length` lose nothing. Rows that repeat a doc_id are documents of their
own, the one read first being earlier; a null doc_id comes after all others. Rows are told apart by their place in the
scan, so `docs` has to be a scan of stored tables. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.common import parts, raw, release, text_slices, texts_only, written
from octolith.llm.words import _P, _P_INV, _power, mix

GRAM = 32
#: Pieces that a task gathers before it sends them on: some 100 bytes each while they are sorted.
FLUSH = 100_000
COLLECTION = 2_000
LAST = 2**63 - 1  # a null doc_id in the order
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_LOW = np.uint64((1 << 28) - 1)


def pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first window and number of windows of each piece of one text."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, "p", n)[:n], out=total[1:])
    back = _power(_P_INV, "i", n)
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    least = gram & ~_LOW | np.arange(len(gram), dtype=np.uint64)
    want, have = length - GRAM + 1, 1
    while have * 2 <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if want > have:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    anchor = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    end = first + count - 1 + length
    content = (total[end] - total[first]) * back[first] + (count * 4096 + anchor[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return gram[anchor[first]], mix(content), first, count


def _cut(length: int, buckets: int):
    def flush(rows: list[tuple], out: list[tuple]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(out), dtype=np.uint16), [len(o[0]) for o in out])
        anchor, content, first, count = (np.concatenate(c) for c in zip(*out))
        ids = np.array(rows, np.int64)
        # Equal pieces met here: the earliest goes on, the others are covered.
        both = anchor ^ content * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        order = order[np.r_[same, False] | np.r_[False, same]]
        order = order[np.lexsort((first[order], ids[owner[order], 1], ids[owner[order], 0], content[order], anchor[order]))]
        later = order[1:][(anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])]
        told = np.stack([ids[owner[later], 0], ids[owner[later], 1], first[later].astype(np.int64), count[later].astype(np.int64)])
        stay = np.ones(len(anchor), bool)
        stay[later] = False
        owner, anchor, content, first, count = (x[stay] for x in (owner, anchor, content, first, count))
        bucket = (anchor >> np.uint64(48)).astype(np.int64) * buckets >> 16
        order = np.argsort(bucket, kind="stable")
        keys, at = np.unique(bucket[order], return_index=True)
        payload = []
        for a, z in zip(at, [*at[1:], len(order)]):
            o = order[a:z]
            have, index = np.unique(owner[o], return_inverse=True)
            x, y = anchor[o], content[o]
            low, high = lambda v: v.astype(np.uint32).tobytes(), lambda v: (v >> np.uint64(32)).astype(np.uint16).tobytes()
            payload.append(np.array([len(have), len(o)], np.uint32).tobytes() + ids[have].tobytes() + low(x) + low(y) + first[o].astype(np.uint32).tobytes() + high(x) + high(y) + index.astype(np.uint16).tobytes() + count[o].astype(np.uint16).tobytes())
        if len(later):
            keys = np.r_[keys, -1 - int(told.sum()) % buckets]
            payload.append(told.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out, total = [], [], 0
        for b in batches:
            ids, places = b.column(0).to_pylist(), b.column(2).to_pylist()
            for row, _, texts in text_slices(b):
                for k, t in enumerate(texts, row):
                    data = np.frombuffer(t.as_buffer(), np.uint8)
                    if len(data) < length:
                        continue
                    p = pieces(data, length)
                    rows.append((ids[k], places[k]))
                    out.append(p)
                    total += len(p[0])
                    if total >= FLUSH or len(out) == 65_000:
                        yield flush(rows, out)
                        rows, out, total = [], [], 0
        if out:
            yield flush(rows, out)

    return run


JUDGED = "doc long, place long, first long, count int, covered boolean"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that are covered as a whole, and the earliest of each content where an anchor has several."""

    def emit(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in JUDGED.split(", ")])

    def judge(payloads: list) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for p in payloads:
            n, m = (int(x) for x in np.frombuffer(p, np.uint32, 2))
            ids = np.frombuffer(p, np.int64, 2 * n, 8).reshape(n, 2)
            at = 8 + 16 * n
            low = np.frombuffer(p, np.uint32, 3 * m, at).reshape(3, m)
            rest = np.frombuffer(p, np.uint16, 4 * m, at + 12 * m).reshape(4, m)
            whole = lambda i: low[i].astype(np.int64) | rest[i].astype(np.int64) << 32
            for c, v in zip(cols, (whole(0), whole(1), ids[rest[2], 0], ids[rest[2], 1], low[2].astype(np.int64), rest[3].astype(np.int32))):
                c.append(v)
        anchor = np.concatenate(cols[0])
        order = np.argsort(anchor)
        same = np.diff(anchor[order]) == 0
        order = order[np.r_[same, False] | np.r_[False, same]]
        if not len(order):
            return
        anchor, content, doc, place, first, count = (np.concatenate(c)[order] for c in cols)
        order = np.lexsort((first, place, doc, content, anchor))
        anchor, content, doc, place, first, count = (c[order] for c in (anchor, content, doc, place, first, count))
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new = new_anchor | np.r_[True, content[1:] != content[:-1]]
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group[new])[group] > 1
        keep = ~new | several
        for a in range(0, len(keep), 200_000):
            k = np.flatnonzero(keep[a : a + 200_000]) + a
            if len(k):
                yield emit(doc[k], place[k], first[k], count[k], ~new[k])

    now, held = None, []
    for b in batches:
        for bucket, payload in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket < 0:
                doc, place, first, count = np.frombuffer(payload.as_buffer(), np.int64).reshape(4, -1)
                yield emit(doc, place, first, count.astype(np.int32), np.ones(len(doc), bool))
                continue
            if bucket != now and held:
                yield from judge(held)
                held = []
            now = bucket
            held.append(payload.as_buffer())
    if held:
        yield from judge(held)


PARTS = "key long, doc long, place long, first long, low int, high int, bytes binary"


def _split(length: int):
    """Rows (doc, place, first, low, high, bytes), bytes[low:high] being in every window; low null: the anchor is.

    A window has `half` of its other bytes before that stretch or, if not, `rest - half + 1` after it. Each row gives
    its windows of the one kind and those of the other, by the stretch grown so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(5)
            data, at = raw(texts)
            n = len(data)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, "p", n)[:n], out=total[1:])
            back = _power(_P_INV, "i", n)
            start, end = at[:-1], at[1:]
            if b.column(3).null_count:
                gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
                # Places in the row, not in the batch, would do as well: only their order counts.
                least = np.r_[gram & ~_LOW | np.arange(len(gram), dtype=np.uint64), np.uint64(0)]
                low = (np.minimum.reduceat(least, np.stack([start, end - GRAM + 1], 1).ravel())[::2] & _LOW).astype(np.int64) - start
                high = low + GRAM
            else:
                low, high = (np.asarray(b.column(i)).astype(np.int64) for i in (3, 4))
            last = end - start - length
            rest = length - (high - low)
            half = (rest + 1) // 2
            doc, place, first = (np.asarray(b.column(i)) for i in range(3))
            out = []
            for side in (0, 1):
                begin, until = (np.zeros_like(last), np.minimum(last, low - half)) if side == 0 else (np.maximum(0, low - half + 1), last)
                lo, hi = (low - half, high) if side == 0 else (low, high + rest - half + 1)
                k = np.flatnonzero((begin <= until) & (rest > 0))
                x, y = (start + lo)[k], (start + hi)[k]
                key = mix((total[y] - total[x]) * back[x] + np.uint64(side * 0x632BE5AB) + (y - x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                f, t = (start + begin)[k], (start + until)[k] + length
                cut = [data[i:j].tobytes() for i, j in zip(f.tolist(), t.tolist())]
                out.append([pa.array(key), pa.array(doc[k]), pa.array(place[k]), pa.array(first[k] + begin[k]), pa.array((lo - begin)[k].astype(np.int32)), pa.array((hi - begin)[k].astype(np.int32)), pa.array(cut, pa.binary())])
            for columns in out:
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PARTS.split(", ")])

    return run


def collection_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All non-empty suffixes of the texts in order: (text, start). Built one symbol of each text a round.

    The texts are parts of UTF-8, so no byte is 255 and a byte plus 1 has room in a byte.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)
    end = np.cumsum(size)
    # The symbol before each suffix in order, 0 where that isn't in the order yet or there is none.
    seen = np.zeros(m, np.uint8)
    live = np.flatnonzero(size > 0)
    rank = live  # of each live text's longest suffix so far
    added = []
    for j in range(int(size.max(initial=0))):
        symbol = joined[end[live] - j - 1]
        turn = np.lexsort((rank, symbol))
        live, rank, symbol = live[turn], rank[turn], symbol[turn]
        order = np.argsort(seen, kind="stable")
        first = np.searchsorted(seen[order], np.arange(257))
        # Existing suffixes that are smaller: the m empty ones, those that begin with a smaller symbol, and of those with
        # this one as many as have their rest before this suffix's rest.
        at = m + first[symbol] - first[1]
        group = np.r_[np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]), len(symbol)]
        for a, z in zip(group[:-1].tolist(), group[1:].tolist()):
            c = int(symbol[a])
            at[a:z] += np.searchsorted(order[first[c] : first[c + 1]], rank[a:z])
        place = at + np.arange(len(at))
        seen[rank] = symbol
        old = np.ones(len(seen) + len(at), bool)
        old[place] = False
        grown = np.zeros(len(old), np.uint8)
        grown[old] = seen
        seen = grown
        added.append((place, live))
        more = size[live] > j + 1
        rank, live = place[more], live[more]
    # Places at the end, from the last round back.
    text, done = np.zeros(len(seen), np.int32), np.zeros(len(seen), np.int32)
    slot = np.arange(len(seen), dtype=np.int32)
    for j in range(len(added) - 1, -1, -1):
        place, which = added[j]
        text[slot[place]], done[slot[place]] = which, j + 1
        old = np.ones(len(slot), bool)
        old[place] = False
        slot = slot[old]
    keep = done > 0
    return text[keep], size[text[keep]] - done[keep]


RANGES = "place long, from_byte long, to_byte long"


def _contested(length: int):
    """Rows (key, doc, place, first, bytes) by key: the byte ranges that an earlier equal window covers."""

    def solve(rows: list[tuple]) -> list[tuple]:
        text, start = collection_order([r[4] for r in rows])
        size = np.array([len(r[4]) for r in rows])
        ok = size[text] - start >= length
        text, start = text[ok], start[ok]
        joined = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        base = np.r_[0, np.cumsum(size)[:-1]]
        window = joined[(base[text] + start)[:, None] + np.arange(length)]
        group = np.cumsum(np.r_[True, (window[1:] != window[:-1]).any(1)]) - 1
        doc, place, first = (np.array([r[i] for r in rows], np.int64)[text] for i in (1, 2, 3))
        order = np.lexsort((first + start, place, doc, group))
        later = order[np.r_[False, group[order][1:] == group[order][:-1]]]
        later = later[np.lexsort((start[later], text[later]))]
        if not len(later):
            return []
        t, s = text[later], start[later]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] > s[:-1] + length)])
        last = np.r_[new[1:] - 1, len(t) - 1]
        return [(rows[t[a]][2], rows[t[a]][3] + int(s[a]), rows[t[a]][3] + int(s[z]) + length) for a, z in zip(new, last)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # pieces that share a key with others
        same: list[tuple] = []  # pieces of the key at hand
        emit = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["place", "from_byte", "to_byte"])
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if same and r[0] != same[0][0]:
                    if len(same) > 1:
                        held += same
                    same = []
                    if len(held) >= COLLECTION:
                        if out := solve(held):
                            yield emit(out)
                        held = []
                same.append(r)
        if len(same) > 1:
            held += same
        if held and (out := solve(held)):
            yield emit(out)

    return run


def contested(rivals: DataFrame, length: int) -> DataFrame:
    """Pieces (doc, place, first, bytes) whose anchors are shared: the ranges that earlier equal windows cover."""
    n = parts(rivals.sparkSession)
    subs = rivals.select("doc", "place", "first", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), "bytes")
    found = []
    while True:
        subs = written(subs.mapInArrow(_split(length), PARTS), "parts")
        hot = written(subs.groupBy("key").count().where(F.col("count") > COLLECTION).select("key"), "hot")
        some = bool(hot.limit(1).count())
        cold = subs.join(hot, "key", "left_anti") if some else subs
        cold = cold.select("key", "doc", "place", "first", "bytes").repartition(n, "key").sortWithinPartitions("key")
        found.append(cold.mapInArrow(_contested(length), RANGES))
        if not some:
            break
        same = ["low", "high", "bytes"]
        mine = subs.join(hot, "key", "left_semi")
        first = written(mine.groupBy(*same).agg(F.min(F.struct("doc", "place", "first")).alias("one"), F.count("*").alias("times")), "one")
        later = mine.join(first.where("times > 1").select(*same, "one"), same).where(F.struct("doc", "place", "first") != F.col("one"))
        found.append(later.select("place", F.col("first").alias("from_byte"), (F.col("first") + F.length("bytes")).alias("to_byte")))
        subs = first.select("one.doc", "one.place", "one.first", *same)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ranges = b.column(2)
        owner = np.repeat(np.arange(len(ranges)), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
        flat = ranges.flatten()
        start, end = (np.asarray(flat.field(i)) for i in (0, 1))
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        base = owner << 32  # a text has fewer bytes
        reach = np.maximum.accumulate(base + end)
        new = np.flatnonzero(np.r_[True, (base + start)[1:] > reach[:-1]]) if len(owner) else np.zeros(0, np.int64)
        owner, start, end = owner[new], start[new], (reach - base)[np.r_[new[1:] - 1, len(reach) - 1]] if len(new) else end[:0]
        at = np.searchsorted(owner, np.arange(len(ranges) + 1))
        out = []
        for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            data, s, e = memoryview(text.as_buffer()), start[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist()
            kept = hashlib.sha256()
            for x, y in zip([0, *e], [*s, len(data)]):
                kept.update(data[x:y])
            out.append((None if doc == LAST else doc, len(data), sum(e) - sum(s), len(s), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=[x.split()[0] for x in OUT.split(", ")])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    t = texts_only(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", F.monotonically_increasing_id().alias("place"))
    buckets = min(65536, 2 * parts(spark))
    dealt = t.mapInArrow(_cut(length, buckets), "bucket int, payload binary").repartition(parts(spark), "bucket")
    judged = written(dealt.sortWithinPartitions("bucket").mapInArrow(_judged, JUDGED), "judged")
    del dealt
    release(spark)
    rivals = judged.where("NOT covered")
    cut = F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), F.col("count") - 1 + length)
    rivals = contested(t.select("place", "text").join(rivals, "place").select("doc", "place", "first", cut.alias("bytes")), length)
    whole = judged.where("covered").select("place", F.col("first").alias("from_byte"), (F.col("first") + F.col("count") - 1 + length).alias("to_byte"))
    ranges = written(whole.union(rivals).groupBy("place").agg(F.collect_list(F.struct("from_byte", "to_byte")).alias("ranges")), "ranges")
    release(spark)
    return t.join(ranges, "place", "left").select("doc", F.col("text").cast("binary").alias("text"), "ranges").mapInArrow(_removed, OUT)
