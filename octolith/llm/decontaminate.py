"""Benchmark decontamination: windows of training words are looked up in a broadcast set of benchmark n-grams.

The benchmark's windows go to the scan in blocks of at most `block` windows, each broadcast by itself, so that
what is broadcast is bounded whatever the benchmark's size; a larger benchmark takes more scans of the text.
Hits on the 64-bit hash are verified against the window's words.

With several blocks rows are told apart by their place in the scan, so `docs` has to be a scan of stored tables then.

Cases: a null text or one without words has no hits. An item with fewer words than a window is one window; an
item without words is none. Items with a null item_id count as one item without a name in items_sha256. Repeated documents are reported each; repeated items once.
An empty benchmark leaves every document clean. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.common import by_row, keyed, only, text_slices, texts_only, written
from octolith.llm.words import ALNUM, Words, windows

GRAMS = "h long, n int, gram binary, item_id long"
HITS = "doc_id long, n_words long, from_word array<int>, to_word array<int>, items array<long>"
NO_ITEMS = hashlib.sha256(b"").hexdigest()
_BITS = 1 << 22


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows of every item: hash, number of words, the words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for row, _, texts in text_slices(b):
                w = Words(texts, ALNUM)
                h = w.hashes()
                out = []
                for k in range(len(texts)):
                    a, z = int(w.first[k]), int(w.first[k + 1])
                    size = min(n, z - a)
                    if not size:
                        continue
                    words = [w.word(i) for i in range(a, z)]
                    for i, x in enumerate(windows(h[a:z], size).view(np.int64)):
                        out.append((int(x), size, b" ".join(words[i : i + size]), ids[row + k].as_py()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["h", "n", "gram", "item_id"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, GRAMS).distinct()


def _tables(rows: list) -> dict:
    """For each number of words: sorted hashes, a bit for each hash, and (words, items) at each hash."""
    by: dict[int, dict[int, dict[bytes, list[int]]]] = {}
    for r in rows:
        by.setdefault(r.n, {}).setdefault(r.h, {}).setdefault(bytes(r.gram), []).append(r.item_id)
    out = {}
    for n, at in by.items():
        keys = np.array(sorted(at), np.int64)
        bits = np.zeros(_BITS, bool)
        bits[keys & (_BITS - 1)] = True
        out[n] = (keys, bits, [at[int(k)] for k in keys])
    return out


def _scan(tables):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, texts in text_slices(b):
                w = Words(texts, ALNUM)
                h, owner = w.hashes(), w.owner()
                found: dict[int, list[tuple[int, int, list[int]]]] = {}
                for n, (keys, bits, grams) in tables.value.items():
                    x = windows(h, n).view(np.int64)
                    near = np.flatnonzero(bits[x & (_BITS - 1)])
                    if not len(near):
                        continue
                    near = near[owner[near] == owner[near + n - 1]]
                    slot = np.minimum(np.searchsorted(keys, x[near]), len(keys) - 1)
                    for i, k in zip(near[keys[slot] == x[near]], slot[keys[slot] == x[near]]):
                        items = grams[k].get(b" ".join(w.word(j) for j in range(i, i + n)))
                        if items:
                            found.setdefault(int(owner[i]), []).append((int(i - w.first[owner[i]]), n, items))
                starts, ends, items = [], [], []
                for k in range(end - row):
                    hit = sorted(found.get(k, ()), key=lambda f: f[:2])
                    s: list[int] = []
                    e: list[int] = []
                    for a, n, _ in hit:
                        if e and a <= e[-1]:
                            e[-1] = max(e[-1], a + n)
                        else:
                            s.append(a)
                            e.append(a + n)
                    starts.append(s)
                    ends.append(e)
                    items.append(sorted({i for f in hit for i in f[2]}, key=lambda i: (i is not None, i)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), pa.array(np.diff(w.first)), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "n_words", "from_word", "to_word", "items"])

    return scan


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, the maximal runs of hit words [from_word, to_word), the items found."""
    spark = docs.sparkSession
    grams = written(item_windows(benchmark, n), "grams")
    blocks = max(1, -(-grams.count() // block))

    def scan(k: int) -> tuple[DataFrame, Broadcast]:
        rows = grams.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == k).collect()
        tables = spark.sparkContext.broadcast(_tables(rows))
        return texts_only(docs).mapInArrow(_scan(tables), HITS), tables

    if blocks == 1:
        return scan(0)[0]
    # Every scan reads the same rows in the same order, so a row's number ties its hits together. One block is held at a time.
    tied = None
    for k in range(blocks):
        hits, tables = scan(k)
        hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
        tables.destroy()
        tied = hits if tied is None else tied.unionByName(hits)
    each = tied.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("from_word", "to_word")))).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    join = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to_word"] >= x["from_word"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["from_word"].alias("from_word"), F.greatest(F.element_at(acc, -1)["to_word"], x["to_word"]).alias("to_word"))))).otherwise(F.concat(acc, F.array(x)))
    merged = each.withColumn("runs", F.aggregate("runs", F.array().cast("array<struct<from_word:int,to_word:int>>"), join))
    return merged.select("doc_id", "n_words", F.col("runs.from_word").alias("from_word"), F.col("runs.to_word").alias("to_word"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = 500_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = contaminated_spans(docs, benchmark, n, block)
    hit = F.aggregate(F.zip_with("from_word", "to_word", lambda a, z: (z - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    joined = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return s.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, block: int = 500_000) -> DataFrame:
    """The documents without any benchmark window, all columns as they were. Each row is judged by itself, whatever its doc_id."""
    rows = keyed(docs)
    return only(rows, contamination(by_row(rows), benchmark, n, block).where("contaminated").select("doc_id"), "left_anti")
