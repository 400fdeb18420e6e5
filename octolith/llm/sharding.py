"""Sharding: Karmarkar-Karp differencing of groups of equal texts into shards of near equal bytes.

A partial partition is a tuple of as many sums as there are shards. The two with the largest spread are
combined, the largest sum of one with the smallest of the other, until one is left. This runs in bounded
buckets of groups, each of which ends as one tuple; the tuples are differenced again, 1024 at a time, in as many
levels as that takes. Only the sums travel upwards, and only what each level did with the slots comes back.

Cases: a null text is an empty one with no bytes (size 1). Documents with equal texts share a shard, even if
that group is larger than a shard should be. Repeated rows count each and get slots of their own. A null doc_id
is as good as another. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.llm.common import parts, texts_only, written

#: Groups in a bucket, and tuples that are differenced together.
BUCKET, FAN_IN = 20_000, 1024


def difference(items: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """For each item, a list of sums: which slot of the result each of its sums went to; and the result's sums."""
    k = len(items[0])
    nodes: list[tuple] = []
    heap = []
    for i, sums in enumerate(items):
        order = sorted(range(k), key=lambda s: -sums[s])
        nodes.append((order,))
        vals = [sums[s] for s in order]
        heap.append((vals[-1] - vals[0], i, vals))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[i] + y[k - 1 - i] for i in range(k)]
        order = sorted(range(k), key=lambda s: -sums[s])
        vals = [sums[s] for s in order]
        heapq.heappush(heap, (vals[-1] - vals[0], len(nodes), vals))
        nodes.append((order, a, b))
    out: list[list[int]] = [[] for _ in items]
    stack = [(heap[0][1], list(range(k)))]
    while stack:
        i, to = stack.pop()
        order = nodes[i][0]
        if len(nodes[i]) == 1:
            out[i] = [0] * k
            for place, slot in enumerate(order):
                out[i][slot] = to[place]
            continue
        left, right = [0] * k, [0] * k
        for place, slot in enumerate(order):
            left[slot], right[k - 1 - slot] = to[place], to[place]
        stack += [(nodes[i][1], left), (nodes[i][2], right)]
    return out, heap[0][2]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    base = texts_only(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("place"))
    base = written(base, "sizes")
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-base.count() // BUCKET))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"])
        to, sums = difference([[int(b)] + [0] * (shards - 1) for b in pdf["bytes"]])
        return pd.DataFrame({"digest": pdf["digest"].to_numpy(), "bucket": int(pdf["bucket"].iloc[0]), "slot": [t[0] for t in to], "sums": [sums] * len(pdf)})

    # One pass over the groups: a group's slot, and the bucket's sums beside it.
    low = written(groups.groupBy("bucket").applyInPandas(first, "digest string, bucket long, slot int, sums array<long>"), "slots")
    level = low.groupBy("bucket").agg(F.first("sums").alias("sums"))
    moves = []  # for each level: bucket, slot -> upper bucket, upper slot
    n = buckets
    while n > 1:

        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bucket")
            to, sums = difference([[int(x) for x in s] for s in pdf["sums"]])
            upper = int(pdf["bucket"].iloc[0]) // FAN_IN
            return pd.DataFrame([(int(b), s, upper, t[s], sums) for b, t in zip(pdf["bucket"], to) for s in range(shards)], columns=["bucket", "slot", "upper", "upper_slot", "sums"])

        step = written(level.groupBy(F.floor(F.col("bucket") / FAN_IN).alias("g")).applyInPandas(up, "bucket long, slot int, upper long, upper_slot int, sums array<long>"), "level")
        moves.append(step.drop("sums"))
        level = step.groupBy(F.col("upper").alias("bucket")).agg(F.first("sums").alias("sums"))
        n = -(-n // FAN_IN)
    place = None
    for step in reversed(moves):
        if place is None:
            place = step.select("bucket", "slot", F.col("upper_slot").alias("shard"))
        else:
            place = step.join(place.select(F.col("bucket").alias("upper"), F.col("slot").alias("upper_slot"), "shard"), ["upper", "upper_slot"]).select("bucket", "slot", "shard")
    placed = low.select("digest", F.col("slot").alias("shard")) if place is None else low.join(place, ["bucket", "slot"]).select("digest", "shard")
    rows = written(base.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", "place"), F.lit(16 * parts(spark))).alias("chunk")), "shards")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32"))
    out = rows.withColumn("rank", rank).join(offset, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
