"""Exact dedup: tree-merge of sorted digest runs.

Every scan partition sorts its digests into a run with one record for each text. Runs then meet in binomial
rounds of fan-in 16: in round r the runs whose numbers differ in hex digit r alone exchange records by hex
digit r of the digest, and every receiver merges the sorted runs it got, adding counts and keeping the
winning identifier. After the last round a run's number is a digest prefix, so all records of a text have
met, and no run ever held more than its share. A record is a text's only if SHA-256, byte length and a
second hash agree; this is verified at every merge.

Cases: a null text is an empty text; equal texts are those with the same UTF-8 bytes. A null doc_id never
wins over another one; where a group has no other, keep_id is null and its rows are kept. Rows that repeat
a doc_id count each and are reported each. An empty table gives no rows. Other columns are ignored.
The doc_id -2**63 is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.common import parts, texts_only, written

KEY = ["text_sha256", "n_bytes", "second"]
RUN = "run long, text_sha256 string, n_bytes int, second long, winner long, members long"
NONE = -(2**63)


def _merged(table: pa.RecordBatch | pa.Table, keep: str) -> pa.RecordBatch:
    """Neighbours with the same run and key become one record."""
    table = pa.table(table).combine_chunks()
    n = len(table)
    new = np.ones(n, bool)
    if n > 1:
        differ = np.zeros(n - 1, bool)
        for name in ("run", *KEY):
            c = table.column(name).combine_chunks()
            differ |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differ
    at = np.flatnonzero(new)
    best = (np.maximum if keep == "largest" else np.minimum).reduceat(table.column("winner").to_numpy(), at)
    total = np.add.reduceat(table.column("members").to_numpy(), at)
    out = table.select(["run", *KEY]).take(pa.array(at))
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in out.columns), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=["run", *KEY, "winner", "members"])


def _merge_runs(keep: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # the record that the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_arrays(b.columns, names=b.schema.names)  # without the batch's own nullability
            m = _merged(pa.concat_tables([pa.table(open_), t]) if open_ is not None else t, keep)
            open_ = m.slice(m.num_rows - 1)
            if m.num_rows > 1:
                yield m.slice(0, m.num_rows - 1)
        if open_ is not None:
            yield open_

    return merge


def merge_tree(digests: DataFrame, keep: str = "largest", fan_in_digits: int = 1) -> DataFrame:
    """digests (doc_id and KEY) to one row of KEY, winner and members for each text."""
    spark = digests.sparkSession
    merge = _merge_runs(keep)
    none = F.lit(NONE if keep == "largest" else 2**63 - 1)
    level = digests.select(F.spark_partition_id().cast("long").alias("run"), *KEY, F.coalesce("doc_id", none).alias("winner"), F.lit(1).cast("long").alias("members"))
    n_runs = max(2, digests.rdd.getNumPartitions())
    level = level.sortWithinPartitions("run", *KEY).mapInArrow(merge, RUN)
    rounds = 1
    while 16**rounds < n_runs:
        rounds += 1
    for r in range(rounds):
        unit = 16**r
        digit = F.conv(F.substring("text_sha256", r + 1, 1), 16, 10).cast("long")
        own = F.floor(F.col("run") / unit) % 16
        level = level.withColumn("run", F.col("run") + (digit - own) * unit)
        level = level.repartition(parts(spark), "run").sortWithinPartitions("run", *KEY).mapInArrow(merge, RUN)
    return level.select(*KEY, F.when(F.col("winner") != none, F.col("winner")).alias("keep_id"), F.col("members").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: 'largest' or 'smallest' doc_id."""
    t = texts_only(docs)
    digests = written(t.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("second")), "digests")
    groups = merge_tree(digests, keep)
    return digests.join(groups, KEY).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
