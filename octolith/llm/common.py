"""What the operators share: the shared working folder, written tables and Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: operators size their buckets by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one where that setting is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='octolith-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later plans start from its files, which outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._octolith_path = path
    return out


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(*tables: DataFrame) -> None:
    """Removes written tables that no later plan starts from, so that they don't take up disk till the session ends."""
    for t in tables:
        system, at = _files(t.sparkSession, t._octolith_path)
        system.delete(at, True)


def keyed(docs: DataFrame) -> DataFrame:
    """docs and `__row`, a number of its own for each row, whatever its doc_id: its place in the scan.

    docs has to be a scan of stored tables, as the stages of the pipeline get it, so that each read gives the same numbers.
    """
    return docs.withColumn("__row", F.monotonically_increasing_id())


def by_row(rows: DataFrame) -> DataFrame:
    """Keyed rows with their number as doc_id, to be judged each by itself."""
    return rows.withColumn("doc_id", F.col("__row")).drop("__row")


def only(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Of keyed rows those (left_anti: all but those) whose numbers are in the one column of keys, without the number."""
    keys = keys.toDF("__key")
    return rows.join(keys, rows["__row"] == keys["__key"], how).drop("__row")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named, nothing else: other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES):
    """(first row, last row + 1, texts) of a batch, cut so that each slice holds about `size` bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    at = offsets(texts)
    row = 0
    while row < len(texts):
        end = row + 1
        while end < len(texts) and at[end + 1] - at[row] <= size:
            end += 1
        yield row, end, texts.slice(row, end - row)
        row = end


def offsets(texts: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def raw(texts: pa.Array):
    """The UTF-8 bytes of all texts end to end, and where each begins (one more: the end)."""
    import numpy as np

    at = offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
