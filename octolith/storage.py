"""Cutting lineage with tables in the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one where that setting is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='octolith-')}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: level loops plan one level at a time and survive lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
