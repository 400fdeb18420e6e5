"""Point sets, triangles and rays taken from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def points_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select("vec_id", *(F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")))


def points_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select("event_id", F.unix_timestamp("ts").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"))


def embedding_columns(spark: SparkSession, sf_dir: str, names: list[str], scale: float, shift: float) -> DataFrame:
    """vec_id and the first elements of each embedding as scale * (element + shift)."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select("vec_id", *(((F.col("embedding")[i].cast("double") + shift) * scale).alias(n) for i, n in enumerate(names)))
