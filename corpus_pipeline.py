"""The training-corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing.

Each stage gets the rows that the one before kept, as a table written to the shared folder and read again. All but the
last return the columns of documents. They decide on each row by a number of its own, so rows with null or repeated
doc_ids stay or go each by themselves.

Cases: null, empty and letterless texts go in the first stage. Of equal texts one row stays, whatever its doc_id, also
where all of them have none or the same one; likewise of near copies. Very long texts are read whole. An empty table
gives no rows at every stage. Columns beyond doc_id and text are kept as they are, also ones named like those the
operators make.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.llm.common import by_row, documents, keyed, only, written
from octolith.llm.decontaminate import drop_contaminated
from octolith.llm.exact_dedup import exact_dedup
from octolith.llm.jaccard import keep_one
from octolith.llm.language import language_id
from octolith.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter."""
    rows = keyed(docs)
    return only(rows, language_id(by_row(rows), learn=rows).where("lang_pred = 'und'").select("doc_id"), "left_anti")


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays (a null one only without another; equal ones: the first row)."""
    rows = keyed(docs)
    own = rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("own"))
    groups = exact_dedup(by_row(rows), keep="largest").select(F.col("doc_id").alias("row"), "keep_id").join(own, "row")
    return only(rows, groups.groupBy("keep_id").agg(F.max(F.struct("own", (-F.col("row")).alias("m"))).alias("k")).select(-F.col("k.m")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links lead to, the one with the smallest doc_id stays (a null one is the last)."""
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", known_language), ("exact dedup", one_of_each_text), ("near dedup", one_of_each_group), ("decontamination", without_benchmark), ("packing", packed)]

#: Tokenised packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
