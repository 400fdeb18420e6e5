"""Row numbers, running sums and carried values over a whole table, without a window over all of it.

Rows are range-partitioned and written once; each range is summed up by itself, and only one row a range is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from octolith.storage import cut


def ranges(rows: DataFrame, by: list[str | Column]) -> DataFrame:
    """rows and `__range`, the number of a range of them in that order; a written table."""
    return cut(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranges")


def _starts(per: DataFrame, name: str, over: Column) -> DataFrame:
    """__range and `name`, what comes before it: one row a range, so one window holds them."""
    return F.broadcast(per.select("__range", over.alias(name)))


def running_sum(rows: DataFrame, by: list[str | Column], value: str, name: str) -> DataFrame:
    """rows and `name`, the sum of `value` over all rows before each in the order `by` (which tells rows apart)."""
    dealt = ranges(rows, by)
    per = dealt.groupBy("__range").agg(F.sum(value).alias("total"))
    before = _starts(per, "__start", F.coalesce(F.sum("total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__own", within).join(before, "__range").withColumn(name, F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def carried(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """rows and `name`, the last `value` that isn't null at or before each row in the order `by`."""
    dealt = ranges(rows.withColumn("__value", value), [by])
    per = dealt.where("__value IS NOT NULL").groupBy("__range").agg(F.max_by("__value", by).alias("last")).join(dealt.select("__range").distinct(), "__range", "right")
    before = _starts(per, "__start", F.last("last", ignorenulls=True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(before, "__range").withColumn(name, F.coalesce("__own", "__start")).drop("__range", "__own", "__start", "__value")


def running_mean(rows: DataFrame, by: str, columns: list[str], n: int) -> DataFrame:
    """`by` (whole numbers without gaps) and the mean of each column over n consecutive rows from each on; full frames only.

    Rows are dealt to blocks of numbers, and each also goes to the blocks whose frames reach it.
    """
    size = max(n, 4096)
    block = F.explode(F.sequence(F.floor((F.col(by) - (n - 1)) / size), F.floor(F.col(by) / size))).alias("__block")
    dealt = rows.select(by, *columns, block)
    w = Window.partitionBy("__block").orderBy(by).rowsBetween(Window.currentRow, n - 1)
    own = dealt.select(by, "__block", *(F.avg(c).over(w).alias(c) for c in columns), F.count("*").over(w).alias("__k"))
    return own.where((F.col("__k") == n) & (F.floor(F.col(by) / size) == F.col("__block"))).select(by, *columns)
