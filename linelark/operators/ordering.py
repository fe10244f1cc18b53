"""Contiguous numbers in a global order, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.store import stored


def with_running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one in ``order`` (total, distinct keys).

    Rows are dealt to ranges once and written with their range's number; the only rows that meet are one sum a range.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_range", "_before", "_own")
