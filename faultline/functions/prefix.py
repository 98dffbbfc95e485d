"""Running sums and neighbours in a sorted order that no single task has to hold.

Rows are range-partitioned by (group, order) and stored with the number of their partition.
Running sums are made inside each partition and shifted by the totals of the partitions before
it; the few rows at partition edges find their neighbours among the edge rows of all
partitions.  Windows without a partition number run over those small tables only: a row per
(group, partition), or 2 k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize


def spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` stored, sorted into ranges of (by, order), with the range's number as ``part``."""
    return materialize(df.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "ranges")


def running_sum(held: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``held`` (of ``spread``) with ``out``: the sum of ``value`` over the group's rows up to this one."""
    totals = held.groupBy(*by, "part").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn(out, F.sum(value).over(upto))
    return run.join(totals, [*by, "part"]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def neighbours(held: DataFrame, by: list[str], order: str, value, k: int, out: str) -> DataFrame:
    """``held`` with ``out``: an array of ``value`` of the group's k rows before and k rows after this
    one (fewer at the group's ends).  ``order`` tells the rows of a group apart."""
    def beside(window):
        return [f(value, i).over(window) for f in (F.lag, F.lead) for i in range(1, k + 1)]

    inside = Window.partitionBy(*by, "part").orderBy(order)
    own = held.withColumn("_in", F.array(*beside(inside))).withColumn("_rank", F.row_number().over(inside)).withColumn(
        "_left", F.count(F.lit(1)).over(Window.partitionBy(*by, "part")) - F.col("_rank"))
    edge = own.where((F.col("_rank") <= k) | (F.col("_left") < k)).select(*held.columns)
    over = edge.withColumn("_out", F.array(*beside(Window.partitionBy(*by).orderBy(order)))).select(*by, order, "_out")
    both = own.join(over, [*by, order], "left")
    merged = F.when(F.col("_out").isNull(), F.col("_in")).otherwise(
        F.zip_with("_in", "_out", lambda a, b: F.coalesce(a, b)))
    return both.withColumn(out, F.filter(merged, lambda x: x.isNotNull())).drop("_in", "_out", "_rank", "_left")
