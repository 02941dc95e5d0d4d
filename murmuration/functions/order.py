"""Totals over a whole order, without one task that gets all rows.

Rows are cut into ranges of the order, each range is summed in its own task, and a range's start comes from the sums of those
before it: a table of one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stage


def running_total(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Adds ``upto``, the sum of ``value`` over the rows up to and with this one in the order, and ``total``, that of all. The order must be strict."""
    cut = stage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("__range").agg(F.sum(value).alias("__held"))
    whole = Window.partitionBy(F.lit(0)).orderBy("__range")  # one row for each range
    sums = sums.select("__range", F.coalesce(F.sum("__held").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__held").over(Window.partitionBy(F.lit(0))).alias("total"))
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("upto", F.sum(value).over(own)).join(F.broadcast(sums), "__range").withColumn("upto", F.col("upto") + F.col("__before")).drop("__range", "__before")
