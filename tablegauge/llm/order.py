"""Places in a global order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import written


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 0, in the order given.

    Rows are dealt into ranges of the order and written; the ranges' row counts, one row for
    each partition, give every range its first place.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "places")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are partitions
    first = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(F.broadcast(first), "_range")
    return placed.withColumn(name, (F.col("_first") + F.col("_within")).cast("long")).drop("_range", "_first", "_within")
