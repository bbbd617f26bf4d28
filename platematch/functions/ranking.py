"""Global rank without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platematch.session import stage

RANGE_ROWS = 50_000


def newest_first_rank(df: DataFrame, id_column: str, rank: str = "rank", descending: bool = True) -> DataFrame:
    """1-based rank of a unique id, highest first (or lowest first).  Rows without an id come last.

    Rows are dealt into ranges of about ``RANGE_ROWS`` rows whose limits Spark
    takes from the data, so it does not matter how the ids are spread, and are
    written once with the number of their range.  The counts of the ranges, one
    row each, give each range its offset; inside a range the rank is a window.
    """
    order = F.col(id_column).desc_nulls_last() if descending else F.col(id_column).asc_nulls_last()
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    placed = stage(df.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range").orderBy(order)
    return (
        placed.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(rank, (F.col("_offset") + F.col("_pos")).cast("bigint"))
        .drop("_range", "_pos", "_offset")
    )
