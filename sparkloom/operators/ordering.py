"""Positions in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stage, width


def global_position(df: DataFrame, order: list[Column], name: str = "position", total: str = "total") -> DataFrame:
    """Adds the 0-based position of each row in ``order`` and the number of rows.

    Rows are range-partitioned once; the ranges' counts (one row per partition, hence a broadcast of bounded
    size) turn places inside a range into global ones. Equal rows are interchangeable and spread over ranges
    by a last, arbitrary key. An empty table stays empty.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    ranges = stage(
        spread.repartitionByRange(width(df.sparkSession), *order, "_tie").withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    whole = Window.orderBy("_range")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select(
        "_range",
        (F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    return (
        ranges.join(F.broadcast(before), "_range")
        .withColumn(name, F.col("_before") + within - 1)
        .drop("_range", "_before", "_tie")
    )
