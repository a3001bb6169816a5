"""Positions in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import cut_lineage


def ranked(df: DataFrame, *by: str, name: str = "rank") -> DataFrame:
    """`df` with each row's position (from 0) in the order of `by`, for tables of any size.

    Spark's range partitioning sorts the rows; a row's place is its partition's start and its number inside. Only one
    count for each partition is summed in order. `by` should end in something that tells rows apart, or a hot value is
    one partition. The sorted rows are written to the shared folder, so positions stay fixed.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(count, *by).sortWithinPartitions(*by)
    held = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(starts, "_part").withColumn(name, place).drop("_at", "_part", "_start")
