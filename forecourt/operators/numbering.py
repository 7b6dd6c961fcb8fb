"""Numbers for the rows of a table in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.session import scratch_path

_PLACES = 33  # bits of a row's place inside its part, by `monotonically_increasing_id`


def numbered(df: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "position") -> DataFrame:
    """Add each row's number from 0 in the order, or in its group if the order begins with `within`.

    Rows are sorted by range, so that tasks have about as many each, and numbered in two steps:
    their place in their part, and how many of their group lie in the parts before. The order must
    settle ties; equal keys share a part. The numbers come from a written table, so a lost task
    that runs again cannot deal the ranges differently.
    """
    within = within or []
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ordered")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).select(
        *df.columns, F.shiftright("_at", _PLACES).alias("_part"), F.col("_at").bitwiseAND(2**_PLACES - 1).alias("_place")
    )
    # One row for each part and group that meet; a part holds few groups but whole ones.
    parts = placed.groupBy(*within, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*within, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(starts, [*within, "_part"]).select(*df.columns, (F.col("_place") + F.col("_start")).alias(name))
