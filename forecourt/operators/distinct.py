"""Distinct rows, first row per key, union, and append of new rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct, nulls equal. Copies are collapsed before the shuffle."""
    return df.dropDuplicates()


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. `order` must settle ties.

    Spark keeps one row per key and task before the shuffle, so a key that holds a large part of
    the table does not reach one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def union_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; columns matched by name, absent ones null."""
    return first.unionByName(second, allowMissingColumns=True)


def union_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    return distinct_rows(union_tables(first, second))


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of the batch whose key the existing table lacks; nulls are equal.

    The key is one struct, so the distinct and the join share a single shuffle per side. Copies
    collapse before it: no key can be hot in the join.
    """
    key = F.struct(*keys).alias("_key")
    others = [c for c in batch.columns if c not in keys]
    arriving = batch.select(key, *others).dropDuplicates(["_key"])
    known = existing.select(key).distinct()
    return arriving.join(known, "_key", "left_anti").select(
        *[F.col("_key")[c].alias(c) if c in keys else F.col(c) for c in batch.columns]
    )
