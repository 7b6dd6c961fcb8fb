"""Value domains and counts of the clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.operators.numbering import numbered


def domain(df: DataFrame, *columns: str) -> DataFrame:
    """Sorted distinct values of a column, or of a path of columns such as brand, model, volume.

    One pass for all brands; a brand's models are the rows `lookup` finds.
    """
    return df.select(*columns).na.drop().distinct().orderBy(*columns)


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Rows with these column values."""
    kept = F.lit(True)
    for name, value in equals.items():
        kept = kept & (F.col(name) == value)
    return df.filter(kept)


def domain_whole(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, values): the sorted distinct values of each key as one list, at any size."""
    found = df.select(*keys, value).na.drop(subset=[*keys, value]).distinct()
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def labels(values: Column) -> Column:
    """A list of numbers as texts."""
    return F.transform(values, lambda v: v.cast("string"))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The most frequent values, ties by value."""
    counted = df.na.drop(subset=[column]).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(n)


def preview(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def price_order(df: DataFrame, ties: list[str] | None = None) -> list[Column]:
    """Ascending price, unreadable and missing prices last, then the columns `ties`."""
    price = df.schema["price"].dataType
    key = F.col("price").try_cast("double") if price.typeName() == "string" else F.col("price")
    return [key.asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties or []]]


def sorted_by_price(df: DataFrame) -> DataFrame:
    """Rows by `price_order`. For the last step before a sink."""
    return df.orderBy(*price_order(df))


def export_by_price(df: DataFrame, path: str, ties: list[str]) -> None:
    """Parquet part files in price order, one behind the other, with each row's `position` from 1.

    The parts are ranges of positions, so a price that very many rows share is split among files.
    Rows that are equal in price and `ties` come in any order.
    """
    placed = numbered(df, price_order(df, ties)).withColumn("position", F.col("position") + 1)
    placed.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(path)
