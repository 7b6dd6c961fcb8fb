"""Row filters of the cleaning job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.schema import NOT_FOUND


def in_range(value: Column, bounds: tuple[float, float]) -> Column:
    """Closed range; a missing value is outside."""
    return value.between(*bounds)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_not_found(df: DataFrame, columns: list[str], sentinel: str = NOT_FOUND) -> DataFrame:
    """Drop rows in which a field is missing or says so; an empty text is a value here."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & F.col(c).isNotNull() & (F.col(c) != sentinel)
    return df.filter(kept)


def exclude_pair(df: DataFrame, first: str, second: str, pair: tuple[str, str]) -> DataFrame:
    """Drop rows with this first value together with this second value in any letter case."""
    hit = (F.col(first) == pair[0]) & (F.lower(second) == pair[1])
    return df.filter(~F.coalesce(hit, F.lit(False)))


def block(df: DataFrame, columns: list[str], words: tuple[str, ...]) -> DataFrame:
    """Drop rows with a listed word, in any letter case, in one of the columns; nulls stay."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).isin(*words), F.lit(False))
    return df.filter(~hit)
