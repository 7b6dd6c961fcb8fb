"""Column steps: constants, conversion, order, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.numbers import litres, strict_number
from forecourt.schema import RAW_A


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` for costly expressions that later filters look at.

    Filters move below a plain projection and take a copy of each expression along. They cannot
    move below the generator that hands the finished values on, so every expression is worked
    out once per row.
    """
    made = df.withColumns({f"_made_{name}": value for name, value in columns.items()})
    handed_on = F.inline(F.array(F.struct(*[F.col(f"_made_{name}").alias(f"_out_{name}") for name in columns])))
    kept = [c for c in df.columns if c not in columns]
    rows = made.select(*kept, handed_on)
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    return rows.select(*[F.col(f"_out_{c}").alias(c) if c in columns else F.col(c) for c in order])


def with_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


def convert_volume(df: DataFrame, columns: list[str] = RAW_A) -> DataFrame:
    """Engine volume in litres out of cm³ where the table has it, columns in the listing order.

    A cm³ value that is no number, or a column that is missing, fails the job.
    """
    if "volume_cm3" in df.columns:
        df = df.withColumn("volume_l", litres(strict_number(F.col("volume_cm3")))).drop("volume_cm3")
    return df.select(*columns)


def as_of(year: int | None) -> Column:
    return F.lit(year) if year is not None else F.year(F.current_date())


def age(year: Column, as_of_year: int | None) -> Column:
    return (as_of(as_of_year) - year).cast("int")
