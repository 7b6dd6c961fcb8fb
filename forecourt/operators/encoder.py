"""Codes of categories as a table that Spark numbers, saves and joins; no label passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecourt.operators.numbering import numbered
from forecourt.session import scratch_path

FIELD, VALUE, CODE = "field", "value", "code"


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, code): the distinct values of each column, numbered by alphabet from 0.

    Values are sorted by range, so that a column with very many of them is spread over tasks. Nulls
    get no code. Returns a written table.
    """
    spark = df.sparkSession
    entries = F.array(*[F.struct(F.lit(c).alias(FIELD), F.col(c).cast("string").alias(VALUE)) for c in columns])
    values = df.select(F.explode(entries).alias("x")).select("x.*").filter(F.col(VALUE).isNotNull()).distinct()
    coded = numbered(values, [FIELD, VALUE], [FIELD], CODE).withColumn(CODE, F.col(CODE).cast("double"))
    path = scratch_path(spark, "codes")
    coded.write.partitionBy(FIELD).parquet(path)
    return read_codes(spark, path)


def read_codes(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{VALUE} string, {CODE} double, {FIELD} string").parquet(path)


def encode(df: DataFrame, codes: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """Add the code of each column as `<column><suffix>`, null where the value has none.

    One join per column on a side without repeated keys, so a hot value can be split among tasks;
    sides that are small when measured are broadcast.
    """
    for c in columns:
        known = codes.filter(F.col(FIELD) == c).select(F.col(VALUE).alias(f"_{c}_value"), F.col(CODE).alias(f"{c}{suffix}"))
        df = df.join(known, F.col(c).cast("string") == F.col(f"_{c}_value"), "left").drop(f"_{c}_value")
    return df


def unknown_fields(columns: list[str], suffix: str = "_code"):
    """The columns whose value is given, not null or empty, but has no code; comma-joined in their order."""
    given = [F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in columns]
    names = [F.when(g & F.col(f"{c}{suffix}").isNull(), F.lit(c)) for c, g in zip(columns, given, strict=True)]
    return F.concat_ws(",", *names)
