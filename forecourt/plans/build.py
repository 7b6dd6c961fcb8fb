"""Raw listings of both sources to the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from forecourt.operators.columns import convert_volume, with_source
from forecourt.operators.distinct import union_tables
from forecourt.operators.lookups import sorted_by_price
from forecourt.params import CleanRules
from forecourt.plans.clean import clean_listings
from forecourt.schema import MERGED, SOURCE_A, SOURCE_B
from forecourt.sources.tables import null_tokens_to_null, read_csv, write_csv, write_table


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same table, plus its row count as a by-product of whatever runs it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both raw tables in one, litres throughout, with their source; all columns text.

    Texts that stand for a missing value are null from here on, also in tables that no CSV edge read.
    """
    a, b = null_tokens_to_null(a), null_tokens_to_null(b)
    both = union_tables(
        with_source(a, SOURCE_A),
        with_source(convert_volume(b).withColumn("volume_l", F.col("volume_l").cast("string")), SOURCE_B),
    )
    return both.select(*MERGED)


def build_clean(a: DataFrame, b: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    return clean_listings(merge_sources(a, b), rules)


def run_build(
    spark: SparkSession, a_csv: str, b_csv: str, merged_path: str, clean_path: str,
    rules: CleanRules = CleanRules(), export_csv: str | None = None,
) -> dict[str, int]:
    """CSV exports of both sources to Parquet tables; returns the row counts of each step."""
    a, seen_a = counted(read_csv(spark, a_csv), "a")
    b, seen_b = counted(read_csv(spark, b_csv), "b")
    write_table(merge_sources(a, b), merged_path)
    clean, seen_clean = counted(clean_listings(spark.read.parquet(merged_path), rules), "clean")
    write_table(clean, clean_path)
    if export_csv:
        write_csv(sorted_by_price(spark.read.parquet(clean_path)), export_csv)
    return {"a": seen_a.get["rows"], "b": seen_b.get["rows"], "clean": seen_clean.get["rows"]}
