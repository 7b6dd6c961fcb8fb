"""Reading and writing tables at the edges of the jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from forecourt.schema import CLEAN_SCHEMA, HEADERS, NULL_TOKENS


def null_tokens_to_null(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Make the texts that stand for a missing value null, in every text column."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns
    ])


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV export as all-text columns under their ASCII names; a missing path fails.

    So does a file whose header names other columns, or the same ones in another order.

    Quoted line breaks need `multi_line`, which reads each file in one task. Turn it off to split
    large files that hold none.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    named = raw.select(*[F.col(f"`{c}`").alias(HEADERS.get(c, c)) for c in raw.columns])
    return null_tokens_to_null(named)


def write_csv(df: DataFrame, path: str) -> None:
    """Export as CSV part files with the original headers."""
    original = {v: k for k, v in HEADERS.items()}
    (
        df.select(*[F.col(c).alias(original.get(c, c)) for c in df.columns])
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """None if there is no table at the path yet; every other fault fails."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def missing_sources(spark: SparkSession, *paths: str) -> list[str]:
    """The paths at which there is no table."""
    return [path for path in paths if read_table_or_none(spark, path) is None]


def require_sources(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """The tables at all paths; fails before any work, naming every path that has none."""
    if missing := missing_sources(spark, *paths):
        raise FileNotFoundError(f"no table at {', '.join(missing)}")
    return [read_table(spark, path) for path in paths]


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_clean_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The clean table, or an empty one if it is absent or has no brand column."""
    table = read_table_or_none(spark, path)
    if table is None or "brand" not in table.columns:
        return spark.createDataFrame([], CLEAN_SCHEMA)
    return table
