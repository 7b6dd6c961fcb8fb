"""The audit of scored requests: what was asked, what the model saw, what it said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from forecourt.operators.append import BATCH, WRITER, batch_folder


def write_audit(scored: DataFrame, target: str, batch_id: int, writer: str) -> None:
    """Keep all rows of a scored batch: also requests that failed, were refused or came twice.

    Every batch of a writer is a folder of its own, written by overwriting that folder alone, so a
    batch that runs again replaces its rows and no other's.
    """
    scored.write.mode("overwrite").parquet(batch_folder(target, batch_id, writer))


def read_audit(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All audited rows with their batch_id and writer."""
    whole = T.StructType([*schema, T.StructField(BATCH, T.LongType()), T.StructField(WRITER, T.StringType())])
    return spark.read.schema(whole).parquet(target)
