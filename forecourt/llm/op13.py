from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.byte_cnn import held_out_of, score_quality, train_quality_model
from forecourt.llm.registry import query, table


@query()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = held_out_of(table(spark, sf_dir, "labels")).filter(~F.col("held_out"))
    return score_quality(held_out_of(docs), train_quality_model(docs, labels), ("doc_id", "held_out"))
