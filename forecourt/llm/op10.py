from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.pii import detect_pii, train_pii_model
from forecourt.llm.registry import query, table


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect_pii(docs, train_pii_model(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )
