from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.registry import query, table
from forecourt.llm.substring_dedup import dedup_substrings


@query()
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
