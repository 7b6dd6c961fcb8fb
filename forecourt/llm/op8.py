from pyspark.sql import DataFrame, SparkSession

from forecourt.llm.jaccard_join import ngram_jaccard_groups
from forecourt.llm.registry import query, table


@query()
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"))
