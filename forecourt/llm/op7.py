from pyspark.sql import DataFrame, SparkSession

from forecourt.llm.lattice_dedup import near_vectors
from forecourt.llm.registry import query, table


@query()
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
