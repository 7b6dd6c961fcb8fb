from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.decontamination import find_leaks
from forecourt.llm.registry import query, table


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("best_share"),
    )
