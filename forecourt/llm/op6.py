from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.language_id import held_out, predict_languages, train_language_model
from forecourt.llm.registry import query, table


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents"))
    model = train_language_model(docs.filter(~F.col("held_out")))
    out = predict_languages(docs, model, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
