"""A bounded sample of rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded_sample(docs: DataFrame, columns: list[str], rows: int, longest: int, seed: int = 7) -> list:
    """About `rows` rows at most `longest` characters of text each, chosen by a hash of doc_id.

    Only hashes are sorted; then the rows below the threshold come to the driver, at most
    rows * longest characters.
    """
    able = docs.filter((F.length("text") <= longest) & F.col("doc_id").isNotNull()).withColumn(
        "_draw", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    )
    ends = able.select("_draw").orderBy("_draw").limit(rows).agg(F.max("_draw")).first()
    if ends[0] is None:
        return []
    chosen = able.filter(F.col("_draw") <= F.lit(ends[0])).select(*columns, "_draw").limit(rows).collect()
    return sorted(chosen, key=lambda r: (r["_draw"], r["doc_id"]))
