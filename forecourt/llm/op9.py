from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.byte_bpe import encode_and_decode, read_ranks
from forecourt.llm.registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """The ranks and the splitting pattern of a public vocabulary file."""
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    ranks, pattern = vocabulary()
    return encode_and_decode(docs, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"))
