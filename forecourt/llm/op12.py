from pyspark.sql import DataFrame, SparkSession

from forecourt.llm.registry import query, table
from forecourt.llm.token_alignment import align_tokens

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_files(path_a: str | None = None, path_b: str | None = None) -> tuple[bytes, bytes]:
    """Both public tokenizer files, read once on the driver; they have a few MB at most."""
    import public_tokenizers

    out = []
    for path in (path_a or public_tokenizers.path(FILE_A), path_b or public_tokenizers.path(FILE_B)):
        with open(path, "rb") as file:
            out.append(file.read())
    return out[0], out[1]


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), *tokenizer_files())
