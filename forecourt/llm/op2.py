from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.llm.line_dedup import dedup_chunks
from forecourt.llm.registry import query, table

SQL = r"""
WITH split AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
    FROM documents WHERE text IS NOT NULL
),
hashed AS (SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM split),
rolled AS (
    SELECT doc_id, i, line,
        xor(xor(h, coalesce(lag(h, 1) OVER w, 0) << 1), coalesce(lag(h, 2) OVER w, 0) << 2) AS r
    FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
    SELECT doc_id, i, line,
        coalesce(sum(CASE WHEN ((r >> 8) & 3) = 0 THEN 1 ELSE 0 END) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
    FROM rolled
),
chunks AS (
    SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, k
),
judged AS (
    SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM chunks
),
done AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed,
        coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


@query(SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
