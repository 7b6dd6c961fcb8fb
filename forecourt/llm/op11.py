from pyspark.sql import DataFrame, SparkSession

from forecourt.llm.registry import query, table
from forecourt.llm.source_audit import source_divergence

SQL = r"""
WITH given AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
),
words AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM given
),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT lang, source, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, coalesce(lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM given)
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
    LEFT JOIN langs USING (lang)
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + kept)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + kept)::HUGEINT AS lang_p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(v, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // t.p) AS v
        FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
    ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
terms AS (
    SELECT lang, source, term AS item, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT AS value FROM shares WHERE n > 0 AND p > lang_p
)
SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
) WHERE rank <= 200
"""


@query(SQL)
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
