"""Cleaning, merging, distinct and append on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from forecourt.functions.fields import words
from forecourt.functions.numbers import litres, strict_number, to_number
from forecourt.operators import distinct, filters
from forecourt.operators.append import append_new
from forecourt.operators.columns import age, evaluate_once, with_source
from forecourt.operators.lookups import preview
from forecourt.operators.page_budget import pages_taken
from forecourt.params import CleanRules
from forecourt.plans.build import build_clean, counted, merge_sources
from forecourt.plans.clean import clean_listings
from forecourt.queries import sql
from forecourt.queries.registry import query, table
from forecourt.sources.selection import select_listings, select_or_drop_brand, select_or_drop_range
from forecourt.sources.tables import null_tokens_to_null, read_csv, write_csv
from forecourt.session import scratch_path
from forecourt.streaming.append_stream import append_stream

# Order lines as listings: the parts sold are the cars.
SALES_RULES = CleanRules(
    as_of_year=2026,
    brand_prefixes={"econ": "ECONOMY", "stand": "Stándard", "sma": "Small Car", "lar": "Lárge"},
    fuel_rules=((("urgent", "high"), "Benzin"), (("medium",), "Nafta"), (("not",), "Hybridni")),
    transmission_rules=((("af", "rf"), "Manuální"), (("ao", "no"), "Automatická")),
    excluded_pair=("ECONOMY", "redwidget"),
    block_list=("bluebolt", "promo"),
)
# Texts as listings, in two sources with different columns.
TEXT_RULES = CleanRules(
    as_of_year=2026,
    price=(100, 20_000),
    power=(20, 800),
    brand_prefixes={"the": "Thé", "th": "TH", "éea": "never", "eau": "Eau-X", "in": "Inn", "en": "En"},
    fuel_rules=((("que", "sch"), "Benzín"), (("ing", "tion"), "Nafta"), (("ción",), "Hybridní")),
    transmission_rules=((("en", "user"), "Manuální"), (("fr", "assist"), "Automatická")),
    excluded_pair=("TH", "and"),
    block_list=("of", "in"),
)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines as merged raw listings."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("p_type").alias("brand"),
        F.col("p_name").alias("model"),
        (F.col("p_size") / 10).cast("string").alias("volume_l"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.col("o_custkey").cast("string").alias("mileage_km"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("fuel"),
        F.concat("l_returnflag", "l_linestatus").alias("transmission"),
        F.col("l_quantity").cast("int").cast("string").alias("power_kw"),
        F.col("o_orderstatus").alias("source"),
    )


SALES_SQL = """
SELECT p_type AS brand, p_name AS model, CAST(p_size / 10 AS VARCHAR) AS volume_l,
       CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(o_custkey AS VARCHAR) AS mileage_km,
       CAST(l_extendedprice AS VARCHAR) AS price, o_orderpriority AS fuel,
       l_returnflag || l_linestatus AS transmission, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS power_kw,
       o_orderstatus AS source
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
"""


def _with_words(df: DataFrame) -> DataFrame:
    split = evaluate_once(df, {"w": words(F.col("text"))})
    return evaluate_once(split, {
        "n_words": F.size("w"),
        "n_distinct": F.size(F.array_distinct("w")),
        "n_lines": F.size(F.split("text", "\n")),
        "brand": F.get("w", F.lit(0)),
        "model": F.get("w", F.lit(1)),
    })


def texts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as raw listings of source A."""
    return _with_words(table(spark, sf_dir, "documents")).select(
        "brand",
        "model",
        F.bround(F.col("n_chars") / F.col("n_words"), 1).cast("string").alias("volume_l"),
        (2026 - F.col("n_lines")).cast("string").alias("year"),
        F.col("n_words").cast("string").alias("mileage_km"),
        F.col("n_chars").cast("string").alias("price"),
        F.col("text").alias("fuel"),
        F.col("lang").alias("transmission"),
        F.col("n_distinct").cast("string").alias("power_kw"),
    )


def texts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns as raw listings of source B."""
    return _with_words(table(spark, sf_dir, "conversations")).select(
        "brand",
        "model",
        F.floor(1000 * F.length("text") / F.col("n_words")).cast("string").alias("volume_cm3"),
        (2026 - F.col("turn")).cast("string").alias("year"),
        F.col("conv_id").cast("string").alias("mileage_km"),
        F.length("text").cast("string").alias("price"),
        F.col("text").alias("fuel"),
        F.col("role").alias("transmission"),
        F.col("n_distinct").cast("string").alias("power_kw"),
    )


TEXTS_SQL = f"""
SELECT w[1] AS brand, w[2] AS model, CAST(round_even(n_chars / len(w), 1) AS VARCHAR) AS volume_l,
       CAST(2026 - len(string_split(text, chr(10))) AS VARCHAR) AS year, CAST(len(w) AS VARCHAR) AS mileage_km,
       CAST(n_chars AS VARCHAR) AS price, text AS fuel, lang AS transmission,
       CAST(len(list_distinct(w)) AS VARCHAR) AS power_kw, 'Autoesa' AS source
FROM (SELECT *, {sql.words('text')} AS w FROM documents)
UNION ALL
SELECT w[1], w[2], CAST(round_even(CAST(floor(1000 * length(text) / len(w)) AS DOUBLE) / 1000, 1) AS VARCHAR),
       CAST(2026 - turn AS VARCHAR), CAST(conv_id AS VARCHAR), CAST(length(text) AS VARCHAR), text, role,
       CAST(len(list_distinct(w)) AS VARCHAR), 'Sauto'
FROM (SELECT *, {sql.words('text')} AS w FROM conversations)
"""


@query(sql.cleaned(SALES_SQL, SALES_RULES))
def clean_sales(spark, sf_dir):
    """All cleaning steps over all order lines."""
    return clean_listings(sales(spark, sf_dir), SALES_RULES)


@query(f"SELECT DISTINCT * FROM ({sql.cleaned(SALES_SQL, SALES_RULES)})")
def clean_sales_distinct(spark, sf_dir):
    """Cleaning with a second distinct over the clean rows."""
    rules = CleanRules(**{**SALES_RULES.__dict__, "dedup_after": True})
    return clean_listings(sales(spark, sf_dir), rules)


@query(sql.cleaned(TEXTS_SQL, TEXT_RULES))
def clean_texts(spark, sf_dir):
    """Two sources with different columns: conversion, union, cleaning, over whole texts."""
    return build_clean(texts_a(spark, sf_dir), texts_b(spark, sf_dir), TEXT_RULES)


@query(TEXTS_SQL)
def merge_texts(spark, sf_dir):
    """Conversion of the second source and union with provenance."""
    return merge_sources(texts_a(spark, sf_dir), texts_b(spark, sf_dir))


def _partners(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal AS balance", "s_name AS name", "s_nationkey AS nation"
    )
    return customers, suppliers


PARTNERS_SQL = """
SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source
FROM customer
UNION ALL
SELECT s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier
"""


def _tagged_partners(spark, sf_dir):
    customers, suppliers = _partners(spark, sf_dir)
    return distinct.union_tables(with_source(customers, "customer"), with_source(suppliers, "supplier"))


@query(PARTNERS_SQL)
def merge_by_name(spark, sf_dir):
    """Union of two sources with a constant column; a column only one has is null for the other."""
    return _tagged_partners(spark, sf_dir)


@query(f"SELECT * FROM ({PARTNERS_SQL}) ORDER BY balance NULLS LAST, name LIMIT 5")
def sorted_preview(spark, sf_dir):
    """The first five rows by value, missing values last."""
    return preview(_tagged_partners(spark, sf_dir), [F.col("balance").asc_nulls_last(), "name"])


@query("SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION SELECT s_nationkey, s_acctbal FROM supplier")
def union_then_distinct(spark, sf_dir):
    customers, suppliers = _partners(spark, sf_dir)
    return distinct.union_distinct(customers.select("nation", "balance"), suppliers.select("nation", "balance"))


@query("""
SELECT 'first' AS step, (SELECT count(*) FROM customer) AS n UNION ALL
SELECT 'second', (SELECT count(*) FROM supplier) UNION ALL
SELECT 'merged', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL
SELECT 'distinct', (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_acctbal FROM customer
                    UNION SELECT s_nationkey, s_acctbal FROM supplier))
""")
def step_counts(spark, sf_dir):
    """Row counts of every step, counted by the one run that makes the result."""
    customers, suppliers = _partners(spark, sf_dir)
    first, seen_first = counted(customers, "first")
    second, seen_second = counted(suppliers, "second")
    merged, seen_merged = counted(first.select("nation", "balance").unionByName(second.select("nation", "balance")), "merged")
    last, seen_last = counted(distinct.distinct_rows(merged), "distinct")
    last.write.format("noop").mode("overwrite").save()
    steps = {"first": seen_first, "second": seen_second, "merged": seen_merged, "distinct": seen_last}
    return spark.createDataFrame([(k, v.get["rows"]) for k, v in steps.items()], "step string, n bigint")


@query("SELECT o_orderkey, CAST(round_even(o_totalprice / 1000, 1) AS DOUBLE) AS thousands FROM orders")
def convert_units(spark, sf_dir):
    """Strict number out of text, divided by 1000, one decimal, halves to even."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", litres(strict_number(F.col("o_totalprice").cast("string"))).alias("thousands")
    )


_NUMBER_TEXTS = {
    "plain": "CAST(user_id AS {text})",
    "spaced": "concat('  ', CAST(user_id AS {text}), '.5 ')",
    "exponent": "concat(CAST(user_id AS {text}), 'e2')",
    "suffix": "concat(CAST(user_id AS {text}), 'd')",
    "underscore": "concat('1_', CAST(user_id AS {text}))",
    "signed": "concat('-.', CAST(user_id AS {text}))",
    "comma": "concat('1,', CAST(user_id AS {text}))",
    "word": "event_type",
    "json": "props",
}


@query(
    "SELECT event_id, "
    + ", ".join(f"{sql.number(e.format(text='VARCHAR'))} AS {name}" for name, e in _NUMBER_TEXTS.items())
    + " FROM events"
)
def coerce_numbers(spark, sf_dir):
    """Numbers out of texts of many forms; what is no number becomes null."""
    return table(spark, sf_dir, "events").select(
        "event_id", *[to_number(F.expr(e.format(text="STRING"))).alias(n) for n, e in _NUMBER_TEXTS.items()]
    )


@query("""
SELECT p_partkey, nullif(p_type, 'PROMO') AS p_type,
       CASE WHEN p_name NOT IN ('red widget', 'PROMO') THEN p_name END AS p_name, p_size FROM part
""")
def null_tokens(spark, sf_dir):
    """Texts that stand for a missing value become null; numbers are left alone."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    return null_tokens_to_null(part, ("PROMO", "red widget"))


_TOKENS_SQL = """('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN text NOT IN {_TOKENS_SQL} THEN text END AS text, lang, source,
       CAST(n_chars AS VARCHAR) AS price
FROM documents
""")
def csv_round_trip(spark, sf_dir):
    """All documents, line breaks and quotes included, to CSV part files and back as text."""
    path = scratch_path(spark, "csv")
    documents = table(spark, sf_dir, "documents")
    write_csv(documents.select("doc_id", "text", "lang", "source", F.col("n_chars").alias("price")), path)
    return read_csv(spark, path)


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_extendedprice BETWEEN 30000 AND 2500000 AND year(l_shipdate) BETWEEN 1970 AND 2000
  AND l_quantity BETWEEN 20 AND 800 AND l_discount <= 0.05
""")
def range_filters(spark, sf_dir):
    """Closed ranges and a bound on one side; all of it reaches the scan but the year."""
    lines = table(spark, sf_dir, "lineitem")
    kept = lines.filter(
        filters.in_range(F.col("l_extendedprice"), (30_000, 2_500_000))
        & filters.in_range(F.year("l_shipdate"), (1970, 2000))
        & filters.in_range(F.col("l_quantity"), (20, 800))
        & (F.col("l_discount") <= 0.05)
    )
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT o_orderkey, CAST(2026 - year(o_orderdate) AS INTEGER) AS age FROM orders")
def derived_age(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", age(F.year("o_orderdate"), 2026).alias("age"))


@query("SELECT * FROM part WHERE NOT (p_brand = 'Brand#12' AND lower(p_type) = 'promo')")
def exclude_pairs(spark, sf_dir):
    return filters.exclude_pair(table(spark, sf_dir, "part"), "p_brand", "p_type", ("Brand#12", "promo"))


@query("""
SELECT * FROM (SELECT name, nation, segment, source FROM (SELECT *, lower(segment) AS s, lower(source) AS o
               FROM (PARTNERS)))
WHERE coalesce(lower(segment), '') NOT IN ('machinery', 'household')
""".replace("PARTNERS", PARTNERS_SQL))
def block_list(spark, sf_dir):
    """Listed words in any letter case drop a row; nulls stay."""
    partners = _tagged_partners(spark, sf_dir).select("name", "nation", "segment", "source")
    return filters.block(partners, ["segment", "source"], ("machinery", "household"))


@query(f"SELECT name, segment FROM ({PARTNERS_SQL}) WHERE segment IS NOT NULL AND segment <> 'BUILDING'")
def sentinel_filter(spark, sf_dir):
    """A field that is missing, or says it is, drops the row."""
    partners = _tagged_partners(spark, sf_dir).select("name", "segment")
    return filters.drop_not_found(partners, ["name", "segment"], "BUILDING")


@query(f"SELECT name, segment FROM ({PARTNERS_SQL}) WHERE segment IS NOT NULL AND segment <> 'FURNITURE'")
def mandatory_values(spark, sf_dir):
    """Empty rows go, then rows that lack a mandatory value."""
    partners = _tagged_partners(spark, sf_dir).select("name", F.nullif("segment", F.lit("FURNITURE")).alias("segment"))
    return filters.require(filters.drop_empty_rows(partners), ["segment"])


@query("SELECT DISTINCT text, lang, source, n_chars FROM documents")
def distinct_listings(spark, sf_dir):
    """Full-row distinct over whole texts."""
    return distinct.distinct_rows(table(spark, sf_dir, "documents").drop("doc_id"))


@query("""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS r FROM documents)
WHERE r = 1
""")
def first_listing_of_key(spark, sf_dir):
    """The first document of every key."""
    return distinct.first_by_key(table(spark, sf_dir, "documents"), ["text", "lang"], ["doc_id"])


def _stored_and_arriving(spark, sf_dir):
    """Stored are the labelled documents; all documents arrive."""
    documents = table(spark, sf_dir, "documents")
    stored = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return stored.drop("doc_id"), documents.drop("doc_id")


@query("""
SELECT DISTINCT text, lang, source, n_chars FROM documents
EXCEPT
SELECT text, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def new_listings(spark, sf_dir):
    """Distinct arriving rows that the stored table lacks."""
    stored, arriving = _stored_and_arriving(spark, sf_dir)
    return distinct.new_rows(arriving, stored, arriving.columns)


@query("""
WITH stored AS (SELECT DISTINCT text, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
     arriving AS (SELECT DISTINCT text, lang, source, n_chars FROM documents)
SELECT 0 AS batch_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM stored
UNION ALL
SELECT 1, count(*), CAST(sum(n_chars) AS BIGINT) FROM (SELECT * FROM arriving EXCEPT SELECT * FROM stored)
""")
def incremental_append(spark, sf_dir):
    """Rows added by each run of the append: first run, second run, second run repeated."""
    stored, arriving = _stored_and_arriving(spark, sf_dir)
    target = scratch_path(spark, "append")
    append_new(stored, target, stored.columns, 0, "batches")
    append_new(arriving, target, stored.columns, 1, "batches")
    append_new(arriving, target, stored.columns, 1, "batches")
    append_new(arriving, target, stored.columns, 2, "batches")
    return spark.read.parquet(target).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query("SELECT text, lang AS kind FROM documents UNION SELECT text, role FROM conversations")
def streamed_append(spark, sf_dir):
    """Documents and conversations as two streams into one table; the first runs again and adds nothing."""
    target = scratch_path(spark, "stream")
    offsets = {name: scratch_path(spark, f"offsets-{name}") for name in ("documents", "conversations")}
    for name, kind in (("documents", "lang"), ("conversations", "role"), ("documents", "lang")):
        # A stream's plain path must be a folder; a pattern finds the table as a file too.
        stream = (
            spark.readStream.schema(table(spark, sf_dir, name).schema)
            .parquet(f"{sf_dir}/{name}.parque[t]")
            .select("text", F.col(kind).alias("kind"))
        )
        append_stream(stream, target, stream.columns, offsets[name]).awaitTermination()
    return spark.read.parquet(target).select("text", "kind")


@query("""
WITH first_seen AS (SELECT event_type, user_id, min(event_id // 100 + 1) AS page FROM events GROUP BY ALL),
counts AS (SELECT page, count(*) AS n_new FROM first_seen GROUP BY page),
numbered AS (SELECT range AS page, coalesce(n_new, 0) AS n_new FROM range(1, 2001) LEFT JOIN counts ON page = range),
running AS (SELECT page, n_new, sum(n_new) OVER (ORDER BY page) - n_new AS before,
                   sum(CAST(n_new = 0 AS INTEGER)) OVER (ORDER BY page) AS gaps FROM numbered)
SELECT page, n_new, CAST(before + n_new AS BIGINT) AS total FROM running WHERE gaps = 0 AND before < 1500
""")
def page_budget(spark, sf_dir):
    """Events as result pages of 100: pages until nothing is new or 1,500 (type, user) pairs are found."""
    events = table(spark, sf_dir, "events").withColumn("page", F.expr("event_id div 100 + 1"))
    first_seen = distinct.first_by_key(events, ["event_type", "user_id"], ["event_id"])
    return pages_taken(first_seen, min_rows=1500, max_pages=2000)


@query("SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_retailprice BETWEEN 905 AND 2000")
def select_brand_and_range(spark, sf_dir):
    return select_listings(table(spark, sf_dir, "part"), "Brand#12", 905, 2000, "p_brand", "p_retailprice")


_FITS = "EXISTS (SELECT 1 FROM part WHERE p_brand = '{0}' AND p_retailprice BETWEEN {1} AND {2})"


def _fallback(spark, sf_dir, select):
    """The same request for a brand that exists, one that does not, and a range without hits."""
    part = table(spark, sf_dir, "part")
    cases = [("hit", "Brand#12", 905, 2000), ("no brand", "Brand#99", 905, 2000), ("no price", "Brand#12", 5, 6)]
    found = [
        select(part, brand, low, high, "p_brand", "p_retailprice").withColumn("request", F.lit(name))
        for name, brand, low, high in cases
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(" UNION ALL ".join(
    f"SELECT *, '{name}' AS request FROM part WHERE p_retailprice BETWEEN {low} AND {high} "
    f"AND (p_brand = '{brand}' OR NOT {_FITS.format(brand, low, high)})"
    for name, brand, low, high in (
        ("hit", "Brand#12", 905, 2000), ("no brand", "Brand#99", 905, 2000), ("no price", "Brand#12", 5, 6))
))
def select_dropping_brand(spark, sf_dir):
    """Without a hit, the price range alone decides."""
    return _fallback(spark, sf_dir, select_or_drop_brand)


@query(" UNION ALL ".join(
    f"SELECT *, '{name}' AS request FROM part WHERE p_brand = '{brand}' "
    f"AND (p_retailprice BETWEEN {low} AND {high} OR NOT {_FITS.format(brand, low, high)})"
    for name, brand, low, high in (
        ("hit", "Brand#12", 905, 2000), ("no brand", "Brand#99", 905, 2000), ("no price", "Brand#12", 5, 6))
))
def select_dropping_range(spark, sf_dir):
    """Without a hit, the brand alone decides."""
    return _fallback(spark, sf_dir, select_or_drop_range)
