"""Domains and counts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.operators import lookups
from forecourt.queries.registry import query, table
from forecourt.schema import CLEAN_SCHEMA
from forecourt.session import scratch_path
from forecourt.sources.tables import missing_sources, read_clean_or_empty, require_sources, write_table


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def domain_values(spark, sf_dir):
    """Sorted distinct values of one column."""
    return lookups.domain(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT DISTINCT p_brand, p_name, p_size FROM part")
def domain_paths(spark, sf_dir):
    """Brand, its models and their sizes as one sorted table that lookups filter."""
    return lookups.domain(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_size")


@query("""
SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS models
FROM part GROUP BY p_brand
""")
def domain_by_brand(spark, sf_dir):
    """Brand to its sorted distinct models."""
    lists = lookups.domain_whole(table(spark, sf_dir, "part"), ["p_brand"], "p_name")
    return lists.select("p_brand", F.array_join("values", "|").alias("models"))


@query("""
SELECT p_brand, p_name, array_to_string(list_transform(list_sort(list(DISTINCT p_size / 10)), lambda x: CAST(x AS VARCHAR)), '|') AS volumes
FROM part GROUP BY p_brand, p_name
""")
def domain_by_two(spark, sf_dir):
    """(Brand, model) to its sorted distinct volumes, as texts."""
    part = table(spark, sf_dir, "part").withColumn("volume", F.col("p_size") / 10)
    lists = lookups.domain_whole(part, ["p_brand", "p_name"], "volume")
    return lists.select("p_brand", "p_name", F.array_join(lookups.labels(F.col("values")), "|").alias("volumes"))


@query("SELECT DISTINCT p_size FROM part WHERE p_brand = 'Brand#12' AND p_type = 'PROMO'")
def lookup_two_keys(spark, sf_dir):
    """The sizes of one brand and type."""
    part = lookups.lookup(table(spark, sf_dir, "part"), p_brand="Brand#12", p_type="PROMO")
    return lookups.domain(part, "p_size")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 20")
def top_values(spark, sf_dir):
    return lookups.top_values(table(spark, sf_dir, "part"), "p_name")


_PRICE = """
CASE WHEN o_orderstatus = 'P' THEN 'Cena na dotaz' WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '250000'
     ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS {0}) END
"""


@query(f"""
SELECT o_orderkey, price, row_number() OVER (ORDER BY TRY_CAST(price AS DOUBLE) NULLS LAST, o_orderkey) AS position
FROM (SELECT o_orderkey, {_PRICE.format("VARCHAR")} AS price FROM orders)
""")
def exported_by_price(spark, sf_dir):
    """Orders with text prices as part files in price order; a third has one price, some have none."""
    path = scratch_path(spark, "by-price")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PRICE.format("STRING")).alias("price"))
    lookups.export_by_price(orders, path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("""
SELECT 'stored' AS kind, CAST(p_size AS DOUBLE) AS volume_l, count(*) AS n FROM part GROUP BY p_size
""")
def clean_or_empty(spark, sf_dir):
    """Listings by volume of a stored table, of one without brands and of one that is not there: the last two are empty."""
    part = table(spark, sf_dir, "part").select("p_name", "p_size")
    known = {"brand": F.col("p_name"), "volume_l": F.col("p_size")}
    clean = part.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CLEAN_SCHEMA])
    paths = {kind: scratch_path(spark, "clean") for kind in ("stored", "no brand", "absent")}
    write_table(clean, paths["stored"])
    write_table(clean.drop("brand"), paths["no brand"])
    found = [read_clean_or_empty(spark, path).withColumn("kind", F.lit(kind)) for kind, path in paths.items()]
    whole = found[0].unionByName(found[1]).unionByName(found[2])
    return whole.groupBy("kind", "volume_l").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'customer' AS source, true AS present, (SELECT count(*) FROM customer) AS n UNION ALL
SELECT 'supplier', true, (SELECT count(*) FROM supplier) UNION ALL SELECT 'dealer', false, 0
""")
def required_sources(spark, sf_dir):
    """Which of three sources are there; the rows of those that are, read only as none of them is missing."""
    paths = {name: f"{sf_dir}/{name}.parquet" for name in ("customer", "supplier", "dealer")}
    missing = set(missing_sources(spark, *paths.values()))
    there = [name for name, path in paths.items() if path not in missing]
    tables = require_sources(spark, *[paths[name] for name in there])
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.lit(True).alias("present"), "n") for name, df in zip(there, tables, strict=True)]
    none = [spark.range(1).select(F.lit(name).alias("source"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("n")) for name in paths if name not in there]
    out, *more = [*counts, *none]
    for one in more:
        out = out.unionByName(one)
    return out
