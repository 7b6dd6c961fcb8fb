"""Links, headings and listings out of HTML: the driver's pages, and listing pages made of table rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from forecourt.params import SITE_B, Budget, CleanRules, Site
from forecourt.plans.build import build_clean
from forecourt.plans.collect import collect_a, collect_b
from forecourt.queries import sql
from forecourt.queries.registry import query, table
from forecourt.sources.detail_pages import accepted, extract_a, extract_b
from forecourt.sources.listing_links import distinct_links, page_addresses, page_links
from forecourt.sources.page_fields import Field, Items, Where, page_fields

_BASE = "https://example.net"
# Some seconds of scanning.
PAGES_PER_TASK = 10_000
_HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_ABSOLUTE = f"CASE WHEN starts_with(h, 'http') THEN h ELSE '{_BASE}' || h END"


@query(f"""
SELECT page_id, CAST(i AS INTEGER) AS position, {_ABSOLUTE} AS link
FROM (SELECT page_id, unnest({_HREFS}) AS h, generate_subscripts({_HREFS}, 1) AS i FROM pages)
""")
def links_of_pages(spark, sf_dir):
    """Every link of every page, absolute, with its position."""
    return page_links(table(spark, sf_dir, "pages").select("page_id", "html"), _BASE)


@query(f"SELECT DISTINCT page_id, {_ABSOLUTE} AS link FROM (SELECT page_id, unnest({_HREFS}) AS h FROM pages)")
def distinct_links_of_pages(spark, sf_dir):
    return distinct_links(table(spark, sf_dir, "pages").select("page_id", "html"), _BASE)


def _plain(x: str) -> str:
    # A reference may lack its semicolon where the text is cut.
    entities = {"&lt": "<", "&gt": ">", "&quot": '"', "&amp": "&"}
    for name, char in entities.items():
        x = f"regexp_replace({x}, '{name};?', '{char}', 'g')"
    return sql.trim(x)


@query(rf"""
SELECT page_id, {_plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
       {_plain("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title
FROM pages
""")
def headings_of_pages(spark, sf_dir):
    """Heading and title of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return page_fields(pages, {"heading": Field(Where("h1")), "title": Field(Where("title"))}).select("page_id", "heading", "title")


_ITEMS = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)"


@query(f"""
SELECT page_id, CAST(i AS INTEGER) AS position, {_plain('t')} AS label, {_plain('t')} AS value
FROM (SELECT page_id, unnest({_ITEMS}) AS t, generate_subscripts({_ITEMS}, 1) AS i FROM pages)
""")
def items_of_pages(spark, sf_dir):
    """Label and value of every list item of every page."""
    found = page_fields(table(spark, sf_dir, "pages").select("page_id", "html"), {}, Items(Where("li"), Where("a"), Where("a")))
    return found.select("page_id", F.posexplode("items").alias("at", "item")).select(
        "page_id", (F.col("at") + 1).alias("position"), "item.label", "item.value"
    )


@query("""
SELECT page_id, CAST(n AS INTEGER) AS page,
       CASE WHEN n = 1 THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'strana=' || n END AS address
FROM pages, range(1, 6) AS r(n)
""")
def result_page_addresses(spark, sf_dir):
    """The addresses of five result pages of every page."""
    bases = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"))
    return page_addresses(bases, "strana", 5).drop("base")


# A detail page of source A for every part. Small parts show horsepower only, large ones no engine.
_PAGE_A = """
concat('<html><body><h1>no</h1><div class="x car_detail2__h1"><h1> ', initcap(p_name), ' <b>', p_type, '</b></h1></div><ul>',
  '<li data-toggle="popover"><strong>Rok</strong><span> ', 1975 + p_size, '</span></li>',
  '<li data-toggle="popover"><strong>Stav tachometru</strong><span>', p_partkey, '&nbsp;000 km</span></li>',
  '<li data-toggle="popover"><strong> Palivo </strong><span>', lower(p_type), '</span><span>no</span></li>',
  '<li data-toggle="popover"><strong>P&#345;evodovka</strong><span>', p_brand, ' / ', p_size, '</span></li>',
  '<li><strong>Palivo</strong><span>no</span></li>',
  '<li><strong>Výkon</strong><span>', 20 + p_size, CASE WHEN p_size > 5 THEN ' kW' ELSE ' k' END, '</span></li>',
  CASE WHEN p_size < 45 THEN concat('<li data-toggle="popover"><strong>Motor</strong><span>', p_size, ',5 TDI</span></li>') ELSE '' END,
  '</ul><div class="show-more-price-right-right"><p><strong>', CAST(p_retailprice * 100 AS BIGINT), ' Kč</strong></p></div></body></html>')
"""
_FIELDS_A = """
upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS brand,
upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || p_type AS model,
CASE WHEN p_size < 45 THEN CAST(p_size + 0.5 AS VARCHAR) END AS volume_l,
CAST(1975 + p_size AS VARCHAR) AS year, concat(p_partkey, '000') AS mileage_km,
CAST(CAST(p_retailprice * 100 AS BIGINT) AS VARCHAR) AS price, lower(p_type) AS fuel, p_brand AS transmission,
CASE WHEN p_size > 5 THEN CAST(20 + p_size AS VARCHAR) END AS power_kw
"""
_REASON_A = "CASE WHEN p_size <= 5 THEN 'no power_kw' WHEN p_size >= 45 THEN 'no volume_l' END"


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in as many tasks as their pages need: Spark cuts files by size, and a few MB of rows make GBs of pages."""
    return rows.repartition(max(1, math.ceil(rows.count() / PAGES_PER_TASK)))


def pages_a(part: DataFrame) -> DataFrame:
    return part.select(
        F.expr(f"concat('{_BASE}/auto/', p_partkey)").alias("url"), F.expr(_PAGE_A).alias("html"), "p_partkey"
    )


@query(f"SELECT concat('{_BASE}/auto/', p_partkey) AS url, {_FIELDS_A}, {_REASON_A} AS reject_reason FROM part")
def extract_source_a(spark, sf_dir):
    """Listing, or reason for none, of every detail page of source A."""
    return extract_a(pages_a(_dealt(table(spark, sf_dir, "part"))))


# A detail page of source B for every customer. The poor ones have no readable engine.
_PAGE_B = """
concat('<span class="c-a-basic-info__subtitle-info">Ojeté, ', 1 + c_nationkey, '/', 1990 + c_nationkey, ', <b>', c_custkey, ' km</b></span>',
  CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('<span class="c-basic-info__price">', CAST(abs(c_acctbal) AS BIGINT), ' Kč</span>')
       WHEN c_mktsegment = 'BUILDING' THEN '<div class="c-a-basic-info__price"> Kč</div><span class="c-basic-info__price">5 Kč</span>'
       ELSE concat('<div class="c-a-basic-info__price">', CAST(abs(c_acctbal) AS BIGINT), '&nbsp;Kč</div>') END,
  '<ul><li class="c-car-properties__tile"><div class="c-car-properties__tile-label">Palivo</div><div class="c-car-properties__tile-value">no</div></li>',
  '<li class="c-car-otherProperties__tile"><div class="a tile-label">Palivo</div><div class="a tile-value">', c_mktsegment, '</div></li>',
  '<li class="other"><div class="tile-label">Palivo</div><div class="tile-value">no</div></li>',
  '<li class="c-car-properties__tile"><div class="tile-label">Převodovka</div><div class="tile-value">', c_name, '</div></li>',
  '<li class="c-car-properties__tile"><div class="tile-label">Výkon</div><div class="tile-value">', 40 + c_nationkey, ' kW</div></li>',
  '<li class="c-car-properties__tile"><div class="tile-label">Výkon</div><div class="tile-value">unknown</div></li>',
  '<li class="c-car-properties__tile"><div class="tile-label">Objem</div><div class="tile-value">', 1 + c_nationkey, '&nbsp;250 ccm</div></li>',
  CASE WHEN c_acctbal < 0 THEN '<li class="c-car-properties__tile"><div class="tile-label">Objem</div><div class="tile-value">? ccm</div></li>' ELSE '' END,
  '</ul>')
"""
_PRICE_B = "CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(CAST(trunc(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END"
_FIELDS_B = f"""
upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS brand, concat('Model X', c_nationkey) AS model,
CASE WHEN c_acctbal >= 0 THEN concat(1 + c_nationkey, '250') END AS volume_cm3,
CAST(1990 + c_nationkey AS VARCHAR) AS year, CAST(c_custkey AS VARCHAR) AS mileage_km, {_PRICE_B} AS price,
c_mktsegment AS fuel, c_name AS transmission, CAST(40 + c_nationkey AS VARCHAR) AS power_kw
"""
_URL_B = "concat('https://example.net/detail/', lower(c_mktsegment), '/model-x', c_nationkey, '/', c_custkey)"


def pages_b(customer: DataFrame) -> DataFrame:
    return customer.select(F.expr(_URL_B).alias("url"), F.expr(_PAGE_B).alias("html"))


@query(f"""
SELECT {_URL_B} AS url, {_FIELDS_B},
       CASE WHEN c_acctbal < 0 THEN 'no volume_cm3' WHEN c_mktsegment = 'BUILDING' THEN 'no price' END AS reject_reason
FROM customer
""")
def extract_source_b(spark, sf_dir):
    """Listing, or reason for none, of every detail page of source B."""
    return extract_b(pages_b(_dealt(table(spark, sf_dir, "customer"))))


_BUILD_RULES = CleanRules(
    as_of_year=2026,
    price=(100, 2_500_000),
    volume=(0.5, 30.0),
    brand_prefixes={"blu": "Blé", "re": "RED", "mach": "Mach-1"},
    fuel_rules=((("eco", "machi"), "Benzin"), (("prom", "house"), "Nafta"), (("ium",), "Hybridní")),
    transmission_rules=((("brand#1", "1"), "Manuální"), (("#", "2"), "Automatická")),
    excluded_pair=("RED", "boltpromo"),
    block_list=("mach1", "ringmedium"),
)


@query(sql.cleaned(
    f"""SELECT *, 'Autoesa' AS source FROM (SELECT {_FIELDS_A} FROM part WHERE {_REASON_A} IS NULL)
    UNION ALL
    SELECT brand, model, CAST(round_even(CAST(volume_cm3 AS DOUBLE) / 1000, 1) AS VARCHAR), year, mileage_km,
           price, fuel, transmission, power_kw, 'Sauto'
    FROM (SELECT {_FIELDS_B} FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING')""",
    _BUILD_RULES,
))
def build_from_pages(spark, sf_dir):
    """Detail pages of both sources to the clean table."""
    a = accepted(extract_source_a(spark, sf_dir)).drop("url")
    b = accepted(extract_source_b(spark, sf_dir)).drop("url")
    return build_clean(a, b, _BUILD_RULES)


@query(f"""
WITH listings AS (SELECT {_FIELDS_A}, p_partkey // 20 + 1 AS page FROM part WHERE {_REASON_A} IS NULL),
first_seen AS (SELECT * EXCLUDE (page), min(page) AS page FROM listings GROUP BY ALL),
counts AS (SELECT page, count(*) AS n_new FROM first_seen GROUP BY page),
numbered AS (SELECT range AS page, coalesce(n_new, 0) AS n_new FROM range(1, 1001) LEFT JOIN counts ON page = range),
taken AS (SELECT page FROM (
  SELECT page, sum(n_new) OVER (ORDER BY page) - n_new AS before,
         sum(CAST(n_new = 0 AS INTEGER)) OVER (ORDER BY page) AS gaps FROM numbered)
  WHERE gaps = 0 AND before < 1000)
SELECT * EXCLUDE (page) FROM first_seen WHERE page IN (SELECT page FROM taken)
""")
def collect_source_a(spark, sf_dir):
    """Result pages of 20 links, their detail pages, first listing per key, page budget of 1,000 listings."""
    details = pages_a(table(spark, sf_dir, "part"))
    link = F.expr("concat('<a href=\"/auto/', p_partkey, '\" class=\"car_item new\">x</a>')")
    # Two pages show each listing; the later one adds nothing.
    shown = details.select(link.alias("link"), F.explode(F.expr("array(p_partkey div 20 + 1, p_partkey div 20 + 2)")).alias("page"))
    results = shown.groupBy("page").agg(
        F.concat(F.lit('<a href="/no">x</a>'), F.array_join(F.collect_list("link"), "<br>")).alias("html")
    )
    site = Site(_BASE, "car_item", "stranka")
    return collect_a(results, details.select("url", "html"), Budget(min_rows=1000, max_pages=1000), site)


@query(f"""
WITH listings AS (
  SELECT {_FIELDS_B}, c_custkey // 15 + 1 AS page FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'),
first_seen AS (SELECT * EXCLUDE (page), min(page) AS page FROM listings GROUP BY ALL),
counts AS (SELECT page, count(*) AS n_new FROM first_seen GROUP BY page),
numbered AS (SELECT range AS page, coalesce(n_new, 0) AS n_new FROM range(1, 701) LEFT JOIN counts ON page = range),
taken AS (SELECT page FROM (
  SELECT page, sum(n_new) OVER (ORDER BY page) - n_new AS before,
         sum(CAST(n_new = 0 AS INTEGER)) OVER (ORDER BY page) AS gaps FROM numbered)
  WHERE gaps = 0 AND before < 5000)
SELECT * EXCLUDE (page) FROM first_seen WHERE page IN (SELECT page FROM taken)
""")
def collect_source_b(spark, sf_dir):
    """Result pages of 15 links with the whole class attribute of source B, in waves of 16, 32, ... pages."""
    details = pages_b(table(spark, sf_dir, "customer"))
    number = F.element_at(F.split("url", "/"), -1).cast("int")
    links = F.concat(
        F.lit(f'<a class="{SITE_B.link_class}" href="'), "url", F.lit('">x</a><a class="c-item__link" href="'), "url", F.lit('0">no</a>')
    )
    # Listings of an earlier page are shown again and add nothing.
    shown = details.select(links.alias("link"), F.explode(F.array((number / 15).cast("int") + 1, (number / 15).cast("int") + 3)).alias("page"))
    results = shown.groupBy("page").agg(F.array_join(F.collect_list("link"), "<br>").alias("html"))
    site = Site(_BASE, SITE_B.link_class, SITE_B.page_param)
    return collect_b(results, details, Budget(min_rows=5000, max_pages=700), site, first_wave=16)
