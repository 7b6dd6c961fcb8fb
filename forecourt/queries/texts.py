"""Text functions over whole texts of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import fields, numbers, text
from forecourt.params import BRAND_PREFIXES, FUEL_RULES, TRANSMISSION_RULES
from forecourt.queries import sql
from forecourt.queries.registry import query, table

_PREFIXES = {"the ": "never", "th": "Thé", "é": "E", "eau": "Eau-X", "an": "Än", "en": "En"}
_PART_RULES = ((("tion", "sch"), "A"), (("eau",), "B"), (("ción", "ing"), "C"))


@query(f"SELECT doc_id, {sql.fold('text')} AS folded FROM documents")
def accents_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("folded"))


# A syllable of Hangul by doc_id, a letter of another plane, a ligature of 18 letters, and the text.
_SCRIPTS = "concat(decode(unhex(hex(44032 + doc_id % 11172)), 'UTF-16BE'), '\U0001d49c\ufdfa ', text)"


@query(f"""
SELECT doc_id, concat(chr(CAST(4352 + s // 588 AS INTEGER)), chr(CAST(4449 + s % 588 // 28 AS INTEGER)),
    CASE WHEN s % 28 > 0 THEN chr(CAST(4519 + s % 28 AS INTEGER)) ELSE '' END,
    'A\u0635\u0644\u0649 \u0627\u0644\u0644\u0647 \u0639\u0644\u064a\u0647 \u0648\u0633\u0644\u0645 ', {sql.fold('text')}) AS folded
FROM (SELECT doc_id, text, doc_id % 11172 AS s FROM documents)
""")
def accents_stripped_any_script(spark, sf_dir):
    """Whole texts behind letters of other scripts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.expr(_SCRIPTS)).alias("folded"))


@query(f"SELECT doc_id, {sql.squeeze('text')} AS squeezed, replace(text, '-', '') AS unhyphened FROM documents")
def hyphens_dropped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.drop_hyphens_spaces(F.col("text")).alias("squeezed"),
        text.drop_hyphens(F.col("text")).alias("unhyphened"),
    )


@query(f"SELECT doc_id, {sql.title('text')} AS titled FROM documents")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.title_case(F.col("text")).alias("titled"))


@query(f"SELECT doc_id, {sql.normalised('text')} AS normalised FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise_text(F.col("text")).alias("normalised"))


@query(f"""
SELECT doc_id, {sql.canonical('text', _PREFIXES)} AS name, {sql.canonical('text', BRAND_PREFIXES)} AS brand
FROM documents
""")
def canonical_names(spark, sf_dir):
    """The name of the first matching prefix, else the whole text in title case."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.canonical_name(F.col("text"), _PREFIXES).alias("name"),
        text.canonical_name(F.col("text"), BRAND_PREFIXES).alias("brand"),
    )


_LOWER = f"lower({sql.trim('text')})"


@query(f"""
SELECT doc_id, {sql.keyword(_LOWER, _PART_RULES)} AS part, {sql.keyword(_LOWER, FUEL_RULES)} AS fuel,
       {sql.keyword(sql.fold(_LOWER), TRANSMISSION_RULES)} AS transmission
FROM documents
""")
def keyword_classes(spark, sf_dir):
    """Ordered rules on the parts a whole text contains."""
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.fuel_class(whole, _PART_RULES).alias("part"),
        text.fuel_class(whole, FUEL_RULES).alias("fuel"),
        text.transmission_class(whole, TRANSMISSION_RULES).alias("transmission"),
    )


@query(rf"""
SELECT doc_id, {sql.digits('text')} AS digits,
       CAST(nullif(replace(regexp_extract(text, '(\d+(?:[.,]\d+)?)', 1), ',', '.'), '') AS DOUBLE) AS engine,
       nullif(regexp_extract(concat(n_chars, chr(160), 'kW ', text), '(\d+)[\s\x{{a0}}]*kW', 1), '') AS power,
       nullif(regexp_replace(
         regexp_extract(replace(concat(text, n_chars, chr(160), 'ccm'), chr(160), ' '), '(\d[\d\s]*)\s*ccm', 1),
         '\s+', '', 'g'), '') AS cm3
FROM documents
""")
def number_fields(spark, sf_dir):
    """Digits, first number, and numbers in front of a unit, in whole texts."""
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        numbers.digits_only(whole).alias("digits"),
        fields.engine_litres(whole).cast("double").alias("engine"),
        fields.power_kw(F.concat("n_chars", F.lit("\xa0kW "), whole)).alias("power"),
        fields.engine_cm3(F.concat(whole, "n_chars", F.lit("\xa0ccm"))).alias("cm3"),
    )


@query(f"""
SELECT doc_id, CASE WHEN len(w) < 2 THEN text ELSE w[1] END AS first_word, w[2] AS second_word,
       {sql.trim("split_part(text, '/', 1)")} AS before_slash
FROM (SELECT doc_id, text, {sql.words('text')} AS w FROM documents)
""")
def title_fields(spark, sf_dir):
    """First and second word, and the text in front of a slash."""
    whole = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        fields.title_brand(whole).alias("first_word"),
        fields.title_model(whole).alias("second_word"),
        fields.before_slash(whole).alias("before_slash"),
    )


def _url_part(at: int) -> str:
    parts = "string_split(string_split(url, '.example.')[2], '/')"
    return f"CASE WHEN len({parts}) >= 2 THEN {sql.title(f'replace({parts}[{at}], chr(45), chr(32))')} END"


@query(f"SELECT page_id, {_url_part(1)} AS brand, {_url_part(2)} AS model FROM pages")
def url_fields(spark, sf_dir):
    """The two path parts behind a marker in an address, in title case."""
    url = F.replace(F.col("url"), F.lit(".example."), F.lit("/detail/"))
    return table(spark, sf_dir, "pages").select(
        "page_id", fields.url_brand(url).alias("brand"), fields.url_model(url).alias("model")
    )


# A subtitle in one of three layouts, after the order's status.
_SUBTITLE = """
CASE o_orderstatus
  WHEN 'F' THEN concat('Ojeté, ', month(o_orderdate), '/', year(o_orderdate), ', ', o_custkey, ' km')
  WHEN 'O' THEN concat('Nové,', year(o_orderdate), ' , ', o_custkey, ' 000 KM, 7 km')
  ELSE concat(o_custkey, ' km/h, 5/', year(o_orderdate) + 26, ', ', year(o_orderdate), ', 1/2 km')
END
"""


@query("""
SELECT o_orderkey,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(year(o_orderdate) AS VARCHAR)
            WHEN year(o_orderdate) + 26 < 2025 THEN CAST(year(o_orderdate) + 26 AS VARCHAR)
            ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
       CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) WHEN 'O' THEN concat(o_custkey, '000')
            ELSE '12' END AS mileage_km
FROM orders
""")
def subtitle_fields(spark, sf_dir):
    """Year and mileage out of comma lists in several layouts."""
    sub = fields.subtitle_fields(F.expr(_SUBTITLE), ("Ojeté", "Nové"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sub.alias("sub")).select("o_orderkey", "sub.*")


@query("""
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
            WHEN c_acctbal < 0 THEN 'Cenanadotaz'
            ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS price
FROM customer
""")
def price_texts(spark, sf_dir):
    """Price texts of two places: the second counts only where the first is missing, not where it is empty."""
    amount = F.concat(F.translate(F.format_number(F.floor("c_acctbal"), 0), ",", "\xa0"), F.lit(" Kč"))
    shown = F.when(F.col("c_acctbal") < 0, "Cena na dotaz").otherwise(amount)
    first = F.when(F.col("c_mktsegment") == "BUILDING", " Kč").when(F.col("c_mktsegment") == "MACHINERY", shown)
    return table(spark, sf_dir, "customer").select("c_custkey", fields.chosen_price(first, shown).alias("price"))


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) || ' Kč' AS price_text FROM orders")
def money_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.money_text(F.col("o_totalprice")).alias("price_text"))
