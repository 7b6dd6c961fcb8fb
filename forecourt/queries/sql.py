"""Pieces of SQL for the comparison queries."""

from __future__ import annotations

from forecourt.functions.text import SPACES

CASED = r"\p{Lu}\p{Ll}\p{Lt}"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim(x: str) -> str:
    return f"trim({x}, '{SPACES}')"


def words(x: str) -> str:
    return f"regexp_split_to_array({trim(x)}, '[{SPACES}]+')"


def fold(x: str) -> str:
    return f"strip_accents({x})"


def title(x: str) -> str:
    capital = "CASE r[1] WHEN 'ß' THEN 'Ss' ELSE upper(r[1]) END"
    runs = f"regexp_extract_all(lower({x}), '([{CASED}]+|[^{CASED}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda r: {capital} || r[2:]), '')"


def squeeze(x: str) -> str:
    return f"replace(replace({x}, '-', ''), ' ', '')"


def normalised(x: str) -> str:
    return title(squeeze(f"lower({fold(x)})"))


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}, ' '), '{NUMBER}') THEN TRY_CAST(trim({x}, ' ') AS DOUBLE) END"


def canonical(x: str, prefixes: dict[str, str]) -> str:
    key = squeeze(fold(f"lower({trim(x)})"))
    cases = " ".join(f"WHEN starts_with({key}, '{p}') THEN '{name}'" for p, name in prefixes.items())
    return f"CASE {cases} ELSE {title(trim(x))} END"


def keyword(x: str, rules) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({x}, '{part}')" for part in parts) + f" THEN '{name}'"
        for parts, name in rules
    )
    return f"CASE {cases} END"


def digits(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{Nd}}]', '', 'g')"


def cleaned(merged: str, rules) -> str:
    """The cleaning job over a SELECT that gives merged raw listings."""
    brand, model = rules.excluded_pair
    words_out = ", ".join(f"'{w}'" for w in rules.block_list)
    return f"""
WITH merged AS ({merged}),
typed AS (
  SELECT brand, model, fuel, transmission, {number('volume_l')} AS volume_l, {number('year')} AS year,
         {number('mileage_km')} AS mileage_km, {number('price')} AS price, {number('power_kw')} AS power_kw
  FROM (SELECT DISTINCT * FROM merged)),
named AS (
  SELECT * REPLACE (
    {canonical('brand', rules.brand_prefixes)} AS brand,
    {normalised('model')} AS model,
    {keyword(f"lower({trim('fuel')})", rules.fuel_rules)} AS fuel,
    {keyword(fold(f"lower({trim('transmission')})"), rules.transmission_rules)} AS transmission)
  FROM typed
  WHERE price BETWEEN {rules.price[0]} AND {rules.price[1]}
    AND year BETWEEN {rules.year[0]} AND {rules.year[1]}
    AND mileage_km <= {rules.max_mileage}
    AND volume_l BETWEEN {rules.volume[0]} AND {rules.volume[1]}
    AND power_kw BETWEEN {rules.power[0]} AND {rules.power[1]}),
final AS (
  SELECT {normalised('brand')} AS brand, {normalised('model')} AS model, volume_l, mileage_km, price,
         {normalised('fuel')} AS fuel, {normalised('transmission')} AS transmission, power_kw,
         CAST({rules.as_of_year} - year AS INTEGER) AS age
  FROM named
  WHERE brand IS NOT NULL AND model IS NOT NULL AND fuel IS NOT NULL AND transmission IS NOT NULL
    AND NOT (brand = '{brand}' AND lower(model) = '{model}'))
SELECT * FROM final
WHERE lower(brand) NOT IN ({words_out}) AND lower(model) NOT IN ({words_out})
  AND lower(fuel) NOT IN ({words_out}) AND lower(transmission) NOT IN ({words_out})
"""
