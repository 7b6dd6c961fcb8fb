"""Merged raw listings to the clean table: one lazy plan with one shuffle, the distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forecourt.functions.numbers import to_number
from forecourt.functions.text import (
    canonical_name,
    fuel_class,
    normalise_text,
    transmission_class,
)
from forecourt.operators.columns import age, evaluate_once
from forecourt.operators.distinct import distinct_rows
from forecourt.operators.filters import block, drop_empty_rows, exclude_pair, in_range, require
from forecourt.params import CleanRules
from forecourt.schema import CLEAN, NUMERIC_COLUMNS, TEXT_COLUMNS


def with_numbers(df: DataFrame) -> DataFrame:
    """Add the numbers of the raw texts as `<column>_num`; a text that is no number gives null."""
    return evaluate_once(df, {f"{c}_num": to_number(F.col(c)) for c in NUMERIC_COLUMNS})


def plausible(df: DataFrame, rules: CleanRules) -> DataFrame:
    """Rows with all numbers in range. Mileage has no lower bound."""
    return df.filter(
        in_range(F.col("price_num"), rules.price)
        & in_range(F.col("year_num"), rules.year)
        & (F.col("mileage_km_num") <= rules.max_mileage)
        & in_range(F.col("volume_l_num"), rules.volume)
        & in_range(F.col("power_kw_num"), rules.power)
    )


def final_names(rules) -> tuple:
    return tuple((parts, normalise_text(F.lit(name))) for parts, name in rules)


def clean_listings(merged: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """The clean table of merged raw listings (all text columns, `source` optional).

    The distinct sees raw texts and the source, so equal cars from two sources or in two
    spellings both stay, unless `rules.dedup_after` asks for a second distinct.
    """
    # The ranges depend on the raw row alone, so rows outside them need not reach the shuffle.
    distinct = distinct_rows(plausible(with_numbers(drop_empty_rows(merged)), rules))
    listings = distinct.select(*TEXT_COLUMNS, *[F.col(f"{c}_num").alias(c) for c in NUMERIC_COLUMNS])
    named = evaluate_once(listings, {
        "brand": canonical_name(F.col("brand"), rules.brand_prefixes),
        "model": normalise_text(F.col("model")),
        # Classes carry their final spelling from the start.
        "transmission": transmission_class(F.col("transmission"), final_names(rules.transmission_rules)),
        "fuel": fuel_class(F.col("fuel"), final_names(rules.fuel_rules)),
    })
    complete = require(named, ["brand", "model", "transmission", "fuel"])
    if rules.excluded_pair:
        # The brand is compared as the prefix table spells it, before the next step.
        complete = exclude_pair(complete, "brand", "model", rules.excluded_pair)
    final = evaluate_once(complete, {"brand": normalise_text(F.col("brand"))})
    aged = block(final, TEXT_COLUMNS, rules.block_list).withColumn("age", age(F.col("year"), rules.as_of_year))
    kept = aged.select(*CLEAN)
    return distinct_rows(kept) if rules.dedup_after else kept
