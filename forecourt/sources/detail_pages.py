"""Detail pages to raw listings, or to the reason why a page gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.fields import (
    before_slash,
    chosen_price,
    engine_cm3,
    engine_litres,
    power_kw,
    subtitle_fields,
    title_brand,
    title_model,
    url_brand,
    url_model,
)
from forecourt.functions.numbers import digits_only
from forecourt.operators.columns import evaluate_once
from forecourt.params import DetailA, DetailB
from forecourt.schema import NOT_FOUND, RAW_A, RAW_B
from forecourt.sources.page_fields import Field, Items, Where, page_fields


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _reasons(checks: list[tuple[str, Column]]) -> Column:
    chosen = F.when(~F.col("readable"), F.lit("unreadable page"))
    for reason, missing in checks:
        chosen = chosen.when(missing, F.lit(reason))
    return chosen


def _missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == NOT_FOUND)


def extract_a(pages: DataFrame, page: DetailA = DetailA()) -> DataFrame:
    """pages(url, html) to (url, listing columns, reject_reason); the reason is null for a listing."""
    items = F.col("items")
    texts = page_fields(
        pages.select("url", "html"),
        {
            "title": Field(Where("div", page.heading_class), Where("h1")),
            "price_text": Field(Where("div", page.price_class), Where("strong")),
        },
        Items(Where("li"), Where("strong"), Where("span")),
    )

    def value_of(label: str, toggled: bool = True) -> Column:
        def fits(item: Column) -> Column:
            match = F.lower(item["label"]) == label
            return match & F.coalesce(item["toggle"] == page.toggle, F.lit(False)) if toggled else match

        return first(F.filter(items, fits))["value"]

    fields = evaluate_once(texts, {
        "brand": title_brand(F.col("title")),
        "model": title_model(F.col("title")),
        "volume_l": engine_litres(value_of(page.engine)),
        "year": value_of(page.year),
        "mileage_km": digits_only(value_of(page.mileage)),
        "price": digits_only(F.col("price_text")),
        "fuel": value_of(page.fuel),
        "transmission": before_slash(value_of(page.transmission)),
        "power_kw": power_kw(value_of(page.power, toggled=False)),
    })
    checks = [("no title", F.col("title").isNull())]
    checks += [
        (f"no {name}", _missing(name))
        for name in ("year", "mileage_km", "price", "fuel", "transmission", "power_kw", "brand", "model", "volume_l")
    ]
    return fields.select("url", *RAW_A, _reasons(checks).alias("reject_reason"))


def extract_b(pages: DataFrame, page: DetailB = DetailB()) -> DataFrame:
    """As `extract_a`, for source B; brand and model come from the address."""
    items = F.col("items")
    texts = page_fields(
        pages.select("url", "html"),
        {
            "subtitle": Field(Where("span", page.subtitle_class), separator=" "),
            "price_1": Field(Where("div", page.price_class)),
            "price_2": Field(Where("span", page.other_price_class)),
        },
        Items(Where("li", like=page.item_pattern), Where("div", like=page.label_pattern), Where("div", like=page.value_pattern)),
    )

    def last_value(label: str, usable=lambda value: F.lit(True)) -> Column:
        values = F.filter(items, lambda i: (i["label"] == label) & i["value"].isNotNull() & usable(i["value"]))
        return F.try_element_at(values, F.lit(-1))["value"]

    fields = evaluate_once(texts, {
        "brand": url_brand(F.col("url")),
        "model": url_model(F.col("url")),
        # The last engine entry decides, also when it cannot be read.
        "volume_cm3": engine_cm3(last_value(page.engine)),
        "sub": subtitle_fields(F.col("subtitle"), (page.used, page.new), page.dated_years, page.plain_years),
        "price": chosen_price(F.col("price_1"), F.col("price_2")),
        "fuel": last_value(page.fuel),
        "transmission": last_value(page.transmission),
        "power_kw": digits_only(last_value(page.power, lambda v: digits_only(v) != "")),
    }).withColumns({"year": F.col("sub.year"), "mileage_km": F.col("sub.mileage_km")})
    checks = [(f"no {name}", _missing(name)) for name in RAW_B]
    return fields.select("url", *RAW_B, _reasons(checks).alias("reject_reason"))


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("reject_reason").isNotNull()).select("url", "reject_reason")
