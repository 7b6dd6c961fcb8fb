"""Selection of listings by brand and price at the source, with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _price_range(low: float | None, high: float | None, price: str) -> Column:
    kept = F.lit(True)
    if low is not None:
        kept = kept & (F.col(price) >= low)
    if high is not None:
        kept = kept & (F.col(price) <= high)
    return kept


def select_listings(
    df: DataFrame,
    brand_is: str | None = None,
    low: float | None = None,
    high: float | None = None,
    brand: str = "brand",
    price: str = "price",
) -> DataFrame:
    """Listings of a brand within a closed price range; every part is optional and pushed to the scan."""
    kept = _price_range(low, high, price)
    return df.filter(kept if brand_is is None else kept & (F.col(brand) == brand_is))


def select_or_drop_brand(
    df: DataFrame, brand_is: str, low=None, high=None, brand: str = "brand", price: str = "price"
) -> DataFrame:
    """As `select_listings`; if nothing fits, the price range alone decides."""
    fitting = select_listings(df, brand_is, low, high, brand, price)
    return df.filter(_price_range(low, high, price) & ((F.col(brand) == brand_is) | ~fitting.exists()))


def select_or_drop_range(
    df: DataFrame, brand_is: str, low=None, high=None, brand: str = "brand", price: str = "price"
) -> DataFrame:
    """As `select_listings`; if nothing fits, the brand alone decides."""
    fitting = select_listings(df, brand_is, low, high, brand, price)
    return df.filter((F.col(brand) == brand_is) & (_price_range(low, high, price) | ~fitting.exists()))
