"""Typed fields out of page texts and addresses, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forecourt.functions.numbers import digits_only
from forecourt.functions.text import SPACE_RANGES, title_case, trim_all
from forecourt.params import DATED_YEARS, PLAIN_YEARS


# The patterns of power, engine size and volume in texts.
POWER = r"(\d+)\s*kW"
LITRES = r"(\d+(?:[.,]\d+)?)"
CM3 = r"(\d[\d\s]*)(?=\s*ccm)"


def absent_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match. `\\s` and `\\d` mean all of Unicode."""
    return absent_if_empty(F.regexp_extract(text, f"(?U){pattern}", 1))


def power_kw(text: Column) -> Column:
    return first_group(text, POWER)


def engine_litres(text: Column) -> Column:
    """First number in the text, with a decimal point or comma, spelled as a double."""
    number = F.replace(first_group(text, LITRES), F.lit(","), F.lit("."))
    return number.try_cast("double").cast("string")


def engine_cm3(text: Column) -> Column:
    """Digit groups in front of `ccm`, joined."""
    found = first_group(F.translate(text, "\xa0", " "), CM3)
    return F.regexp_replace(found, f"[{SPACE_RANGES}]+", "").try_cast("bigint").cast("string")


def words(text: Column) -> Column:
    return F.split(trim_all(text), f"[{SPACE_RANGES}]+")


def _nth_word(text: Column, n: int) -> Column:
    space, word = f"[{SPACE_RANGES}]", f"[^{SPACE_RANGES}]"
    return absent_if_empty(F.regexp_extract(text, f"^{space}*+(?:{word}++{space}++){{{n}}}({word}++)", 1))


def title_brand(title: Column) -> Column:
    """First word of a title, or the whole title if it has one word only."""
    return F.when(_nth_word(title, 1).isNull(), title).otherwise(_nth_word(title, 0))


def title_model(title: Column) -> Column:
    """Second word of a title; null if there is none."""
    return _nth_word(title, 1)


def before_slash(text: Column) -> Column:
    return trim_all(F.split_part(text, F.lit("/"), F.lit(1)))


def _url_part(url: Column, at: int) -> Column:
    parts = F.split(F.get(F.split(url, "/detail/"), F.lit(1)), "/")
    part = F.when(F.size(parts) >= 2, F.get(parts, F.lit(at)))
    return title_case(F.translate(part, "-", " "))


def url_brand(url: Column) -> Column:
    return _url_part(url, 0)


def url_model(url: Column) -> Column:
    return _url_part(url, 1)


def _subtitle_parts(text: Column, dropped: tuple[str, ...]) -> Column:
    for word in dropped:
        text = F.replace(text, F.lit(word), F.lit(""))
    return F.transform(F.split(trim_all(text), ","), trim_all)


def _part_year(part: Column, dated_years: tuple[int, int], plain_years: tuple[int, int]) -> Column:
    """The year in `m/yyyy` or in plain digits, strictly between the years given, else null."""
    halves = F.split(part, "/")
    written = trim_all(F.get(halves, F.lit(1)))
    dated = F.when((F.size(halves) == 2) & written.rlike(r"^\+?\p{Nd}+$"), written.try_cast("bigint"))
    plain = F.when(part.rlike(r"^\p{Nd}+$"), part.try_cast("bigint"))

    def between(year: Column, ends: tuple[int, int]) -> Column:
        return F.when((year > ends[0]) & (year < ends[1]), year)

    return F.when(part.contains("/"), between(dated, dated_years)).otherwise(between(plain, plain_years))


def subtitle_fields(
    text: Column, dropped: tuple[str, ...], dated_years: tuple[int, int] = DATED_YEARS, plain_years: tuple[int, int] = PLAIN_YEARS
) -> Column:
    """struct(year, mileage_km) of a comma list such as `5/2018, 150 000 km`.

    The first part that holds a year gives it. The first part with `km` and a digit gives the
    mileage, but a part with a slash is looked at for it only after the year's part.
    """
    parts = _subtitle_parts(text, dropped)
    dated = F.transform(parts, lambda part, at: F.struct(_part_year(part, dated_years, plain_years).alias("year"), at.alias("at")))
    first_dated = F.get(F.filter(dated, lambda d: d["year"].isNotNull()), F.lit(0))

    def fields(found: Column) -> Column:
        with_km = F.filter(
            found["parts"],
            lambda part, at: F.lower(part).contains("km")
            & part.rlike(r"\p{Nd}")
            & (~part.contains("/") | F.coalesce(at > found["dated"]["at"], F.lit(False))),
        )
        return F.struct(
            found["dated"]["year"].cast("string").alias("year"),
            digits_only(F.get(with_km, F.lit(0))).alias("mileage_km"),
        )

    # Inside the lambda the parts and the year are finished values.
    found = F.struct(parts.alias("parts"), first_dated.alias("dated"))
    return F.get(F.transform(F.array(found), fields), F.lit(0))


def price_digits(text: Column) -> Column:
    """A price text without currency and spaces; null if nothing is left. Other words stay."""
    bare = F.translate(F.replace(text, F.lit("Kč"), F.lit("")), " \xa0", "")
    return absent_if_empty(trim_all(bare))


def chosen_price(first: Column, second: Column) -> Column:
    """The second text counts only where the first element is missing, not where it is empty."""
    return F.when(first.isNotNull(), price_digits(first)).otherwise(price_digits(second))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
