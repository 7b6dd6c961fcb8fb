"""Numbers in text, unit conversion and money text as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a number, ASCII white space around it allowed. Engines differ on suffixes,
# underscores and words such as "inf".
NUMBER = r"^[ \t-\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t-\r]*$"


def to_number(text: Column) -> Column:
    """The number in a text, or null where the text is no plain decimal number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def strict_number(text: Column) -> Column:
    """The number in a text; a text that is no number fails the job."""
    return F.when(
        text.isNull() | to_number(text).isNotNull(), to_number(text)
    ).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))


def litres(cm3: Column) -> Column:
    """Cubic centimetres to litres with one decimal, halves to the even digit."""
    return F.bround(cm3 / 1000, 1)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{Nd}]", "")


def money_text(amount: Column, unit: str = "Kč") -> Column:
    return F.concat(F.format_number(amount, 2), F.lit(f" {unit}"))
