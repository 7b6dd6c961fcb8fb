"""Listing links of result pages, and the addresses of result pages."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.fields import absolute_url
from forecourt.functions.text import trim_all
from forecourt.operators.columns import evaluate_once

# Text that looks like markup but is none.
_HIDDEN = r"(?is)<!--.*?-->|<script(?=[\s/>]).*?</script\s*>|<style(?=[\s/>]).*?</style\s*>"
# Attribute text of an `a` start tag. Possessive, so that long pages need no backtracking.
_ANCHOR = r"""(?is)<a(?=[\s/>])((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
_NAME = r"""([^\s=/"'>]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_VALUE = r"""[^\s=/"'>]+(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
# A character reference as attributes hold them, or text between references.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=;])))"
_PIECES = f"({_REFERENCE}|[^&]+|&)"
# The standard's names, the usual ones first, as a lookup goes from the front; and what the
# numbers 128 to 159 stand for.
_NAMES = {name: html5[name] for name in ("amp;", "quot;", "lt;", "gt;", "apos;")} | html5
_WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


def anchors(html: Column) -> Column:
    """array<string>: the attribute text of every `a` start tag, in page order."""
    return F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_ANCHOR), F.lit(1))


def attributes(tag: Column) -> Column:
    """array<struct(n, v)>: names and unquoted values in the attribute text of a tag."""
    names = F.regexp_extract_all(tag, F.lit(_NAME), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(_VALUE), F.lit(1))
    return F.zip_with(
        names,
        values,
        lambda n, v: F.struct(
            F.lower(n).alias("n"), F.regexp_replace(v, r"""^(["'])([\s\S]*)\1$""", "$2").alias("v")
        ),
    )


def _character(code: Column) -> Column:
    """The character of a number; the replacement character if it has none."""
    none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    valid = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(none, F.lit("\ufffd"))
        .when(code.between(128, 159), F.substring(F.lit(_WINDOWS), code.cast("int") - 127, F.lit(1)))
        .otherwise(valid)
    )


def unescaped(value: Column) -> Column:
    """All character references of an attribute's value as characters, each once."""
    names = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in _NAMES.items())), F.lit("\x01"), F.lit("\x02"))

    def number(digits: Column, base: int) -> Column:
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(digits) > 7, F.lit(0x110000).cast("long")).otherwise(F.conv(digits, base, 10).cast("long"))

    def spell(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, "^&#([0-9]+);?$", 1)
        hexadecimal = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);?$", 1)
        return (
            F.when(~piece.rlike(f"^{_REFERENCE}$"), piece)
            .when(decimal != "", _character(number(decimal, 10)))
            .when(hexadecimal != "", _character(number(hexadecimal, 16)))
            .otherwise(F.coalesce(F.try_element_at(names, F.substring(piece, 2, 64)), piece))
        )

    pieces = F.regexp_extract_all(value, F.lit(_PIECES), F.lit(1))
    return F.when(value.contains("&"), F.array_join(F.transform(pieces, spell), "")).otherwise(value)


def attribute(pairs: Column, name: str) -> Column:
    """Value of an attribute; the last one counts, null if absent."""
    value = F.try_element_at(F.filter(pairs, lambda p: p["n"] == name), F.lit(-1))["v"]
    return unescaped(value)


def _has_link_class(classes: Column, link_class: str) -> Column:
    if " " in link_class:
        return classes == link_class
    return F.array_contains(F.split(classes, " "), link_class)


def page_links(pages: DataFrame, base: str, link_class: str | None = None, html: str = "html") -> DataFrame:
    """One row per link: the other page columns, `position` (from 1) and the absolute `link`.

    Pages that cannot hold the class are skipped before any tag is looked at.
    """
    others = [c for c in pages.columns if c != html]
    if link_class is not None:
        pages = pages.filter(F.col(html).contains(link_class.split()[0]))
    tags = pages.select(*others, F.posexplode(anchors(F.col(html))).alias("at", "tag"))
    named = evaluate_once(tags, {"tag": attributes(F.col("tag"))})
    found = evaluate_once(named, {
        "href": attribute(F.col("tag"), "href"),
        "classes": F.regexp_replace(trim_all(attribute(F.col("tag"), "class")), r"\s+", " "),
    })
    if link_class is not None:
        found = found.filter(_has_link_class(F.col("classes"), link_class))
    return found.filter(F.col("href") != "").select(
        *others, (F.col("at") + 1).alias("position"), absolute_url(F.col("href"), base).alias("link")
    )


def distinct_links(pages: DataFrame, base: str, link_class: str | None = None, html: str = "html") -> DataFrame:
    """The distinct links per page, or per whatever columns come with the page text."""
    return page_links(pages, base, link_class, html).drop("position").distinct()


def page_addresses(bases: DataFrame, page_param: str, max_pages: int, base: str = "base") -> DataFrame:
    """(base columns, page, address) for result pages 1 to `max_pages`; page 1 is the base itself."""
    address = F.col(base)
    separator = F.when(address.contains("?"), "&").otherwise("?")
    numbered = bases.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    return numbered.withColumn(
        "address",
        F.when(F.col("page") == 1, address).otherwise(
            F.concat(address, separator, F.lit(f"{page_param}="), F.col("page").cast("string"))
        ),
    )
