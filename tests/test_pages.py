"""Extraction from hand-written pages, one page per reason for rejection."""

import html
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from forecourt.params import SITE_A, SITE_B, Budget
from forecourt.plans.build import build_clean
from forecourt.plans.collect import collect_a, collect_b, first_page_of_link, frontier_listings
from forecourt.params import CleanRules
from forecourt.queries import page_tables
from forecourt.schema import RAW_A, RAW_B
from forecourt.sources import page_fields as page_fields_module
from forecourt.sources.detail_pages import accepted, extract_a, extract_b, rejected
from forecourt.sources.listing_links import distinct_links, page_addresses, page_links, unescaped
from forecourt.sources.page_fields import Field, Items, Where, page_fields

PAGE_A = """<div class="car_detail2__h1"><h1>Škoda Octavia 2.0 TDI</h1></div>
<ul><li data-toggle="popover"><strong>Rok</strong><span> 2018 </span></li>
<li data-toggle="popover"><strong>Stav tachometru</strong><span>150 000 km</span></li>
<li data-toggle="popover"><strong>Palivo</strong><span>Nafta</span></li>
<li data-toggle="popover"><strong>Převodovka</strong><span>manuální / 6</span></li>
<li><strong>Výkon</strong><span>110 kW</span></li>
<li data-toggle="popover"><strong>Motor</strong><span>2,0 TDI</span></li></ul>
<div class="show-more-price-right-right"><strong>350 000 Kč</strong></div>"""
LISTING_A = ("Škoda", "Octavia", "2.0", "2018", "150000", "350000", "Nafta", "manuální", "110")


def item(label, value):
    return (
        '<li class="c-car-properties__tile"><div class="c-car-properties__tile-label">' + label
        + '</div><div class="c-car-properties__tile-value">' + value + "</div></li>"
    )


PAGE_B = (
    '<span class="c-a-basic-info__subtitle-info">Ojeté, 5/2018, 150 000 km</span>'
    '<div class="c-a-basic-info__price">350 000 Kč</div><ul>'
    + item("Palivo", "Nafta") + item("Převodovka", "Manuální") + item("Výkon", "110 kW")
    + item("Objem", "1 968 ccm") + "</ul>"
)
URL_B = "https://b/detail/skoda/octavia/123"
LISTING_B = ("Skoda", "Octavia", "1968", "2018", "150000", "350000", "Nafta", "Manuální", "110")


def drop(page, part, by=""):
    assert part in page
    return page.replace(part, by)


A_CASES = {
    "no title": drop(PAGE_A, "<h1>Škoda Octavia 2.0 TDI</h1>"),
    "no year": drop(PAGE_A, "Rok", "Rok výroby"),
    "no price": drop(PAGE_A, "<strong>350 000 Kč</strong>"),
    "no power_kw": drop(PAGE_A, "110 kW", "110"),
    "no volume_l": drop(PAGE_A, "Motor", "Motorizace"),
    "no model": drop(PAGE_A, "Škoda Octavia 2.0 TDI", "Škoda"),
    "no fuel": drop(PAGE_A, "<span>Nafta</span>"),
    "no mileage_km": drop(PAGE_A, '<li data-toggle="popover"><strong>Stav', "<li><strong>Stav"),
    "no brand": drop(PAGE_A, "Škoda Octavia", "Nezjištěno Octavia"),
}
B_CASES = {
    "no year": (URL_B, drop(PAGE_B, "c-a-basic-info__subtitle-info", "other")),
    "no price": (URL_B, drop(PAGE_B, "350 000 Kč", " Kč ") + '<span class="c-basic-info__price">5 Kč</span>'),
    "no volume_cm3": (URL_B, PAGE_B.replace("</ul>", item("Objem", "2.0 l") + "</ul>")),
    "no brand": ("https://b/skoda/octavia", PAGE_B),
    "no power_kw": (URL_B, drop(PAGE_B, "110 kW", "kW")),
    "no transmission": (URL_B, drop(PAGE_B, "Převodovka")),
}


def test_page_a(spark):
    assert [tuple(r[c] for c in RAW_A) for r in accepted(extract_a(spark.createDataFrame([("u", PAGE_A)], "url string, html string"))).collect()] == [LISTING_A]


def test_page_b(spark):
    rows = accepted(extract_b(spark.createDataFrame([(URL_B, PAGE_B)], "url string, html string"))).collect()
    assert [tuple(r[c] for c in RAW_B) for r in rows] == [LISTING_B]


def test_rejects(spark):
    a = spark.createDataFrame([(k, v) for k, v in A_CASES.items()] + [("unreadable page", None)], "url string, html string")
    found = rejected(extract_a(a)).collect()
    assert sorted((r.url, r.reject_reason) for r in found) == sorted((k, k) for k in [*A_CASES, "unreadable page"])
    for reason, (url, html) in B_CASES.items():
        page = spark.createDataFrame([(url, html)], "url string, html string")
        assert [r.reject_reason for r in rejected(extract_b(page)).collect()] == [reason]


def test_details_of_page_a(spark):
    pages = {
        # The first match counts; a toggle is needed for all but the power.
        "first": PAGE_A.replace("</ul>", '<li data-toggle="popover"><strong>Palivo</strong><span>LPG</span></li></ul>'),
        "plain": PAGE_A.replace("<ul>", "<ul><li><strong>Palivo</strong><span>LPG</span></li>"),
        "nested": PAGE_A.replace("<strong>Palivo</strong>", "<p><strong> PALIVO\n</strong></p><em>"),
        "hidden": PAGE_A.replace("<ul>", "<!-- <li data-toggle='popover'><strong>Palivo</strong><span>x</span></li> --><script>'<li>'</script><ul>"),
        "unclosed": PAGE_A.replace("</li>", ""),
    }
    rows = accepted(extract_a(spark.createDataFrame(list(pages.items()), "url string, html string"))).collect()
    assert {r.url: r.fuel for r in rows} == {name: "Nafta" for name in pages}


def test_details_of_page_b(spark):
    pages = [
        (URL_B + "/1", PAGE_B.replace("</ul>", item("Palivo", "LPG") + item("Výkon", "?") + "</ul>")),
        (URL_B + "/2", drop(PAGE_B, '<div class="c-a-basic-info__price">350 000 Kč</div>') + '<span class="x c-basic-info__price">1 Kč</span>'),
        (URL_B + "/3", drop(PAGE_B, "350 000 Kč", "Cena na dotaz")),
    ]
    rows = {r.url[-1]: r for r in accepted(extract_b(spark.createDataFrame(pages, "url string, html string"))).collect()}
    assert (rows["1"].fuel, rows["1"].power_kw) == ("LPG", "110")
    assert [rows[k].price for k in "23"] == ["1", "Cenanadotaz"]


def test_texts_of_elements(spark):
    html = "<li>a <b>b</b><!-- x -->c<script>no</script> &amp; d<br/>e<p>f</div>g</li><li>h"
    li = Where("li")
    fields = {"all": Field(li), "spaced": Field(li, separator=" "), "p": Field(li, Where("p")), "none": Field(Where("li", "x"))}
    row = page_fields(spark.createDataFrame([(1, html)], "id int, html string"), fields, Items(li, Where("b"), Where("p"))).first()
    assert row[:5] == (1, "abc& defg", "a b c & d e f g", "fg", None)
    assert [tuple(i) for i in row["items"]] == [(None, "b", "fg"), (None, None, None)] and row["readable"]


def test_pages_that_are_hard_to_read(spark):
    pages = {
        "<p>a</p": "a", "<p>a<b": "a", "<p>a < b <= c</p>": "a < b <= c", "<P CLASS=x>a</P>b": "a", "<p/>a": "",
        "<p title='>' class=\"x>y\">a</p>": "a", "<p title=\">a</p>b": "a", "<p>a<style>p</style>b</p>": "ab",
        "<p>a<script>if (a < b) '</p>'</script>b</p>": "ab", "<p>a<!-- <p> -- > </p> -->b</p>": "ab", "<p>a<!-- never": "a",
        "<p>a<!doctype x>b<?pi?>c</>d</p>": "abcd", "<p>&lt;b&gt; &nbsp;&eacute</p>": "<b> \xa0é", "<div><p>a</div>b": "a",
        "<p>a<svg/>b<br>c</p>": "abc", "<p>a<template>no</template>b": "ab", "</p>x<p>a": "a", "<p>" + "<i>" * 5000 + "a": "a",
        "": None, "x": None, "<": None,
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    found = page_fields(rows, {"t": Field(Where("p"))}).orderBy("id").collect()
    assert [r.t for r in found] == list(pages.values()) and all(r.readable for r in found)


def test_a_fault_rejects_its_page_alone(spark, monkeypatch):
    rows = spark.createDataFrame([("u1", PAGE_A), ("u2", None), ("u3", PAGE_A)], "url string, html string").coalesce(1)

    def scan_fails(self, tag, attributes, begin=page_fields_module._Chosen.begin):
        if "fault" in attributes:
            raise RuntimeError("fault")
        return begin(self, tag, attributes)

    monkeypatch.setattr(page_fields_module._Chosen, "begin", scan_fails)
    bad = rows.withColumn("html", F.when(F.col("url") == "u3", F.concat(F.lit("<li fault>"), "html")).otherwise(F.col("html")))
    out = {r.url: r.reject_reason for r in extract_a(bad).collect()}
    assert out == {"u1": None, "u2": "unreadable page", "u3": "unreadable page"}


def test_rows_of_one_file_make_pages_in_many_tasks(spark, tmp_path, monkeypatch):
    ids = spark.range(200).coalesce(1)
    # Keys that come twice and null ones are pages of their own.
    key = F.when(F.col("id") % 10 != 0, F.col("id") % 90).cast("int")
    part = ids.select(
        key.alias("p_partkey"), F.lit("blush red").alias("p_name"), F.lit("ECONOMY").alias("p_type"), F.lit("Brand#11").alias("p_brand"),
        (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") + 900.5).alias("p_retailprice"),
    )
    customer = ids.select(
        key.alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("Customer 2").alias("c_name"),
        F.lit("MACHINERY").alias("c_mktsegment"), (F.col("id") * 10.5 + 150).alias("c_acctbal"),
    )
    part.write.parquet(str(tmp_path / "part.parquet"))
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(page_tables, "PAGES_PER_TASK", 25)

    def rows(df):
        return sorted(map(str, df.collect()))

    a, b = extract_a(page_tables.pages_a(part)), extract_b(page_tables.pages_b(customer))
    for query, plain in ((page_tables.extract_source_a, a), (page_tables.extract_source_b, b)):
        found = query(spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() == 8
        assert rows(found) == rows(plain)
    built = page_tables.build_from_pages(spark, str(tmp_path))
    assert rows(built) == rows(build_clean(accepted(a).drop("url"), accepted(b).drop("url"), page_tables._BUILD_RULES)) != []


def test_little_of_a_page_leaves_its_task(spark):
    filler = "<div><ul><li>x</li></ul><span>filler text</span></div>" * 300
    page = spark.createDataFrame([("u", filler.replace("<li>x</li>", "") + PAGE_A + filler.replace("<li>x</li>", ""))], "url string, html string")
    found = page_fields(page, {"t": Field(Where("div", "car_detail2__h1"), Where("h1"))}, Items(Where("li"), Where("strong"), Where("span"))).first()
    assert found.t == "Škoda Octavia 2.0 TDI" and len(found["items"]) == 6
    assert accepted(extract_a(page)).count() == 1


class Anchors(HTMLParser):
    def __init__(self, wanted):
        super().__init__()
        self.wanted, self.found = wanted, []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        classes = (named.get("class") or "").split()
        if tag == "a" and named.get("href") and (self.wanted in classes or self.wanted == " ".join(classes)):
            self.found.append(named["href"])


LINKS = (
    '<a class="car_item" href="/x">1</a><a href=/x class="b car_item">2</a><A HREF=\'http://h/y?a=1&amp;b=2\' CLASS=car_item>3</a>'
    '<a class="car_item">no href</a><a class="car_item" href="">empty</a><a class="car_items" href="/n">other</a>'
    '<!-- <a class="car_item" href="/c">no</a> --><script>"<a class=\'car_item\' href=\'/s\'>"</script>'
    '<a title="a > b" href="/t" class="car_item"><a data-href="/d" class="car_item" href = "/e"><abbr class="car_item" href="/f">'
    '<a\nclass="car_item"\nhref="/g"/><a class="sds-surface  sds-surface--clickable sds-surface--00 c-item__link" href="/b">'
    '<a class="c-item__link" href="/c2">'
)


@pytest.mark.parametrize("site", [SITE_A, SITE_B])
def test_links_like_the_parser(spark, site):
    pages = spark.createDataFrame([(1, LINKS), (2, "<p>car_item</p>"), (3, None)], "page int, html string")
    parser = Anchors(site.link_class)
    parser.feed(LINKS)
    expected = [(1, h if h.startswith("http") else site.base + h) for h in parser.found]
    found = page_links(pages, site.base, site.link_class).orderBy("page", "position").collect()
    assert [(r.page, r.link) for r in found] == expected and len(expected) >= 1
    distinct = distinct_links(pages, site.base, site.link_class).collect()
    assert sorted(tuple(r) for r in distinct) == sorted(set(expected))


def test_references_in_attributes_like_the_standard(evaluate):
    named = [f"/a&{name}z" for name in html5 if name.endswith(";")]
    codes = [*range(0x20, 0x7F), *range(0x80, 0xA0), 0xE9, 0x20AC, 0x4E2D, 0x1F600, 0xD800, 0x110000, 99999999999]
    numbers = [f"/{prefix}{form}{tail}" for c in codes for prefix, form in (("&#", c), ("&#x", f"{c:x}"), ("&#X00", f"{c:X}")) for tail in (";", " z")]
    others = ["/a?b=1&c=2", "/a&amp;lt;", "/a&amp;#38;", "&", "&&amp;&", "&unknown;", "/x&#x2F;&eacute;&#38;y", "&#;", "&#x;", "", None]
    values = [*named, *numbers, *others]
    assert evaluate(unescaped, values) == [v and html.unescape(v) for v in values]
    assert evaluate(unescaped, ["/a?x=1&copy=2", "/a?x=1&copyz"]) == ["/a?x=1&copy=2", "/a?x=1&copyz"]


def test_links_of_long_page(spark):
    html = "<a class='car_item' href='/1'>" + "<a title='" + "x" * 300_000 + "' href='/2' class=car_item>" + "<p>" * 100_000
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    assert page_links(pages, "", "car_item").count() == 2


def test_page_addresses(spark):
    bases = spark.createDataFrame([("http://a",), ("http://b?c=1",)], "base string")
    rows = page_addresses(bases, "strana", 2).orderBy("base", "page").collect()
    assert [r.address for r in rows] == ["http://a", "http://a?strana=2", "http://b?c=1", "http://b?c=1&strana=2"]


def test_collect_and_build(spark):
    def listing_a(km):
        return PAGE_A.replace("150 000", km)

    details = spark.createDataFrame(
        [(f"https://www.autoesa.cz/{n}", listing_a(km)) for n, km in (("1", "1"), ("2", "2"), ("3", "2"), ("4", "4"), ("9", "9"))]
        + [("https://www.autoesa.cz/bad", "<p>")],
        "url string, html string",
    )

    def result(*names):
        return "".join(f'<a class="car_item" href="/{n}">x</a>' for n in names)

    results = spark.createDataFrame(
        [(1, result("1", "2", "bad")), (2, result("2", "3")), (3, result("4"))], "page int, html string"
    )
    # Page 2 shows nothing new: its two listings have the values of one on page 1.
    rows = collect_a(results, details, Budget(min_rows=10, max_pages=5)).collect()
    assert sorted(r.mileage_km for r in rows) == ["1", "2"]
    links_b = '<a class="%s" href="%s">x</a>' % (SITE_B.link_class, URL_B)
    b = collect_b(
        spark.createDataFrame([(1, links_b)], "page int, html string"),
        spark.createDataFrame([(URL_B, PAGE_B)], "url string, html string"),
        Budget(),
    )
    a = collect_a(results, details, Budget(min_rows=1, max_pages=5))
    clean = build_clean(a, b, CleanRules(as_of_year=2026)).collect()
    assert sorted(r.mileage_km for r in clean) == [1.0, 2.0, 150000.0]
    assert {(r.brand, r.model, r.fuel, r.transmission, r.age) for r in clean} == {("Skoda", "Octavia", "Nafta", "Manualni", 8)}


def result_page(*names):
    return "".join(f'<a class="car_item" href="/{n}">x</a>' for n in names)


@pytest.fixture(scope="module")
def many_pages(spark):
    """30 result pages of 3 links: two of the page before, one new; page 21 has nothing new."""
    results = [(p, result_page(p - 2, p - 1, p if p != 21 else 1)) for p in range(1, 31)]
    details = [(f"{SITE_A.base}/{n}", PAGE_A.replace("150 000", f"{1000 + n}")) for n in range(-1, 60)]
    return spark.createDataFrame(results, "page int, html string"), spark.createDataFrame(details, "url string, html string")


@pytest.mark.parametrize("first_wave", [1, 4, 64])
@pytest.mark.parametrize(("min_rows", "max_pages", "found"), [(5, 30, 5), (100, 30, 22), (100, 12, 14), (3, 1, 3), (23, 30, 22)])
def test_waves_take_the_same_pages(many_pages, first_wave, min_rows, max_pages, found):
    rows = collect_a(*many_pages, Budget(min_rows=min_rows, max_pages=max_pages), first_wave=first_wave).collect()
    assert sorted(int(r.mileage_km) for r in rows) == list(range(999, 999 + found))


def test_waves_without_any_page(spark, many_pages):
    results, details = many_pages
    assert collect_a(results.limit(0), details, Budget(), first_wave=2).count() == 0
    assert collect_a(results, details.limit(0), Budget(), first_wave=2).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_only_linked_pages_are_parsed(spark, many_pages, small, tmp_path):
    results, details = many_pages
    path = str(tmp_path / "links")
    first_page_of_link(results.filter("page <= 4"), SITE_A).write.parquet(path)
    found = frontier_listings(details, spark.read.parquet(path), extract_a, small)
    assert found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Top of the plan first: the semi-join lies below the parser.
    assert plan.index("MapInArrow") < plan.index("LeftSemi")
    if small:
        below = plan[plan.index("LeftSemi"):]
        assert "BroadcastHashJoin" in plan[: plan.index("LeftSemi") + 10] and "hashpartitioning(url" not in below
