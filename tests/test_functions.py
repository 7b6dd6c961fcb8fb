"""Scalar expressions against Python, pandas and fixed expectations."""

import sys
import unicodedata

import numpy as np
import pandas as pd
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from forecourt.functions import fields, numbers, text
from forecourt.params import BRAND_PREFIXES, FUEL_RULES, TRANSMISSION_RULES
from forecourt.plans.clean import final_names

EVERY = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs")]


def packed(form, size=200):
    """Texts that hold `form` of every code point, some in each."""
    return ["".join(form(c) for c in EVERY[at : at + size]) for at in range(0, len(EVERY), size)]


def without_marks(s):
    return regex.sub(r"\P{ccc=0}", "", unicodedata.normalize("NFKD", s))


def test_strip_accents_every_code_point(evaluate):
    inputs = [*packed(lambda c: f"a{c}b"), *"한국어 각 힣", "Příliš žluťoučký kůň", "Citroën", "łada", "ﬁ½Ǆ…ﷺ", "𝒜𝟗 ２０", "", None]
    got = evaluate(text.strip_accents, inputs)
    assert got == [s and without_marks(s) for s in inputs]
    assert evaluate(text.strip_accents, got) == got


def test_strip_accents_by_hand(evaluate):
    cases = {"Škoda": "Skoda", "Citroën": "Citroen", "½ ﬁ": "1⁄2 fi", "각": "\u1100\u1161\u11a8", "가": "\u1100\u1161", "ß ø ł": "ß ø ł"}
    assert evaluate(text.strip_accents, list(cases)) == list(cases.values())


def test_case_every_code_point(evaluate):
    inputs = [
        *packed(lambda c: f"{c}a{c} {c}{c}1{c}A "), *packed(lambda c: f"aΣ{c} aΣ{c}a {c}Σ Σ{c}-aΣ"),
        "c4picasso", "3er", "id.3", "x'trail", "ŠKODA octavia", "straße 1a ßa", "ΑΣ ΑΣΑ Σ", "", None,
    ]
    assert evaluate(text.lower_case, inputs) == [s and s.lower() for s in inputs]
    assert evaluate(text.title_case, inputs) == [s and s.title() for s in inputs]


def test_case_of_plain_latin_texts_goes_the_short_way(spark):
    df = spark.createDataFrame([("ŽLUŤOUČKÝ kůň", False), ("ǆ", True), ("İ", True), ("ª", True)], "t string, odd boolean")
    assert df.filter(F.col("t").rlike(text.ODD) != F.col("odd")).count() == 0


def test_normalise_text(evaluate):
    cases = {
        "C-Max 2": "Cmax2", "X-Trail": "Xtrail", "4ever t5": "4Evert5", "Řada": "Rada", "Land-Rover": "Landrover",
        "ŠKODA  Octavia": "Skodaoctavia", "ﬁat ½": "Fiat1⁄2", "ΟΔΟΣ": "Οδος", "": "", None: None,
    }
    got = evaluate(text.normalise_text, list(cases))
    assert got == list(cases.values()) and evaluate(text.normalise_text, got) == got


def test_normalise_text_every_code_point(evaluate):
    inputs = packed(lambda c: f"{c}x {c}-Y{c}")
    steps = [without_marks(s).lower().translate({ord("-"): None, ord(" "): None}) for s in inputs]
    assert evaluate(text.normalise_text, inputs) == [s.title() for s in steps]


def test_names_of_classes_are_spelled_as_in_the_clean_table(spark):
    names = [name for rules in (FUEL_RULES, TRANSMISSION_RULES) for _, name in final_names(rules)]
    assert list(spark.range(1).select(*names).first()) == ["Benzin", "Nafta", "Hybridni", "Elektro", "Manualni", "Automaticka"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=12), min_size=40))
def test_text_functions_on_random_text(evaluate, inputs):
    inputs = [s.replace("\0", "") for s in inputs]
    assert evaluate(text.strip_accents, inputs) == [without_marks(s) for s in inputs]
    assert evaluate(text.lower_case, inputs) == [s.lower() for s in inputs]
    assert evaluate(text.title_case, inputs) == [s.title() for s in inputs]
    assert evaluate(text.trim_all, inputs) == [s.strip() for s in inputs]
    assert evaluate(text.drop_hyphens_spaces, inputs) == [s.replace("-", "").replace(" ", "") for s in inputs]


def test_canonical_name(evaluate):
    cases = {
        " škoda ": ("Skoda", "Skoda"), "Citroën": ("Citroën", "Citroen"),
        "Alfa Romeo": ("Alfa Romeo", "Alfaromeo"), "Land-Rover": ("Land-Rover", "Landrover"),
        "SEAT": ("Seat", "Seat"), "bmw": ("BMW", "Bmw"), "Mercury": ("MercedesBenz", "Mercedesbenz"),
        "Smart Fortwo": ("Smart Fortwo", "Smartfortwo"), "Volvo": ("Volvo", "Volvo"),
        "V-O-L-K-S": ("Volkswagen", "Volkswagen"), None: (None, None),
    }
    first = evaluate(lambda c: text.canonical_name(c, BRAND_PREFIXES), list(cases))
    assert first == [a for a, _ in cases.values()]
    assert evaluate(text.normalise_text, first) == [b for _, b in cases.values()]


def test_classes(evaluate):
    gearbox = ["manuální", "Automatická (manuální režim)", "poloautomat", "CVT", " MAN ", None]
    assert evaluate(lambda c: text.transmission_class(c, TRANSMISSION_RULES), gearbox) == [
        "Manuální", "Manuální", "Automatická", None, "Manuální", None,
    ]
    fuel = ["Benzín + hybrid", "Diesel", "Nafta", "Plug-in Hybrid", "Elektro", "LPG", "Gasoline", None]
    assert evaluate(lambda c: text.fuel_class(c, FUEL_RULES), fuel) == [
        "Benzin", "Nafta", "Nafta", "Hybridni", "Elektro", None, "Benzin", None,
    ]


def test_to_number(evaluate):
    inputs = ["12", " 12 ", "1e5", "+5", ".5", "5.", "-3", "1_000", "1d", "1f", "inf", "nan", "True", "0x1A",
              "1,5", "", "12\xa0", "Cenanadotaz", None, "150000"]
    got = evaluate(numbers.to_number, inputs)
    assert got == [12, 12, 100000, 5, 0.5, 5, -3] + [None] * 12 + [150000]
    finite = pd.to_numeric(pd.Series(inputs, dtype=object), errors="coerce").replace([np.inf], np.nan)
    strict = [i for i, s in enumerate(inputs) if s not in ("True", "nan")]
    assert [got[i] for i in strict] == [None if np.isnan(finite[i]) else finite[i] for i in strict]


def test_litres_like_pandas(evaluate):
    volumes = list(range(400, 9001))
    got = evaluate(lambda c: numbers.litres(c.cast("double")), volumes, "int")
    assert got == (pd.Series(volumes).astype(float) / 1000).round(1).tolist()


def test_strict_number_fails_on_text(evaluate):
    assert evaluate(numbers.strict_number, ["1598", None]) == [1598.0, None]
    try:
        evaluate(numbers.strict_number, ["1598", "unknown"])
    except Exception as fault:
        assert "not a number" in str(fault)
    else:
        raise AssertionError("a text passed as a number")


def test_money_text(evaluate):
    amounts = [1234567.125, 2.675, 0.0, 999.999]
    assert evaluate(numbers.money_text, amounts, "double") == [f"{x:,.2f} Kč" for x in amounts]


def test_number_groups(evaluate):
    assert evaluate(fields.engine_cm3, ["1\xa0968\xa0ccm", "1 598 ccm", "1.6 l", "12 a 999ccm", None]) == [
        "1968", "1598", None, "999", None,
    ]
    assert evaluate(fields.power_kw, ["110\xa0kW", "81kW (110 k)", "110 k", ""]) == ["110", "81", None, None]
    assert evaluate(fields.engine_litres, ["2,0 TDI", "1.6", "3", "TDI"]) == ["2.0", "1.6", "3.0", None]


def test_title_words(evaluate):
    inputs = ["Škoda Octavia 2.0", " Alfa \xa0 Romeo", "Škoda", ""]
    assert evaluate(fields.title_brand, inputs) == ["Škoda", "Alfa", "Škoda", ""]
    assert evaluate(fields.title_model, inputs) == ["Octavia", "Romeo", None, None]
    assert evaluate(fields.before_slash, ["manuální / 6", "automat", "/x"]) == ["manuální", "automat", ""]


def test_url_words(evaluate):
    inputs = ["http://h/detail/alfa-romeo/c4picasso/9", "/detail/skoda/id-3", "/detail/skoda", "/x/skoda/a",
              "/detail/x/detail/y"]
    assert evaluate(fields.url_brand, inputs) == ["Alfa Romeo", "Skoda", None, None, None]
    assert evaluate(fields.url_model, inputs) == ["C4Picasso", "Id 3", None, None, None]


def test_subtitle(evaluate):
    cases = {
        "Ojeté, 5/2018, 150 000 km": ("2018", "150000"),
        "05/2025, 10 km": (None, "10"),
        "2025, 10 km": ("2025", "10"),
        "10 km/h, 2018, 20 km/x, 30 km": ("2018", "20"),
        "5/2018/1, 1999, 2001": ("1999", None),
        "Nové, 5/1900, 2 000 KM, 7 km": (None, "2000"),
        "km, 8 km": (None, "8"),
        "": (None, None),
    }
    got = evaluate(lambda c: fields.subtitle_fields(c, ("Ojeté", "Nové")), list(cases))
    assert [(r.year, r.mileage_km) for r in got] == list(cases.values())


def test_price(evaluate):
    inputs = ["350\xa0000 Kč", "Cena na dotaz", " Kč ", None]
    assert evaluate(fields.price_digits, inputs) == ["350000", "Cenanadotaz", None, None]
    assert evaluate(lambda c: fields.chosen_price(c, F.lit("5 Kč")), inputs) == ["350000", "Cenanadotaz", None, "5"]


def test_absolute_url(evaluate):
    assert evaluate(lambda c: fields.absolute_url(c, "http://b"), ["/x", "http://h/y"]) == ["http://b/x", "http://h/y"]
