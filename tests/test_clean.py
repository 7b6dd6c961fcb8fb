"""The cleaning job on 19 listings with known fates, and its properties."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from forecourt.params import CleanRules
from forecourt.plans.build import build_clean, merge_sources, run_build
from forecourt.plans.clean import clean_listings
from forecourt.schema import CLEAN, CLEAN_SCHEMA, MERGED, RAW_A, RAW_B, text_schema
from forecourt.sources.tables import null_tokens_to_null, write_csv

RULES = CleanRules(as_of_year=2026)
A, B = "Autoesa", "Sauto"
MERGED_ROWS = [
    ("Škoda", "Octavia", "2.0", "2018", "150000", "350000", "Nafta", "manuální", "110", A),
    ("Škoda", "Octavia", "2.0", "2018", "150000", "350000", "Nafta", "manuální", "110", A),
    ("Škoda", "Octavia", "2.0", "2018", "150000", "350000", "Nafta", "manuální", "110", B),
    ("ŠKODA", "octavia", "2.0", "2018", "150000", "350000", "Diesel", "Manuální", "110", A),
    ("Mercedes-Benz", "C-Max 2", "1.5", "2019", "0", "29999", "Benzín", "Automatická", "90", B),
    ("Mercedes Benz", "X-Trail", "1.5", "2019", "-5", "30000", "Benzín + hybrid", "automat", "90", B),
    ("BMW", "Řada", "2.0", "2020", "600000", "2500000", "Nafta", "Automatická", "800", A),
    ("Audi", "Řada", "8.0", "1970", "600000", "2500000", "Elektro", "poloautomat", "800", A),
    ("Seat", "Ibiza", "1.2", "2026", "100", "200000", "Benzin", "manuál", "60", B),
    ("Seat", "Ibiza", "1.2", "2015", "600001", "200000", "Benzin", "manuál", "60", B),
    ("Seat", "Ibiza", "1.2", "2015", None, "200000", "Benzin", "manuál", "60", B),
    ("Seat", "Ibiza", "1.2", "2015", "100", "Cenanadotaz", "Benzin", "manuál", "60", B),
    ("Seat", "Ostatní", "1.2", "2015", "100", "200000", "Benzin", "manuál", "60", B),
    ("Seat", "Ibiza", "1.2", "2015", "100", "200000", "LPG", "manuál", "60", B),
    ("Alfa Romeo", "c4picasso", "1.2", "2015", "100", "200000", "Plug-in Hybrid", "CVT", "60", B),
    ("Forthing", "4ever t5", "0.5", "2025", "100", "200000", "Plug-in Hybrid", "Automatická (manuální režim)", "20", B),
    ("Land-Rover", "NA", "3.0", "2020", "100", "900000", "Nafta", "Automat", "200", B),
    ("Seat", "Leon", "8.1", "2015", "100", "200000", "Benzin", "manuál", "60", B),
    ("Seat", "Leon", "1.4", "2015", "100", "200000", "Benzin", "manuál", "19", B),
]
OCTAVIA = ("Skoda", "Octavia", 2.0, 150000.0, 350000.0, "Nafta", "Manualni", 110.0, 8)
EXPECTED = sorted([
    OCTAVIA, OCTAVIA, OCTAVIA,
    ("Mercedesbenz", "Xtrail", 1.5, -5.0, 30000.0, "Benzin", "Automaticka", 90.0, 7),
    ("Audi", "Rada", 8.0, 600000.0, 2500000.0, "Elektro", "Automaticka", 800.0, 56),
    ("Ford", "4Evert5", 0.5, 100.0, 200000.0, "Hybridni", "Manualni", 20.0, 1),
])


@pytest.fixture(scope="module")
def merged(spark):
    return null_tokens_to_null(spark.createDataFrame(MERGED_ROWS, text_schema(MERGED)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_rows(merged):
    clean = clean_listings(merged, RULES)
    assert clean.schema.simpleString() == CLEAN_SCHEMA.simpleString()
    assert rows(clean) == EXPECTED


def test_result_does_not_depend_on_partitions(merged):
    assert rows(clean_listings(merged.repartition(7), RULES)) == EXPECTED


def test_dedup_after(merged):
    assert rows(clean_listings(merged, replace(RULES, dedup_after=True))) == sorted(set(EXPECTED))


def test_source_column_is_optional(merged):
    assert len(rows(clean_listings(merged.drop("source"), RULES))) == len(EXPECTED) - 1


def test_current_year_is_the_default(spark, merged):
    this_year = spark.sql("select year(current_date())").first()[0]
    age = clean_listings(merged, CleanRules()).filter(F.col("brand") == "Ford").first()["age"]
    assert age == this_year - 2025


def test_one_shuffle(merged):
    plan = clean_listings(merged, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan


def source_rows(spark):
    a = spark.createDataFrame([r[:9] for r in MERGED_ROWS if r[9] == A], text_schema(RAW_A))
    b = spark.createDataFrame(
        [(*r[:2], str(int(float(r[2]) * 1000)), *r[3:9]) for r in MERGED_ROWS if r[9] == B], text_schema(RAW_B)
    )
    return a, b


def test_merge_converts_and_tags(spark, merged):
    a, b = source_rows(spark)
    both = merge_sources(a, null_tokens_to_null(b))
    assert both.columns == MERGED
    key = lambda r: [str(v) for v in r]
    assert sorted(map(tuple, both.collect()), key=key) == sorted(map(tuple, merged.collect()), key=key)
    assert rows(build_clean(a, null_tokens_to_null(b), RULES)) == EXPECTED


def test_build_from_csv(spark, tmp_path):
    a, b = source_rows(spark)
    paths = {n: str(tmp_path / n) for n in ("a", "b", "merged", "clean", "export")}
    write_csv(a, paths["a"])
    write_csv(b, paths["b"])
    counts = run_build(spark, paths["a"], paths["b"], paths["merged"], paths["clean"], RULES, paths["export"])
    assert counts == {"a": 5, "b": 14, "clean": 6}
    clean = spark.read.parquet(paths["clean"])
    assert clean.columns == CLEAN and rows(clean) == EXPECTED
    export = spark.read.option("header", True).csv(paths["export"])
    assert export.columns[0] == "Značka" and export.columns[-1] == "Stari"
    prices = [float(r["Cena"]) for r in export.collect()]
    assert prices == sorted(prices)
