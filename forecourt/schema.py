"""Column names, table schemas and the fixed values every stage shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Export header of each column, in the listing order.
HEADERS = {
    "URL": "url",
    "Značka": "brand",
    "Model": "model",
    "Objem (l)": "volume_l",
    "Objem (cm³)": "volume_cm3",
    "Rok": "year",
    "Najeté km": "mileage_km",
    "Cena": "price",
    "Palivo": "fuel",
    "Převodovka": "transmission",
    "Výkon (kW)": "power_kw",
    "Zdroj": "source",
    "Stari": "age",
}

# Fixed value: text that marks a field the page did not show.
NOT_FOUND = "Nezjištěno"

# Texts a CSV reader takes for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Provenance tags of the two sources.
SOURCE_A = "Autoesa"
SOURCE_B = "Sauto"

RAW_A = ["brand", "model", "volume_l", "year", "mileage_km", "price", "fuel", "transmission", "power_kw"]
RAW_B = ["brand", "model", "volume_cm3", "year", "mileage_km", "price", "fuel", "transmission", "power_kw"]
MERGED = [*RAW_A, "source"]
TEXT_COLUMNS = ["brand", "model", "fuel", "transmission"]
NUMERIC_COLUMNS = ["year", "mileage_km", "price", "power_kw", "volume_l"]
REQUEST_NUMBERS = ["volume_l", "mileage_km", "power_kw", "age"]
REQUEST = [*TEXT_COLUMNS, *REQUEST_NUMBERS]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


CLEAN_SCHEMA = T.StructType([
    T.StructField("brand", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("volume_l", T.DoubleType()),
    T.StructField("mileage_km", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("fuel", T.StringType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("power_kw", T.DoubleType()),
    T.StructField("age", T.IntegerType()),
])
CLEAN = CLEAN_SCHEMA.fieldNames()
