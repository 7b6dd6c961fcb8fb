"""Checks on scoring requests and predictions, and the scored table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.numbers import money_text, to_number
from forecourt.operators.encoder import encode, unknown_fields
from forecourt.operators.training import PriceModel
from forecourt.params import RequestRules
from forecourt.schema import REQUEST_NUMBERS, TEXT_COLUMNS

OK, MISSING, NOT_NUMERIC = "OK", "MISSING", "NOT_NUMERIC"
NEGATIVE, OUT_OF_RANGE = "NEGATIVE", "OUT_OF_RANGE"
NEGATIVE_PREDICTION, FAILED_PREDICTION = "NEGATIVE_PREDICTION", "FAILED_PREDICTION"


def with_request_numbers(requests: DataFrame) -> DataFrame:
    """Add the numbers of the four text fields as `<field>_num`; null where a text is no number."""
    return requests.withColumns({f"{c}_num": to_number(F.col(c).cast("string")) for c in REQUEST_NUMBERS})


def request_status(rules: RequestRules = RequestRules(), known: Column | None = None) -> Column:
    """The first failed check of a request with its numbers, or OK.

    `known` says whether all categories are known to the model.
    """
    volume, mileage, power, age = (F.col(f"{c}_num") for c in REQUEST_NUMBERS)
    empty = F.lit(False)
    for c in [*TEXT_COLUMNS, "volume_l"]:
        empty = empty | F.col(c).isNull() | (F.col(c).cast("string") == "")
    unreadable = volume.isNull() | mileage.isNull() | power.isNull() | age.isNull()
    if known is not None:
        unreadable = unreadable | ~known
    return (
        F.when(empty, MISSING)
        .when(unreadable, NOT_NUMERIC)
        .when((volume < 0) | (mileage < 0) | (power < 0) | (age < 0), NEGATIVE)
        .when(
            (mileage > rules.max_mileage)
            | ~volume.between(*rules.volume)
            | ~power.between(*rules.power)
            | (age > rules.max_age),
            OUT_OF_RANGE,
        )
        .otherwise(OK)
    )


def guarded(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Keep a prediction only for an OK request, and only if it is a number from 0 up.

    Sets `status`, `price` and `price_text`.
    """
    value = F.col(prediction)
    status = F.when(F.col("status") != OK, F.col("status")).otherwise(
        F.when(value.isNull() | F.isnan(value), FAILED_PREDICTION)
        .when(value < 0, NEGATIVE_PREDICTION)
        .otherwise(OK)
    )
    price = F.when(F.col("status") == OK, value)
    return df.withColumn("status", status).withColumn("price", price).withColumn(
        "price_text", money_text(F.col("price"))
    )


def check_requests(requests: DataFrame, codes: DataFrame, rules: RequestRules = RequestRules()) -> DataFrame:
    """Add numbers, codes, `unknown` (the fields whose category has no code) and `status`.

    Categories are looked up in the code table by joins, so it may have any size. An unknown
    category counts like a number that cannot be read.
    """
    coded = encode(with_request_numbers(requests), codes, TEXT_COLUMNS)
    return _with_status(coded, rules)


def _with_status(coded: DataFrame, rules: RequestRules) -> DataFrame:
    named = coded.withColumn("unknown", unknown_fields(TEXT_COLUMNS))
    return named.withColumn("status", request_status(rules, F.col("unknown") == ""))


def score(requests: DataFrame, model: PriceModel, rules: RequestRules = RequestRules()) -> DataFrame:
    """Requests with status, unknown categories, price, price text and features before and after scaling.

    Works on a streaming table of requests as well. The feature columns are null unless the request
    passed its checks; they stay when the prediction failed or was negative, so that the audit shows
    what the model saw.
    """
    kept = [c for c in requests.columns if c not in ("status", "unknown", "raw_features", "features", "price", "price_text")]
    predicted = _with_status(model.transform(with_request_numbers(requests.select(*kept))), rules)
    passed = F.col("status") == OK
    shown = predicted.withColumns({
        name: F.when(passed, vector_to_array(name)) for name in ("raw_features", "features")
    })
    return guarded(shown).select(*kept, "status", "unknown", "raw_features", "features", "price", "price_text")
