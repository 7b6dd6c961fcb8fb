"""Request checks, encoding, scaling, training and scoring on the driver's tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from forecourt.operators.audit import read_audit, write_audit
from forecourt.operators.encoder import encode, fit_codes
from forecourt.operators.scoring import check_requests, guarded, score
from forecourt.operators.training import CODES, NUMBERS, ModelParams, evaluate, load, save, scaler, split, train
from forecourt.params import CleanRules
from forecourt.plans.clean import clean_listings
from forecourt.queries import sql
from forecourt.queries.listings import SALES_RULES, sales
from forecourt.queries.registry import query, table
from forecourt.schema import CLEAN, REQUEST_NUMBERS, TEXT_COLUMNS
from forecourt.session import scratch_path

_REQUEST = {
    "brand": "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '' ELSE l_returnflag END",
    "model": "CASE WHEN l_tax > 0 THEN l_linestatus END",
    "fuel": "CASE WHEN l_quantity < 25 THEN concat('F', CAST(l_quantity AS INTEGER) % 6) ELSE 'Nafta' END",
    "transmission": "CASE WHEN l_suppkey % 2 = 0 THEN concat('T', l_suppkey % 5) ELSE 'Manualni' END",
    "volume_l": "CASE WHEN l_linenumber = 7 THEN '' ELSE concat(CAST(l_linenumber AS {text}), '.5') END",
    "mileage_km": "CASE WHEN l_discount = 0.1 THEN 'nan' ELSE CAST(CAST(l_extendedprice * 10 AS BIGINT) - 20000 AS {text}) END",
    "power_kw": "CASE WHEN l_discount = 0.09 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) * 18 AS {text}) END",
    "age": "CAST(2046 - year(l_shipdate) AS {text})",
}


def _requests(spark, sf_dir, which: str = "true") -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(which).select(
        "l_orderkey", "l_linenumber", *[F.expr(e.format(text="STRING")).alias(c) for c, e in _REQUEST.items()]
    )


_REQUEST_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{e.format(text='VARCHAR')} AS {c}" for c, e in _REQUEST.items()
) + " FROM lineitem"


# What the model knows: the categories of some lines only.
_KNOWN = "CAST(l_quantity AS INTEGER) % 6 <> 5 AND l_suppkey % 5 <> 3"


def _unknown_sql(column: str) -> str:
    known = f"SELECT {column} FROM ({_REQUEST_SQL} WHERE {_KNOWN}) WHERE {column} IS NOT NULL"
    return f"CASE WHEN {column} <> '' AND {column} NOT IN ({known}) THEN '{column}' END"


@query(f"""
WITH numbered AS (
  SELECT *, {", ".join(f"{sql.number(c)} AS {c}_num" for c in REQUEST_NUMBERS)},
         concat_ws(',', {", ".join(map(_unknown_sql, TEXT_COLUMNS))}) AS unknown
  FROM ({_REQUEST_SQL}))
SELECT l_orderkey, l_linenumber, unknown,
  CASE WHEN {" OR ".join(f"coalesce({c}, '') = ''" for c in [*TEXT_COLUMNS, "volume_l"])} THEN 'MISSING'
       WHEN unknown <> '' OR {" OR ".join(f"{c}_num IS NULL" for c in REQUEST_NUMBERS)} THEN 'NOT_NUMERIC'
       WHEN {" OR ".join(f"{c}_num < 0" for c in REQUEST_NUMBERS)} THEN 'NEGATIVE'
       WHEN mileage_km_num > 600000 OR volume_l_num NOT BETWEEN 0.5 AND 8 OR power_kw_num NOT BETWEEN 20 AND 800
            OR age_num > 50 THEN 'OUT_OF_RANGE'
       ELSE 'OK' END AS status
FROM numbered
""")
def checked_requests(spark, sf_dir):
    """The first failed check of every request, and the fields whose category the code table lacks."""
    requests = _requests(spark, sf_dir)
    codes = fit_codes(_requests(spark, sf_dir, _KNOWN), TEXT_COLUMNS)
    return check_requests(requests, codes).select("l_orderkey", "l_linenumber", "unknown", "status")


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'MISSING' WHEN c_mktsegment = 'MACHINERY' THEN 'FAILED_PREDICTION'
            WHEN c_acctbal < 0 THEN 'NEGATIVE_PREDICTION' ELSE 'OK' END AS status,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 THEN c_acctbal END AS price,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0
            THEN format('{:,.2f}', c_acctbal) || ' Kč' END AS price_text
FROM customer
""")
def guarded_predictions(spark, sf_dir):
    """Balances as predictions: negative and failed ones lose their price."""
    predicted = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "MISSING").otherwise("OK").alias("status"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("prediction"),
    )
    return guarded(predicted).drop("prediction")


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("model"),
        F.col("p_type").alias("fuel"),
        F.concat("p_type", F.lit(" "), "p_brand").alias("transmission"),
        (F.col("p_size") / 10).alias("volume_l"),
        F.col("p_partkey").cast("double").alias("mileage_km"),
        F.col("p_retailprice").alias("power_kw"),
        F.col("p_size").cast("double").alias("age"),
    )


@query("SELECT p_partkey, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {source}) - 1 AS DOUBLE) AS {code}"
    for source, code in zip(["p_brand", "p_name", "p_type", "p_type || ' ' || p_brand"], CODES)
) + " FROM part")
def label_codes(spark, sf_dir):
    """Category columns to codes by alphabet, out of a code table."""
    parts = _parts(spark, sf_dir)
    return encode(parts, fit_codes(parts, TEXT_COLUMNS), TEXT_COLUMNS).select("p_partkey", *CODES)


@query("SELECT p_partkey, " + ", ".join(
    f"round(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER (), 6) AS {c}"
    for c, x in zip(REQUEST_NUMBERS, ["p_size / 10", "CAST(p_partkey AS DOUBLE)", "p_retailprice", "CAST(p_size AS DOUBLE)"])
) + " FROM part")
def scaled_numbers(spark, sf_dir):
    """Numbers with mean 0 and sample deviation 1, to six decimals."""
    numbered = _parts(spark, sf_dir).withColumns({f"{c}_num": F.col(c) for c in REQUEST_NUMBERS})
    scaled = Pipeline(stages=scaler()).fit(numbered).transform(numbered)
    values = vector_to_array("scaled_numbers")
    return scaled.select(
        "p_partkey", *[F.round(values[i], 6).alias(c) for i, c in enumerate(REQUEST_NUMBERS)]
    )


def _clean_table(spark, sf_dir) -> DataFrame:
    """The clean sales as a written table, so that the passes of training do not clean again."""
    path = scratch_path(spark, "clean")
    rules = CleanRules(**{**SALES_RULES.__dict__, "power": (1, 800)})
    clean_listings(sales(spark, sf_dir), rules).write.parquet(path)
    return spark.read.parquet(path)


# Lines as listings with a few dozen different features each of which many lines share: the mean
# price of the lines with a request's features is what a deep tree must predict for it.
_LISTING = {
    "brand": "l_returnflag", "model": "l_linestatus", "fuel": "concat('F', CAST(l_quantity AS INTEGER) % 6)", "transmission": "concat('T', l_suppkey % 5)",
    "volume_l": "CAST(l_linenumber % 2 + 1 AS DOUBLE)", "mileage_km": "100000.0D", "power_kw": "90.0D", "age": "5",
    "price": "CAST(l_extendedprice AS DOUBLE)",
}
_GROUP = "l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) % 6, l_suppkey % 5, l_linenumber % 2"


def _lines(spark, sf_dir) -> DataFrame:
    listing = [F.expr(e).alias(c) for c, e in _LISTING.items()]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), *listing)


def _loaded_model(spark, sf_dir):
    """One round of boosting, of step 1, with trees as deep as may be; saved and loaded."""
    path = scratch_path(spark, "model")
    save(train(_lines(spark, sf_dir), ModelParams(trees=1, depth=30, step=1.0)), path)
    return load(spark, path)


# Means of cents often end in half a cent; this far off, no rounding hangs on the order of a sum.
_OFF = 0.001234567


def _code(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS DOUBLE)"


_ANSWER = f"""
SELECT l_orderkey, l_linenumber, l_shipdate, 'OK' AS status,
       {_code("l_returnflag")} AS brand_code, {_code("l_linestatus")} AS model_code, {_code("CAST(l_quantity AS INTEGER) % 6")} AS fuel_code,
       {_code("l_suppkey % 5")} AS transmission_code, CAST(l_linenumber % 2 + 1 AS DOUBLE) AS volume_l_num,
       100000.0::DOUBLE AS mileage_km_num, 90.0::DOUBLE AS power_kw_num, 5.0::DOUBLE AS age_num,
       round(avg(CAST(l_extendedprice AS DOUBLE)) OVER (PARTITION BY {_GROUP}) - {_OFF}, 2) AS price
FROM lineitem
"""


def _shown() -> list:
    raw = [F.col("raw_features")[i].alias(name) for i, name in enumerate([*CODES, *NUMBERS])]
    return ["l_orderkey", "l_linenumber", "status", *raw, F.round(F.col("price") - _OFF, 2).alias("price")]


@query(f"SELECT * EXCLUDE (l_shipdate) FROM ({_ANSWER})")
def train_and_score(spark, sf_dir):
    """A model trained on all lines, saved, loaded, and applied to all of them as requests."""
    requests = _lines(spark, sf_dir).drop("price").withColumns({c: F.col(c).cast("string") for c in REQUEST_NUMBERS})
    return score(requests, _loaded_model(spark, sf_dir)).select(*_shown())


@query(f"""
WITH sent AS (SELECT *, year(l_shipdate) % 2 AS batch_id, l_linenumber = 7 AS bad FROM ({_ANSWER}))
SELECT l_orderkey, l_linenumber, batch_id, CASE WHEN bad THEN 'NOT_NUMERIC' ELSE status END AS status,
       CASE WHEN bad THEN 'fuel' ELSE '' END AS unknown, CASE WHEN NOT bad THEN price END AS price,
       CASE WHEN NOT bad THEN fuel_code END AS fuel_code
FROM sent
""")
def scoring_audit(spark, sf_dir):
    """Two batches of requests audited; the first is sent again and replaces its rows. Bad ones stay."""
    model, target = _loaded_model(spark, sf_dir), scratch_path(spark, "audit")
    requests = _lines(spark, sf_dir).drop("price").withColumns({
        **{c: F.col(c).cast("string") for c in REQUEST_NUMBERS},
        "fuel": F.when(F.col("l_linenumber") == 7, "steam").otherwise(F.col("fuel")),
    })
    for batch in (0, 1, 0):
        scored = score(requests.filter(F.col("year") % 2 == batch).drop("year"), model)
        write_audit(scored, target, batch, "requests")
    audit = read_audit(spark, target, scored.schema)
    return audit.select(
        "l_orderkey", "l_linenumber", "batch_id", "status", "unknown", F.round(F.col("price") - _OFF, 2).alias("price"),
        F.col("raw_features")[2].alias("fuel_code"),
    )


@query()
def compare_models(spark, sf_dir):
    """Errors on held-out listings of the three model kinds."""
    training, test = split(_clean_table(spark, sf_dir), CLEAN)
    results = [
        (kind, evaluate(train(training, ModelParams(kind=kind, trees=10, depth=5)), test))
        for kind in ("tree", "forest", "boosting")
    ]
    return spark.createDataFrame(
        [(kind, m["rmse"], m["mae"], m["r2"]) for kind, m in results], "kind string, rmse double, mae double, r2 double"
    )
