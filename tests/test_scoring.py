"""Request checks, the guard on predictions, training, saving and streaming."""

import pytest
from pyspark.sql import functions as F

from forecourt.operators.audit import read_audit, write_audit
from forecourt.operators.encoder import encode, fit_codes, unknown_fields
from forecourt.operators.scoring import guarded, score
from forecourt.operators.training import ModelParams, evaluate, load, save, split, train
from forecourt.schema import CLEAN_SCHEMA, REQUEST, text_schema
from forecourt.streaming.append_stream import score_stream

GOOD = dict(
    brand="Skoda", model="Octavia", fuel="Nafta", transmission="Manualni", volume_l="2.0", mileage_km="150000",
    power_kw="110", age="8",
)
CASES = [
    ({}, "OK"), ({"brand": ""}, "MISSING"), ({"power_kw": ""}, "NOT_NUMERIC"), ({"model": "Fabia"}, "NOT_NUMERIC"),
    ({"mileage_km": "-20000"}, "NEGATIVE"), ({"mileage_km": "600001"}, "OUT_OF_RANGE"), ({"mileage_km": "600000"}, "OK"),
    ({"volume_l": "0.4"}, "OUT_OF_RANGE"), ({"volume_l": "0.5"}, "OK"), ({"volume_l": "8.0"}, "OK"),
    ({"volume_l": "8.1"}, "OUT_OF_RANGE"), ({"power_kw": "19"}, "OUT_OF_RANGE"), ({"power_kw": "20"}, "OK"),
    ({"power_kw": "800"}, "OK"), ({"power_kw": "801"}, "OUT_OF_RANGE"), ({"age": "50"}, "OK"),
    ({"age": "51"}, "OUT_OF_RANGE"), ({"mileage_km": "nan"}, "NOT_NUMERIC"),
    ({"brand": "", "mileage_km": "-1"}, "MISSING"), ({"volume_l": None}, "MISSING"), ({"age": None}, "NOT_NUMERIC"),
]


@pytest.fixture(scope="module")
def clean(spark):
    rows = [
        ("Skoda", "Octavia", 1.0 + i % 9 / 10, 1000.0 * i, 100_000.0 + 1000 * (i % 50), "Nafta", "Manualni", 60.0 + i % 70, i % 20)
        for i in range(200)
    ] + [("Audi", "A6", 3.0, 10.0, 900_000.0, "Benzin", "Automaticka", 200.0, 1)] * 20
    return spark.createDataFrame(rows, CLEAN_SCHEMA)


@pytest.fixture(scope="module")
def model(clean):
    return train(clean, ModelParams(trees=5))


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([[{**GOOD, **change}[c] for c in REQUEST] for change, _ in CASES], text_schema(REQUEST))


def test_status_of_every_request(requests, model):
    rows = score(requests.coalesce(1).withColumn("n", F.monotonically_increasing_id()), model).orderBy("n").collect()
    assert [r.status for r in rows] == [status for _, status in CASES]
    assert [r.unknown for r in rows] == ["model" if change.get("model") == "Fabia" else "" for change, _ in CASES]
    for r in rows:
        ok = r.status == "OK"
        assert ok == (r.price is not None) == (r.price_text is not None) == (r.features is not None)
        if ok:
            assert r.price_text == f"{r.price:,.2f} Kč"
            assert r.raw_features[:4] == [1.0, 1.0, 1.0, 1.0] and r.raw_features[4] == float(r.volume_l)
            assert len(r.features) == 8 and r.features[:4] == r.raw_features[:4]


def test_scoring_needs_no_shuffle(requests, model):
    """Small code tables are broadcast, so requests stay where they are."""
    plan = score(requests, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") >= 4


def test_guard(spark):
    df = spark.createDataFrame([("OK", -1.0), ("OK", 0.0), ("OK", None), ("MISSING", 5.0)], "status string, prediction double")
    assert [(r.status, r.price_text) for r in guarded(df).collect()] == [
        ("NEGATIVE_PREDICTION", None), ("OK", "0.00 Kč"), ("FAILED_PREDICTION", None), ("MISSING", None),
    ]


def test_saved_model_scores_alike(spark, requests, model, tmp_path):
    path = str(tmp_path / "model")
    save(model, path)
    assert score(requests, load(spark, path)).collect() == score(requests, model).collect()


def test_stream_scores_alike(spark, requests, model, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    requests.write.parquet(source)
    stream = spark.readStream.schema(requests.schema).parquet(source)
    score_stream(stream, model, target, str(tmp_path / "offsets")).awaitTermination()
    expected = score(requests, model)
    assert sorted(map(str, read_audit(spark, target, expected.schema).select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_kinds_and_split(clean):
    training, test = split(clean, clean.columns)
    assert training.count() + test.count() == clean.count() and test.count() > 0
    assert split(clean.repartition(5), clean.columns)[0].count() == training.count()
    for kind in ("tree", "forest"):
        errors = evaluate(train(training, ModelParams(kind=kind, trees=10)), test)
        assert set(errors) == {"rmse", "mae", "r2"} and errors["mae"] <= errors["rmse"] < 500_000
    with pytest.raises(ValueError):
        train(clean, ModelParams(kind="line"))


def test_codes_of_many_values(spark):
    """More values than a part holds, unevenly dealt over columns, nulls and no rows."""
    values = [f"v{i * 7919 % 5000:04d}" for i in range(5000)]
    df = spark.createDataFrame([(v, "only", None, v if i < 3 else None) for i, v in enumerate(values)], "a string, b string, c string, d string")
    codes = fit_codes(df.repartition(7), ["a", "b", "c", "d"])
    found = {(r.field, r.value): r.code for r in codes.collect()}
    want = {("a", v): float(i) for i, v in enumerate(sorted(values))} | {("b", "only"): 0.0}
    assert found == want | {("d", v): float(i) for i, v in enumerate(sorted(values[:3]))}
    assert fit_codes(df.limit(0), ["a"]).count() == 0


def test_encode_with_a_hot_and_an_unknown_value(spark):
    codes = fit_codes(spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int"), ["a", "b"])
    df = spark.createDataFrame([("x", 1)] * 50 + [("z", 2), (None, 3), ("", 3)], "a string, b int")
    out = encode(df, codes, ["a", "b"]).withColumn("unknown", unknown_fields(["a", "b"]))
    assert out.columns == ["a", "b", "a_code", "b_code", "unknown"] and out.count() == 53
    assert sorted(map(tuple, out.filter("unknown <> ''").collect()), key=str) == [
        ("", 3, None, None, "b"), ("z", 2, None, 1.0, "a"), (None, 3, None, None, "b"),
    ]


def test_prediction_is_the_mean_of_equal_features(spark):
    rows = [("Skoda", f"m{i % 5}", 1.0 + i % 2, 100.0, 1000.0 * (i % 10) ** 2 + i, "Nafta", "Manualni", 60.0, 3) for i in range(200)]
    clean = spark.createDataFrame(rows, CLEAN_SCHEMA)
    model = train(clean, ModelParams(trees=1, depth=30, step=1.0))
    asked = clean.select(*REQUEST).distinct().withColumns({c: F.col(c).cast("string") for c in ("volume_l", "mileage_km", "power_kw", "age")})
    means = {(r.model, r.volume_l): r.price for r in clean.groupBy("model", "volume_l").agg(F.avg("price").alias("price")).collect()}
    scored = score(asked, model).collect()
    assert len(scored) == 10
    for r in scored:
        assert r.price == pytest.approx(means[r.model, float(r.volume_l)])


def test_failed_predictions_keep_their_features_in_the_audit(spark, clean, requests, tmp_path):
    model = train(clean.withColumn("price", -F.col("price")), ModelParams(trees=1))
    target = str(tmp_path / "audit")
    scored = score(requests, model)
    for batch, rows in ((0, scored), (1, scored.limit(2)), (0, scored)):
        write_audit(rows, target, batch, "w")
    audit = read_audit(spark, target, scored.schema)
    assert audit.filter("batch_id = 0").count() == len(CASES) and audit.filter("batch_id = 1").count() == 2
    negative = audit.filter("status = 'NEGATIVE_PREDICTION' and batch_id = 0").collect()
    assert len(negative) == sum(status == "OK" for _, status in CASES)
    assert all(r.price is None and len(r.raw_features) == 8 and len(r.features) == 8 for r in negative)
    refused = audit.filter("status not in ('OK', 'NEGATIVE_PREDICTION')").collect()
    assert refused and all(r.raw_features is None for r in refused)
