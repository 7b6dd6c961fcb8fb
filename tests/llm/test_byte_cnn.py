"""The byte network against plain loops, finite differences and held-out rows."""

import os
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forecourt.llm.byte_cnn import (
    PAD, QualityRules, _Network, features, held_out_of, probabilities, score_quality, train_quality_model,
)
from forecourt.llm.op13 import op13_quality

SF_DIR = "/root/testdata/sf0.01"
SMALL = QualityRules(width=3, filters=4, hidden=3, size=5, half_chunk=8, epochs=3)


def plain_features(model, text):
    """Every window of every chunk, one after the other."""
    half, size = model.half_chunk, model.bytes.shape[1]
    width = len(model.filters) // size
    symbols = [PAD] * (width - 1) + list((text or "").encode())
    symbols += [PAD] * (-len(symbols) % half or (half if not symbols else 0))
    n = len(symbols)
    symbols += [PAD] * (width - 1)
    said = np.array([model.bytes[symbols[t : t + width]].ravel() @ model.filters for t in range(n)]) + model.filter_bias
    starts = range(0, n - half, half) if n > half else [0]
    chunks = np.array([said[s : s + 2 * half].max(axis=0) for s in starts])
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)])


def test_features_are_those_of_all_chunks_of_whole_texts():
    model = _Network(SMALL, 0.3).model()
    model = replace(model, filter_bias=np.arange(4, dtype=np.float32))
    texts = ["", "a", "abcdef", "abcdefg", "x" * 100, "éà ü" * 40, "end at a border."[:14], None, "late " * 500 + "!"]
    found = features(model, pa.array(texts, pa.string()))
    assert np.allclose(found, [plain_features(model, t) for t in texts], atol=1e-5)
    again = np.concatenate([probabilities(model, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(again, probabilities(model, pa.array(texts, pa.string())), atol=1e-6)


def test_slopes_are_finite_differences():
    network = _Network(SMALL, 0.2)
    network.filter_bias += np.array([0.1, -0.2, 0.3, 0], np.float32)
    texts = pa.array(["abc abc def", "some longer text with several chunks in it", "x"], pa.string())
    target = np.array([1, 0, 1], np.float32)

    def loss():
        p = probabilities(network.model(), texts)
        return -np.log(np.where(target == 1, p, 1 - p)).mean()

    slopes = network.slopes(texts, target)
    for name in ("layer", "hidden", "hidden_bias", "filters", "filter_bias"):
        value = getattr(network, name)
        for at in np.ndindex(*value.shape):
            if sum(at) % 7 == 0:
                old = value[at]
                value[at] = old + 1e-2
                high = loss()
                value[at] = old - 1e-2
                low = loss()
                value[at] = old
                assert abs((high - low) / 2e-2 - slopes[name][at]) < 5e-3, (name, at)
    row = ord("e")
    numeric = []
    for e in range(SMALL.size):
        old = network.bytes[row, e]
        network.bytes[row, e] = old + 1e-2
        high = loss()
        network.bytes[row, e] = old - 1e-2
        numeric.append((high - loss()) / 2e-2)
        network.bytes[row, e] = old
    assert np.allclose(numeric, slopes["bytes"][row], atol=5e-3)


def test_learns_what_only_the_end_of_a_long_text_shows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        text = " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(rng.integers(5, 60)))
        rows.append((i, text + (" #### $$" if i % 4 == 0 else " end"), int(i % 4 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = held_out_of(docs).filter("not held_out").select("doc_id", "quality")
    model = train_quality_model(docs.drop("quality"), labels, QualityRules(half_chunk=32, epochs=12))
    scored = score_quality(held_out_of(docs), model, ("doc_id", "held_out", "quality"))
    out = scored.filter("held_out").collect()
    assert len(out) > 50 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_awkward_rows_and_labels(spark):
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "no id"), (4, "very long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_read", F.lit(1)).withColumn("quality", F.lit(9))
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1), (7, 1), (1, 5)], "doc_id long, quality int")
    for known, want in ((labels.limit(0), 0.5), (labels, None)):
        model = train_quality_model(docs, known, SMALL)
        out = score_quality(docs, model, ("doc_id", "score")).collect()
        assert len(out) == 6 and out[0].asDict().keys() == {"doc_id", "score", "predicted"}
        assert all(0 <= r["score"] <= 1 for r in out) and (want is None or all(r["score"] == want for r in out))
        assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    both = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    assert score_quality(docs.limit(0), train_quality_model(docs, both, SMALL)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_query_on_held_out_rows(spark):
    out = op13_quality(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    assert out.count() == 1000 and out.columns == ["doc_id", "held_out", "score", "predicted"]
    held = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(held) > 40 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
