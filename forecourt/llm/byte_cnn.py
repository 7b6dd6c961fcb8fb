"""A byte-level convolutional network in numpy that scores whole documents.

Bytes have embeddings, learned filters run over every position, and each filter's largest answer in
a chunk is kept. Chunks overlap by half and cover the whole text. A text's features are the mean, the
largest and the least of its chunks' answers; a hidden layer and a logistic one make one probability.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A

PAD = 256  # the symbol that fills a text up to whole half-chunks


@dataclass(frozen=True)
class QualityRules:
    sample_rows: int = 4000  # labelled rows the network is fitted on, at most
    sample_chars: int = 20_000  # longer texts are not drawn for fitting
    width: int = 7  # bytes under a filter
    filters: int = 24
    hidden: int = 16
    size: int = 8  # of a byte's embedding
    half_chunk: int = 128  # positions; a chunk is two of them
    epochs: int = 8
    least_steps: int = 700  # of the descent; small samples are passed over more often
    batch: int = 32
    rate: float = 0.004
    held_back: int = 5  # every so many-th row of the sample is left for the bias of the probability
    seed: int = 13


@dataclass(frozen=True)
class QualityModel:
    bytes: np.ndarray  # (257, size): the embeddings
    filters: np.ndarray  # (width * size, filters)
    filter_bias: np.ndarray
    hidden: np.ndarray  # (3 * filters, hidden): of the mean, the largest and the least answers
    hidden_bias: np.ndarray
    layer: np.ndarray  # (hidden,)
    bias: float
    half_chunk: int


def padded(texts: pa.Array, half: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols, the half-chunks of each text); a text has one half-chunk at least.

    Each text begins at a half-chunk with as much PAD as a filter is wide, so that no filter sees
    two texts; PAD fills its last half-chunk and closes the array.
    """
    data, offsets = A.utf8(texts)
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-(sizes + width - 1) // half))
    starts = (np.cumsum(halves) - halves) * half + width - 1
    out = np.full(int(halves.sum()) * half + width - 1, PAD, np.int16)
    out[np.repeat(starts - offsets[:-1], sizes) + np.arange(len(data))] = data
    return out, halves


def _answers(bytes_: np.ndarray, filters: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """(positions, filters): what each filter says at each position that it fits at."""
    size = bytes_.shape[1]
    width = len(filters) // size
    seen = bytes_[symbols]
    n = len(symbols) - width + 1
    windows = np.lib.stride_tricks.as_strided(seen, (n, width * size), seen.strides)
    return np.ascontiguousarray(windows) @ filters


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first and second half of each chunk, chunks of each text); one half alone is a chunk."""
    n = np.maximum(1, halves - 1)
    first = np.cumsum(halves) - halves
    low = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = np.repeat(first + halves - 1, n)
    return np.stack([low, np.minimum(low + 1, last)]), n


def features(model: QualityModel, texts: pa.Array) -> np.ndarray:
    """(texts, 3 * filters): the mean, largest and least answers of the chunks of each whole text."""
    half, width = model.half_chunk, len(model.filters) // model.bytes.shape[1]
    symbols, halves = padded(texts, half, width)
    best = np.empty((int(halves.sum()), len(model.filter_bias)), np.float32)
    step = max(1, (1 << 14) // half)  # half-chunks whose answers are held at once
    for low in range(0, len(best), step):
        answer = _answers(model.bytes, model.filters, symbols[low * half : (low + step) * half + width - 1])
        best[low : low + step] = answer.reshape(-1, half, answer.shape[1]).max(axis=1)
    best += model.filter_bias
    (one, two), n = _chunks(halves)
    pooled = np.maximum(best[one], best[two])
    starts = np.cumsum(n) - n
    mean = np.add.reduceat(pooled, starts, axis=0, dtype=np.float64) / n[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, starts, axis=0), np.minimum.reduceat(pooled, starts, axis=0)], axis=1)


def logits(model: QualityModel, texts: pa.Array) -> np.ndarray:
    return np.tanh(features(model, texts) @ model.hidden + model.hidden_bias) @ model.layer


def probabilities(model: QualityModel, texts: pa.Array) -> np.ndarray:
    return _sigmoid(logits(model, texts) + model.bias) if len(texts) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.state = rate, 0, {}

    def __call__(self, name: str, value: np.ndarray, slope: np.ndarray, fade: float) -> None:
        first, second = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        first += 0.1 * (slope - first)
        second += 0.01 * (slope * slope - second)
        known = 1 - 0.9**self.step, 1 - 0.99**self.step
        value -= self.rate * fade * (first / known[0]) / (np.sqrt(second / known[1]) + 1e-8)


class _Network:
    """The parameters while they are learned."""

    def __init__(self, rules: QualityRules, prior: float):
        random = np.random.default_rng(rules.seed)

        def drawn(spread: float, *shape: int) -> np.ndarray:
            return random.normal(0, spread, shape).astype(np.float32)

        self.rules = rules
        self.bytes = drawn(0.5, PAD + 1, rules.size)
        self.bytes[PAD] = 0
        self.filters = drawn(0.15, rules.width * rules.size, rules.filters)
        self.filter_bias = np.zeros(rules.filters, np.float32)
        self.hidden = drawn(0.5 * (3 * rules.filters) ** -0.5, 3 * rules.filters, rules.hidden)
        self.hidden_bias = np.zeros(rules.hidden, np.float32)
        self.layer = drawn(rules.hidden**-0.5, rules.hidden)
        self.bias = np.array([prior], np.float32)

    def model(self) -> QualityModel:
        return QualityModel(
            self.bytes, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.layer, float(self.bias[0]), self.rules.half_chunk
        )

    def slopes(self, texts: pa.Array, target: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean cross entropy; only the places of largest answers have one."""
        rules = self.rules
        half, width, n_filters = rules.half_chunk, rules.width, rules.filters
        symbols, halves = padded(texts, half, width)
        answer = _answers(self.bytes, self.filters, symbols).reshape(-1, half, n_filters)
        where = answer.argmax(axis=1)
        best = np.take_along_axis(answer, where[:, None, :], axis=1)[:, 0] + self.filter_bias
        where += (np.arange(len(where)) * half)[:, None]
        (one, two), n = _chunks(halves)
        second = best[two] > best[one]
        pooled, at = np.where(second, best[two], best[one]), np.where(second, where[two], where[one])
        starts, own = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        mean = np.add.reduceat(pooled, starts, axis=0) / n[:, None].astype(np.float32)
        most, least = np.maximum.reduceat(pooled, starts, axis=0), np.minimum.reduceat(pooled, starts, axis=0)
        seen = np.concatenate([mean, most, least], axis=1)
        inner = np.tanh(seen @ self.hidden + self.hidden_bias)
        error = ((_sigmoid(inner @ self.layer + self.bias[0]) - target) / len(target)).astype(np.float32)
        d_inner = error[:, None] * self.layer * (1 - inner * inner)
        d_mean, d_most, d_least = np.split(d_inner @ self.hidden.T, 3, axis=1)
        slope = d_mean[own] / n[own, None]
        for edge, d_edge in ((most, d_most), (least, d_least)):
            hit = pooled == edge[own]
            slope += d_edge[own] * hit / np.add.reduceat(hit.astype(np.float32), starts, axis=0)[own]
        slope = slope.astype(np.float32)
        under = symbols[at[:, :, None] + np.arange(width)].astype(np.int64)  # (chunks, filters, width)
        filters = self.filters.reshape(width, rules.size, n_filters)
        d_filters = np.stack([slope[:, f] @ self.bytes[under[:, f]].reshape(len(slope), -1) for f in range(n_filters)], axis=1)
        flat = under.ravel()
        spread = (slope[:, :, None, None] * filters.transpose(2, 0, 1)[None]).reshape(-1, rules.size)
        d_bytes = np.stack([np.bincount(flat, spread[:, e], PAD + 1) for e in range(rules.size)], axis=1).astype(np.float32)
        d_bytes[PAD] = 0
        return {
            "bytes": d_bytes, "filters": d_filters, "filter_bias": slope.sum(axis=0), "hidden": seen.T @ d_inner,
            "hidden_bias": d_inner.sum(axis=0), "layer": inner.T @ error, "bias": np.array([error.sum()], np.float32),
        }


def _fit(texts: list[str], labels: np.ndarray, rules: QualityRules) -> QualityModel:
    back = np.arange(len(texts)) % rules.held_back == rules.held_back - 1
    fit = np.flatnonzero(~back)
    share = (labels[fit].sum() + 1) / (len(fit) + 2)
    network, random = _Network(rules, float(np.log(share / (1 - share)))), np.random.default_rng(rules.seed)
    move = _Adam(rules.rate)
    a_pass = max(1, -(-len(fit) // rules.batch))
    epochs = max(rules.epochs, -(-rules.least_steps // a_pass))
    steps = epochs * a_pass
    for _ in range(epochs):
        order = random.permutation(fit)
        for low in range(0, len(order), rules.batch):
            some = order[low : low + rules.batch]
            move.step += 1
            fade = 1 - (move.step - 1) / steps
            slopes = network.slopes(pa.array([texts[i] for i in some], pa.string()), labels[some])
            for name, slope in slopes.items():
                move(name, getattr(network, name), slope, fade)
    model = network.model()
    held = np.flatnonzero(back)
    if not len(held):
        return model
    # The bias for which the mean probability of rows the descent did not see is their share of labels.
    free = np.concatenate([logits(model, pa.array([texts[i] for i in held[low : low + 256]], pa.string())) for low in range(0, len(held), 256)])
    want, low, high = (labels[held].sum() + 0.5) / (len(held) + 1), -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(free + middle).mean() < want else (low, middle)
    return replace(model, bias=(low + high) / 2)


def train_quality_model(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> QualityModel:
    """Fit on a bounded sample of the labels whose quality is 0 or 1; the caller leaves out rows held out.

    At most `sample_rows` labels are drawn by a hash of doc_id, then met with their documents; a
    doc_id with several labels or texts takes the least of each. Texts that are null or longer than
    `sample_chars` are not fitted. Without any usable label every score is 0.5.
    """
    able = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    one = able.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = one.orderBy(F.xxhash64(F.lit(rules.seed), "doc_id"), "doc_id").limit(rules.sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.length("text") <= rules.sample_chars
    )
    # At most sample_rows rows of two numbers are broadcast.
    met = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = sorted(met.collect(), key=lambda r: r["doc_id"])
    order = np.random.default_rng(rules.seed).permutation(len(rows))
    known = np.array([rows[i]["quality"] for i in order], np.float32)
    if not len(rows) or known.min() == known.max():
        bias = float(np.log((known.sum() + 1) / (len(rows) - known.sum() + 1)))
        blind = _Network(rules, bias)
        blind.layer[:] = 0
        return blind.model()
    return _fit([rows[i]["text"] for i in order], known, rules)


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The columns `keep` with score and predicted, which replace columns of their names.

    score is the probability of label 1 of the whole text; a null text is scored as an empty one.
    predicted is 1 from `threshold` on. Rows are independent, so repeated rows give repeated
    results; other columns are ignored; no rows, no rows.
    """
    kept = [c for c in keep if c not in ("score", "predicted")]
    given = A.small_batches(docs).select(*kept, F.col("text").cast("string").alias("_read"))
    schema = type(given.schema)([given.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")

    def run(batches):
        for piece in A.pieces(batches, "_read", 1 << 20):
            score = probabilities(model, A.column(piece, "_read"))
            yield pa.record_batch(
                [*[piece.column(c) for c in kept], pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())],
                [*kept, "score", "predicted"],
            )

    return given.mapInArrow(run, schema)


def held_out_of(table: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """The rows with held_out: the CRC of doc_id as text, modulo folds, is fold. A null id is not held out."""
    return table.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)))
