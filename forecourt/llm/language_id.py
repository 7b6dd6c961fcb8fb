"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 3 and 4 bytes that do not span white space inside; each has an embedding by
its hash. A text is the mean of its subwords' embeddings. Embeddings and the linear layer are
trained together by stochastic gradient descent in numpy on a bounded sample; a temperature and
the rejection threshold are fitted on a part of it that the descent does not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.sampling import bounded_sample

UNKNOWN = "und"
SIZES = (3, 4)


@dataclass(frozen=True)
class LanguageRules:
    sample_rows: int = 3000  # labelled rows the model is fitted on, at most
    sample_chars: int = 20_000  # longer texts are not drawn for fitting
    bits: int = 16  # the table of embeddings has 2**bits rows
    size: int = 16  # of an embedding
    epochs: int = 4
    rate: float = 4.0
    held_back: int = 5  # every so many-th row of the sample is for calibration
    wrongly_rejected: float = 0.001  # share of right calibration predictions below the threshold
    highest_threshold: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    scores: np.ndarray  # (2**bits + 1, languages): an embedding through the linear layer, over the temperature
    bias: np.ndarray
    threshold: float


def _subwords(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each subword, 2**bits for none; first subword of each text; subwords per text)."""
    data, offsets = A.utf8(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + n + max(SIZES), 32, np.uint8)
    shift = np.repeat(np.arange(n), np.diff(offsets)) + 1
    out[np.arange(len(data)) + shift] = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    out[(out >= 9) & (out <= 13)] = 32
    space = out == 32
    wide = out.astype(np.uint32)
    starts = offsets[:-1] + np.arange(n)
    total = len(data) + n
    none = 1 << bits
    found, valid_all = [], np.zeros(total, np.int64)
    for size in SIZES:
        gram = np.zeros(total, np.uint32)
        valid = np.ones(total, bool)
        for j in range(size):
            gram = gram * np.uint32(257) + wide[j : j + total] * np.uint32(0x9E3779B1)
            if 0 < j < size - 1:
                valid &= ~space[j : j + total]
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x85EBCA6B)
        row = (gram >> np.uint32(32 - bits)).astype(np.int32)
        row[~valid] = none
        found.append(row)
        valid_all += valid
    return found, starts, np.add.reduceat(valid_all, starts) if n else np.zeros(0, np.int64)


def train_language_model(docs: DataFrame, rules: LanguageRules = LanguageRules()) -> LanguageModel:
    """Fit on a bounded sample of the rows whose lang is not null and whose text has a letter.

    The caller leaves out the rows that are held out. Without any usable row the model knows no
    language, and every prediction is `und`.
    """
    able = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    rows = bounded_sample(able, ["doc_id", "text", "lang"], rules.sample_rows, rules.sample_chars)
    langs = tuple(sorted({r["lang"] for r in rows}))
    empty = np.zeros(((1 << rules.bits) + 1, max(len(langs), 1)), np.float32)
    if not rows:
        return LanguageModel((), empty, empty[0], 0.0)
    target = np.array([langs.index(r["lang"]) for r in rows])
    features = []
    for r in rows:
        found, _, _ = _subwords(pa.array([r["text"]], pa.string()), rules.bits)
        at, n = np.unique(np.concatenate(found), return_counts=True)
        keep = at < 1 << rules.bits
        features.append((at[keep], (n[keep] / max(1, n[keep].sum())).astype(np.float32)))

    random = np.random.default_rng(rules.seed)
    table = random.normal(0, 0.1, ((1 << rules.bits), rules.size)).astype(np.float32)
    layer = random.normal(0, 0.1, (rules.size, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    back = np.arange(len(rows)) % rules.held_back == rules.held_back - 1
    fit = np.flatnonzero(~back)
    steps = rules.epochs * len(fit)
    for step, i in enumerate(np.concatenate([random.permutation(fit) for _ in range(rules.epochs)])):
        at, share = features[i]
        if not len(at):
            continue
        hidden = share @ table[at]
        chance = _softmax(hidden @ layer + bias)
        chance[target[i]] -= 1
        rate = rules.rate * (1 - step / steps)
        down = layer @ chance
        layer -= np.float32(0.1 * rate) * np.outer(hidden, chance)
        bias -= np.float32(0.02 * rate) * chance
        table[at] -= np.float32(rate) * np.outer(np.sqrt(share), down).astype(np.float32) * np.sqrt(share)[:, None] * 8

    held = np.flatnonzero(back)
    held = held if len(held) else fit
    logits = np.stack([features[i][1] @ (table[features[i][0]] @ layer) + bias for i in held])
    # The flattest temperature that loses nothing in likelihood on rows the descent did not see.
    heat = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), target[held]], 1e-12)).mean())
    chance = _softmax(logits / heat)
    right = chance.argmax(axis=1) == target[held]
    scores = np.sort(chance.max(axis=1)[right])
    lowest = scores[int(len(scores) * rules.wrongly_rejected)] if len(scores) else 0.0
    out = np.zeros(((1 << rules.bits) + 1, len(langs)), np.float32)
    out[:-1] = table @ layer / heat
    return LanguageModel(langs, out, (bias / heat).astype(np.float32), float(min(lowest, rules.highest_threshold)))


def _softmax(logits: np.ndarray) -> np.ndarray:
    power = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return power / power.sum(axis=-1, keepdims=True)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected; lang_pred replaces a column of its name.

    lang_pred is a learned language, or `und` with score 0 where the text is null, empty or has no
    letter, or where nothing was learned. rejected marks `und` and scores below the threshold that
    calibration gave. A text is read whole; ties go to the first language by name. Rows are
    independent, so repeated rows give repeated results.
    """
    kept = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    given = A.small_batches(docs).select(*kept, F.col("text").cast("string").alias("_read"))
    fields = [given.schema[c] for c in kept]
    schema = type(given.schema)(fields).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    bits = (len(model.scores) - 1).bit_length() - 1
    n_langs = len(model.langs)
    by_lang = [np.ascontiguousarray(model.scores[:, k]) for k in range(n_langs)]
    bias, threshold, langs = model.bias, model.threshold, model.langs

    def run(batches):
        for piece in A.pieces(batches, "_read", 1 << 20):
            texts = A.column(piece, "_read")
            known = np.array([_has_letter(t) for t in texts.to_pylist()], bool)
            names, top = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if n_langs and known.any():
                found, starts, n = _subwords(texts, bits)
                logits = np.empty((len(texts), n_langs))
                for k in range(n_langs):
                    total = sum(np.add.reduceat(by_lang[k][f], starts, dtype=np.float64) for f in found)
                    logits[:, k] = total / np.maximum(n, 1) + bias[k]
                chance = _softmax(logits)
                best = chance.argmax(axis=1)
                top = np.where(known, chance[np.arange(len(best)), best], 0.0)
                names = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            learned = np.array([x != UNKNOWN for x in names], bool)
            yield pa.record_batch(
                [*[piece.column(c) for c in kept], pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(~learned | (top < threshold))],
                [*kept, "lang_pred", "score", "rejected"],
            )

    return given.mapInArrow(run, schema)


def held_out(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """The rows with held_out: the CRC of doc_id as text, modulo folds, is fold. A null id is not held out."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)))
