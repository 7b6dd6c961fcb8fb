"""Benchmark passages inside documents, found by meaning and confirmed word by word.

The passages' TF-IDF matrix, weighted by how many documents hold a word, goes through a randomised
singular value decomposition whose products run as Spark jobs over the passages. Windows of every
document are folded into the same space; where a window and a passage point alike, the longest
common subsequence of their words decides, and the answer, if the benchmark has one, must be there.

The space has fewer dimensions than a large benchmark has passages, and a short passage turns a
window only a little. Places that share pairs of words in a row with a passage are therefore
candidates too, at any size of the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.bitmaps import bitmap, marks

_U = np.uint64
SLOT_BITS = 15
MEMBER_BITS = 22
PAGE_ROWS = 512
TEXTS = 128  # whose slots are marked at once
PAIR_BITS = 20  # of a table that tells most pairs of words at once from those of passages


@dataclass(frozen=True)
class DecontaminationRules:
    passage: int = 48  # words of a benchmark passage; longer items have several
    step: int = 32  # words between the starts of document windows, of two steps each
    rank: int = 256  # of the decomposition, at most
    powers: int = 2  # rounds of the range finder after the first
    cosine: float = 0.5  # in the latent space, for candidates
    share: float = 0.6  # of a passage's words that the common subsequence must hold
    least: int = 8  # words that it must hold
    block: int = 4096  # passages that meet the documents at once
    group: int = 256  # passages whose word pairs meet a piece of the documents at once
    seed: int = 3


PASSAGES = "item_id long, place int, words array<long>, answer array<long>"


def passages_of(benchmark: DataFrame, rules: DecontaminationRules) -> DataFrame:
    """The items in passages of word hashes; an answer column is optional."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))

    def run(batches):
        for batch in batches:
            found = A.words(A.column(batch, "text"))
            hashes = A.word_hashes(found, lower=True).view(np.int64)
            wanted = A.words(A.column(batch, "answer"))
            answers = A.word_hashes(wanted, lower=True).view(np.int64)
            rows = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                mine = hashes[found.first[i] : found.first[i + 1]]
                parts = max(1, -(-len(mine) // rules.passage))
                for place, part in enumerate(np.array_split(mine, parts)):
                    if len(part):
                        rows.append((item, place, part.tolist(), answers[wanted.first[i] : wanted.first[i + 1]].tolist()))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ("item_id", "place", "words", "answer")
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(names))

    return items.mapInArrow(run, PASSAGES)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (A.mix(hashes ^ _U(0x2545F4914F6CDD1D)) >> _U(64 - SLOT_BITS)).astype(np.int64)


def _weights(docs: DataFrame, members: bytes) -> np.ndarray:
    """log(1 + documents / documents with the word) for each slot, over all documents."""

    def run(batches):
        known = marks(members)
        counts, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for piece in A.pieces(batches, "text", 2 << 20):
            found = A.words(A.column(piece, "text"))
            hashes = A.word_hashes(found, lower=True)
            hit = known[(hashes & _U((1 << MEMBER_BITS) - 1)).astype(np.int64)]
            owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))[hit]
            slots, n_texts = _slots(hashes[hit]), piece.num_rows
            for low in range(0, n_texts, TEXTS):
                some = slice(*np.searchsorted(owner, (low, low + TEXTS)))
                held = np.zeros((min(TEXTS, n_texts - low), len(counts)), bool)
                held[owner[some] - low, slots[some]] = True
                counts += np.count_nonzero(held, axis=0)
            n += n_texts
        slots = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(np.append(slots, -1), pa.int64()), pa.array(np.append(counts[slots], n), pa.int64())], ["slot", "n"]
        )

    total, with_word = 0, np.zeros(1 << SLOT_BITS)
    for row in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if row["slot"] < 0:
            total = row["n"]
        else:
            with_word[row["slot"]] = row["n"]
    return np.log1p(max(total, 1) / np.maximum(with_word, 1))


def _summed(passages: DataFrame, product, rows: int, columns: int) -> np.ndarray:
    """The sum over partitions of product(batches), a matrix that is cut into pages of rows."""

    def run(batches):
        part = product(batches)
        starts = list(range(0, rows, PAGE_ROWS))
        yield pa.record_batch(
            [pa.array(starts, pa.int64()), pa.array([part[s : s + PAGE_ROWS].astype("<f8").tobytes() for s in starts], pa.binary())],
            ["start", "part"],
        )

    def add(found):
        total = sum(np.frombuffer(p, "<f8") for p in found.column("part").to_pylist())
        return pa.table({"start": found.column("start").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    whole = np.zeros((rows, columns))
    schema = "start long, part binary"
    for row in passages.mapInArrow(run, schema).groupBy("start").applyInArrow(add, schema).toLocalIterator():
        page = np.frombuffer(row["part"], "<f8").reshape(-1, columns)
        whole[row["start"] : row["start"] + len(page)] = page
    return whole


def _tf_idf(words: list[list[int]], place: np.ndarray, weights: np.ndarray):
    """Sparse unit rows of passages: (row, column, value) sorted by row."""
    size = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), size)
    slot = _slots(np.concatenate([np.array(w, np.int64) for w in words]).view(_U))
    cells, n = np.unique(row << SLOT_BITS | slot, return_counts=True)
    row, slot = cells >> SLOT_BITS, cells & ((1 << SLOT_BITS) - 1)
    value = n * weights[slot]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(words)))
    return row, place[slot], value / norm[row]


def latent_space(passages: DataFrame, weights: np.ndarray, rules: DecontaminationRules) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the words, right singular vectors of the passages' TF-IDF matrix over these slots).

    The matrix is only ever multiplied, partition by partition; the driver holds matrices of at
    most 2**SLOT_BITS times `rank` numbers.
    """
    n = passages.count()

    def used(batches):
        for batch in batches:
            found = [np.array(w, np.int64) for w in batch.column("words").to_pylist()]
            yield pa.record_batch([pa.array(np.unique(_slots(np.concatenate(found).view(_U))) if found else [], pa.int64())], ["slot"])

    slots = np.array(sorted(r["slot"] for r in passages.mapInArrow(used, "slot long").distinct().collect()), np.int64)
    place = np.full(1 << SLOT_BITS, -1)
    place[slots] = np.arange(len(slots))
    rank = min(rules.rank, n, len(slots))

    def through(basis: np.ndarray):
        def product(batches):
            total = np.zeros((len(slots), basis.shape[1]))
            for batch in batches:
                if batch.num_rows:
                    row, column, value = _tf_idf(batch.column("words").to_pylist(), place, weights)
                    starts = np.searchsorted(row, np.arange(batch.num_rows))
                    inner = np.add.reduceat(basis[column] * value[:, None], starts, axis=0)
                    order = np.argsort(column, kind="stable")
                    names, low = np.unique(column[order], return_index=True)
                    total[names] += np.add.reduceat(inner[row[order]] * value[order, None], low, axis=0)
            return total

        return product

    basis = np.random.default_rng(rules.seed).normal(size=(len(slots), rank))
    for _ in range(1 + rules.powers):
        basis, _ = np.linalg.qr(_summed(passages, through(basis), len(slots), basis.shape[1]))
    # In the basis found, the squared singular values are those of a small square matrix.
    small = basis.T @ _summed(passages, through(basis), len(slots), basis.shape[1])
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    keep = squares > 1e-9 * max(squares.max(), 1e-300)
    return slots, (basis @ turn[:, keep])[:, ::-1].astype(np.float32)


def _blocks(passages: DataFrame, size: int) -> Iterator[list]:
    held = []
    for row in passages.orderBy("item_id", "place").toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """The longest common subsequence of n words, given as bit masks of their places, and words."""
    full = (1 << n) - 1
    state = full
    for word in words:
        if mask := masks.get(word):
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return A.mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:])


class _Pairs:
    """The pairs of words in a row of a block's passages, and how many of them make a candidate.

    A copy that holds k of n words in order, the others replaced one for one, keeps at least
    2k - n - 1 of the n - 1 pairs. A third of these may be the passage's commonest pairs, which are
    left out, another third may be lost to words put in between; the rest must be there. Passages of
    less than `least` words must be there with all pairs; those of one word have none.
    """

    def __init__(self, words: list[list[int]], rules: DecontaminationRules):
        mine = [_pairs(np.array(w, np.int64).view(_U)) for w in words]
        self.keys, counts = np.unique(np.concatenate(mine), return_counts=True)
        self.marked = np.zeros(1 << PAIR_BITS, bool)
        self.marked[(self.keys & _U((1 << PAIR_BITS) - 1)).astype(np.int64)] = True
        self.need, entries = [], []
        for passage, found in enumerate(mine):
            n = len(found) + 1
            if n < rules.least:
                need, spared = n - 1, 0
            else:
                sure = 2 * max(rules.least, math.ceil(rules.share * n)) - n - 1
                spared = max(sure, 0) // 3
                need = max(1, sure - 2 * spared)
            self.need.append(need)
            name = np.searchsorted(self.keys, found)
            at = np.argsort(counts[name], kind="stable")[: len(found) - spared]
            entries.append(np.stack([np.full(len(at), passage), at, name[at]]))
        self.need = np.array(self.need)
        self.drift = np.maximum(4, np.array([len(w) for w in words]) // 4)
        entries = np.concatenate(entries, axis=1).astype(np.int64)
        self.groups = []
        for low in range(0, len(words), rules.group):
            passage, at, name = entries[:, (entries[0] >= low) & (entries[0] < low + rules.group)]
            order = np.argsort(name, kind="stable")
            first = np.searchsorted(name[order], np.arange(len(self.keys) + 1))
            self.groups.append((passage[order].astype(np.int32), at[order].astype(np.int32), first.astype(np.int32)))

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, apart: int):
        """(passage, text, first word that a copy would have) of the places with enough pairs."""
        if len(hashes) < 2 or not len(self.keys):
            return
        pairs = _pairs(hashes)
        at = np.flatnonzero(self.marked[(pairs & _U((1 << PAIR_BITS) - 1)).astype(np.int64)] & (owner[1:] == owner[:-1]))
        name = np.minimum(np.searchsorted(self.keys, pairs[at]), len(self.keys) - 1)
        right = self.keys[name] == pairs[at]
        at, name = at[right], name[right]
        span = len(hashes) + apart * (int(owner[-1]) + 2)
        for passages, places, first in self.groups:
            size = first[name + 1] - first[name]
            total = int(size.sum())
            if not total:
                continue
            entry = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[name], size)
            word = np.repeat(at, size)
            passage = passages[entry].astype(np.int64)
            start = word - places[entry]
            # Texts are moved apart, so that no count reaches into the next one.
            key = passage * span + start + apart * (owner[word] + 1)
            order = np.argsort(key)
            key, passage = key[order], passage[order]
            enough = np.searchsorted(key, key + self.drift[passage], side="right") - np.arange(total) >= self.need[passage]
            key, passage, order = key[enough], passage[enough], order[enough]
            _, one = np.unique(np.stack([passage, key // self.drift[passage]]), axis=1, return_index=True)
            yield from zip(passage[one].tolist(), owner[word[order[one]]].tolist(), start[order[one]].tolist(), strict=True)


class _Passages:
    """A block of passages, ready to meet documents."""

    def __init__(self, rows: list, slots_of: np.ndarray, latent: np.ndarray, weights: np.ndarray, rules: DecontaminationRules):
        self.items = [r["item_id"] for r in rows]
        self.words = [list(r["words"]) for r in rows]
        self.answers = [list(r["answer"] or ()) for r in rows]
        vectors = np.zeros((len(rows), latent.shape[1]), np.float32)
        row, place, value = _tf_idf(self.words, slots_of, weights)
        np.add.at(vectors, row, latent[place] * value[:, None].astype(np.float32))
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.masks = []
        for words in self.words:
            masks: dict[int, int] = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
            self.masks.append(masks)
        self.pairs = _Pairs(self.words, rules)


def _windows(found: A.Words, hashes: np.ndarray, known: np.ndarray, table: np.ndarray, slots_of: np.ndarray, step: int):
    """(latent unit vector of each window of two steps, its text, its step within the text)."""
    n_words = np.diff(found.first)
    steps = -(-n_words // step)
    first = np.concatenate([[0], np.cumsum(steps)])
    owner = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(known[(hashes & _U((1 << MEMBER_BITS) - 1)).astype(np.int64)])
    slots = slots_of[_slots(hashes[at])]
    at, slots = at[slots >= 0], slots[slots >= 0]
    step_of = first[owner[at]] + (at - found.first[owner[at]]) // step
    sums = np.zeros((int(first[-1]) + 1, table.shape[1]), np.float32)
    if len(at):
        names, low = np.unique(step_of, return_index=True)
        sums[names] = np.add.reduceat(table[slots], low, axis=0)
    text = np.repeat(np.arange(len(n_words)), steps)
    follows = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    vectors = sums[:-1].copy()
    vectors[follows] += sums[1:][follows]
    length = np.sqrt((vectors * vectors).sum(axis=1))
    vectors /= np.maximum(length, 1e-12)[:, None]
    return vectors, text, np.arange(len(text)) - first[:-1][text]


def _match(block: _Passages, slots_of: np.ndarray, table: np.ndarray, members: bytes, rules: DecontaminationRules):
    step, transposed = rules.step, np.ascontiguousarray(block.vectors.T)

    def run(batches):
        known = marks(members)
        for piece in A.pieces(batches, "text", 1 << 18):
            found = A.words(A.column(piece, "text"))
            hashes = A.word_hashes(found, lower=True)
            signed = hashes.view(np.int64)
            vectors, text, place = _windows(found, hashes, known, table, slots_of, step)
            hits: dict[tuple[int, int], float] = {}

            def compare(p: int, doc: int, low: int, high: int) -> None:
                n = len(block.words[p])
                words = signed[max(found.first[doc], low) : min(found.first[doc + 1], high)].tolist()
                common = common_length(block.masks[p], n, words)
                if common < min(rules.least, n) or common < rules.share * n:
                    return
                if block.answers[p] and not _holds(signed[found.first[doc] : found.first[doc + 1]], block.answers[p]):
                    return
                key = (doc, block.items[p])
                hits[key] = max(hits.get(key, 0.0), common / n)

            for low in range(0, len(vectors), 4096):
                near = vectors[low : low + 4096] @ transposed
                for w, p in zip(*(x.tolist() for x in np.nonzero(near >= rules.cosine)), strict=True):
                    doc, n = int(text[low + w]), len(block.words[p])
                    begin = found.first[doc] + int(place[low + w]) * step
                    compare(p, doc, begin - n, begin + 2 * step + n)
            owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
            for p, doc, start in block.pairs.candidates(hashes, owner, 4 * rules.passage):
                drift = int(block.pairs.drift[p])
                compare(p, doc, start - drift, start + 2 * drift + len(block.words[p]))
            matched: list[list] = [[] for _ in range(piece.num_rows)]
            for (doc, item), share in sorted(hits.items()):
                matched[doc].append({"item_id": item, "share": share})
            before = piece.column("matches").to_pylist()
            both = pa.array([b + m for b, m in zip(before, matched, strict=True)], MATCHES)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], both], piece.schema.names)

    return run


MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))


def _holds(words: np.ndarray, answer: list[int]) -> bool:
    n = len(answer)
    starts = np.flatnonzero(words[: len(words) - n + 1] == answer[0]) if len(words) >= n else ()
    return any(words[s : s + n].tolist() == answer for s in starts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: DecontaminationRules = DecontaminationRules()) -> DataFrame:
    """All columns of docs and matches: (item_id, share of the passage's words), by item.

    A document matches an item if a place in it comes near a passage of the item in the latent
    space, or by its pairs of words in a row, holds at least `share` of the passage's words in order, near each other, and, where the
    benchmark has an answer that is not null, holds the answer's words somewhere in a row. Words
    compare without the case of A-Z. Null and empty texts and items match nothing; an empty
    benchmark gives no matches. Rows are independent; a column named matches is replaced. Items
    with one text all match. A passage that many documents hold is found in all of them.
    """
    kept = [c for c in docs.columns if c != "matches"]
    none = F.array().cast("array<struct<item_id:bigint,share:double>>").alias("matches")
    rows = A.small_batches(docs).select(*[F.col(c).cast("string") if c == "text" else F.col(c) for c in kept], none)
    passages = passages_of(benchmark.filter(F.col("item_id").isNotNull()), rules)
    members = bitmap(passages.select(F.explode("words").alias("word")), MEMBER_BITS)
    if not any(members):
        return rows
    weights = _weights(docs.select(F.col("text").cast("string").alias("text")), members)
    slots, latent = latent_space(passages, weights, rules)
    slots_of = np.full(1 << SLOT_BITS, -1, np.int32)
    slots_of[slots] = np.arange(len(slots))
    table = latent * weights[slots, None].astype(np.float32)
    for block in _blocks(passages, rules.block):
        ready = _Passages(block, slots_of, latent, weights, rules)
        rows = rows.mapInArrow(_match(ready, slots_of, table, members, rules), rows.schema)
    return rows
