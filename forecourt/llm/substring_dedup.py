"""Removal of word windows that occur more than once, with a count-min prefilter.

Documents are dealt into groups of bounded size. Every group sends a count-min sketch of its
windows, cut into ranges of cells and written sparsely; sketches of a range are merged, and each
group hears which of its own cells were counted more than once. The estimate is never too small,
so a window that repeats always has such cells in every row of the sketch. Only those windows are
then grouped exactly, by 96 bits of hash of their words. A group counts a window of its own once
or more than once before it sends it, so a window that fills a third of the corpus is one
entry per group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A

SENT = "block long, row int, writer int, payload binary, flags binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
_U = np.uint64


def _windows(texts: pa.Array, window: int):
    """(words, positions of windows, two hashes of each window)."""
    found = A.words(texts)
    hashes = A.word_hashes(found)
    at = A.inside(found.first, window)
    one = A.window_hashes(hashes, window)[at]
    two = A.window_hashes(A.mix(hashes ^ _U(0x5851F42D4C957F2D)), window)[at] >> _U(32)
    return found, at, one, two


def _distinct(one: np.ndarray, two: np.ndarray):
    """Order, and where in that order each new pair begins."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two windows with one first hash
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = a[1:] == a[:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~(same & (b[1:] == b[:-1]))
    return order, new


def _cells(one: np.ndarray, row: int, bits: int) -> np.ndarray:
    return A.mix(one + _U((row * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - bits)


def _row_cells(one: np.ndarray, row: int, bits: int):
    """The sorted cells of a row of the sketch, whether each was counted more than once, and the
    place of each window's cell among them."""
    cells, place, n = np.unique(_cells(one, row, bits), return_inverse=True, return_counts=True)
    return cells, n > 1, place


def _by_block(keys: np.ndarray, shift: int):
    """(block, low, high) for runs of sorted keys with the same leading bits."""
    blocks, low = np.unique(keys >> _U(shift), return_index=True)
    high = np.append(low[1:], len(keys))[: len(low)]
    return zip(blocks.tolist(), low.tolist(), high.tolist(), strict=True)


def _table(rows: list) -> pa.Table:
    kinds = [("block", pa.int64()), ("row", pa.int32()), ("writer", pa.int32()), ("payload", pa.binary()), ("flags", pa.binary())]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def _merge(found: pa.Table, values_of) -> tuple[list, np.ndarray]:
    """The senders' values, and for each value whether any other or the sender counted it again."""
    A.lean()
    sent = [values_of(p) for p in found.column("payload").to_pylist()]
    again = [A.unpack_bits(f) for f in found.column("flags").to_pylist()]
    values = np.concatenate(sent)
    _, place, n = np.unique(values, return_inverse=True, return_counts=True)
    repeated = n > 1
    repeated |= np.bincount(place.ravel(), weights=np.concatenate(again), minlength=len(n)) > 0
    ends = np.cumsum([len(s) for s in sent])
    return np.split(repeated[place.ravel()], ends[:-1])


def _answers(found: pa.Table, hits: list, row) -> pa.Table:
    blocks, writers = found.column("block").to_pylist(), found.column("writer").to_pylist()
    rows = found.column("row").to_pylist() if row is None else [row] * len(writers)
    return _table([(b, r, w, None, A.pack_bits(h)) for b, r, w, h in zip(blocks, rows, writers, hits, strict=True)])


PRINT = np.dtype([("one", "<u8"), ("two", "<u4")])


def dedup_substrings(docs: DataFrame, window: int = 35, depth: int = 2, group_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text, the words left, joined by a space.

    Removed is each word that a window of `window` words covers whose words also start anywhere
    else in the table, the same document included. All windows are judged on the input. Null and
    empty texts have no words, n_removed 0 and an empty kept_text; a text shorter than the window
    stays whole. Every row is judged by itself, also where doc_id repeats or is null. Other columns
    are ignored. Windows count as equal when 96 bits of hash over their words agree.

    The width of the sketch follows the bytes of the input, so its load is the same at every size.
    """
    spark = docs.sparkSession
    texts = A.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = int(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    writers = max(math.ceil(total / group_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(16, math.ceil(math.log2(max(total, 2))))
    block_bits = max(1, math.ceil(math.log2(writers)))
    dealt = texts.withColumn("writer", F.pmod(F.xxhash64("doc_id", "text"), F.lit(writers)).cast("int")).repartition("writer")

    def sketch(key, group):
        _, _, one, two = _windows(A.column(group, "text"), window)
        rows = []
        for row in range(depth):
            cells, again, _ = _row_cells(one, row, bits)
            rows += [
                (row << 32 | b, row, key[0].as_py(), A.pack_sorted(cells[i:j]), A.pack_bits(again[i:j]))
                for b, i, j in _by_block(cells, bits - block_bits)
            ]
        return _table(rows)

    def estimate(found):
        return _answers(found, _merge(found, A.unpack_sorted), None)

    def candidates(key, group, marks):
        _, _, one, two = _windows(A.column(group, "text"), window)
        if not len(one):
            return _table([])
        marks = marks.sort_by("block")
        flags = dict.fromkeys(range(depth), None)
        for row in range(depth):
            mine = marks.filter(pa.compute.equal(marks.column("row"), row)).column("flags").to_pylist()
            flags[row] = np.concatenate([A.unpack_bits(f) for f in mine])
        likely = np.ones(len(one), bool)
        for row in range(depth):
            likely &= flags[row][_row_cells(one, row, bits)[2].ravel()]
        order, new = _distinct(one, two)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        likely = likely[order[first]]
        writer = key[0].as_py()
        rows = [(-1 - writer, -1, writer, None, A.pack_bits(likely))]
        prints = np.zeros(int(likely.sum()), PRINT)
        prints["one"], prints["two"] = one[order[first[likely]]], two[order[first[likely]]]
        again = n[likely] > 1
        rows += [
            (b, 0, writer, prints[i:j].tobytes(), A.pack_bits(again[i:j]))
            for b, i, j in _by_block(prints["one"], 64 - block_bits)
        ]
        return _table(rows)

    def confirm(found):
        if found.column("block")[0].as_py() < 0:  # what a group notes for itself
            return found
        prints = [np.frombuffer(p, PRINT) for p in found.column("payload").to_pylist()]
        again = [A.unpack_bits(f) for f in found.column("flags").to_pylist()]
        whole = np.concatenate(prints)
        order, new = _distinct(whole["one"], whole["two"])
        run = np.cumsum(new) - 1
        repeated = (np.bincount(run) > 1) | (np.bincount(run, weights=np.concatenate(again)[order]) > 0)
        hits = np.zeros(len(whole), bool)
        hits[order] = repeated[run]
        return _answers(found, np.split(hits, np.cumsum([len(p) for p in prints])[:-1]), 0)

    def remove(key, group, marks):
        found, at, one, two = _windows(A.column(group, "text"), window)
        covered = np.zeros(len(found.start) + 1, np.int32)
        if len(one):
            order, new = _distinct(one, two)
            first = np.flatnonzero(new)
            marks = marks.sort_by("block")
            rows = marks.column("row").to_pylist()
            flags = marks.column("flags").to_pylist()
            repeated = np.zeros(len(first), bool)
            likely = next(A.unpack_bits(f) for r, f in zip(rows, flags, strict=True) if r == -1)
            sure = [A.unpack_bits(f) for r, f in zip(rows, flags, strict=True) if r == 0]
            repeated[np.flatnonzero(likely)] = np.concatenate(sure) if sure else False
            hit = np.zeros(len(one), bool)
            hit[order] = repeated[np.cumsum(new) - 1]
            np.add.at(covered, at[hit], 1)
            np.add.at(covered, at[hit] + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        kept, removed = [], []
        raw, first = found.data.tobytes(), found.first
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[first[1:]] - sums[first[:-1]]
        for i in range(len(first) - 1):
            mine = raw[found.offsets[i] : found.offsets[i + 1]].split()
            if removed[i]:
                mine = [w for w, g in zip(mine, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(mine))
        return pa.table({
            "doc_id": A.column(group, "doc_id"),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    cells = dealt.groupBy("writer").applyInArrow(sketch, SENT)
    marks = cells.groupBy("block").applyInArrow(estimate, SENT)
    prints = dealt.groupBy("writer").cogroup(marks.groupBy("writer")).applyInArrow(candidates, SENT)
    sure = prints.groupBy("block").applyInArrow(confirm, SENT)
    return dealt.groupBy("writer").cogroup(sure.groupBy("writer")).applyInArrow(remove, RESULT)
