"""Byte-level BPE over padded numpy matrices.

Pieces that the splitting pattern finds are encoded once per cache of a task. Pieces of similar
length share a matrix with one row each; every round, every row merges its leftmost pair of least
rank, and the row closes up. The rank of a pair of ids comes from an open-addressing hash table.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A

NONE = np.int32(2**31 - 1)
LONGEST_ROW = 512  # bytes; longer pieces are merged with a heap
CACHE = 100_000
_U = np.uint64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line of base64 bytes and rank each. It has a few MB at most."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class Vocabulary:
    """The merges of a rank file as arrays: two tokens merge where their joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[left] << 32 | ranks[right], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := token[:cut]) in ranks and (right := token[cut:]) in ranks
        ]
        keys = np.array([k for k, _ in pairs], _U)
        values = np.array([v for _, v in pairs], np.int32)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, _U)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] == NONE
            _, one = np.unique(slot[left[free]], return_index=True)
            placed = left[free][one]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

        order = sorted(ranks.items(), key=lambda item: item[1])
        size = np.zeros(order[-1][1] + 1, np.int64)
        size[[r for _, r in order]] = [len(t) for t, _ in order]
        self.size, self.at = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (A.mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that two ids merge to, NONE where they don't or one is padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).astype(_U).ravel()
        slot = self._slot(keys)
        out = self.values[slot]
        lost = np.flatnonzero((self.keys[slot] != keys) & (out != NONE))
        out[lost] = NONE if not len(lost) else out[lost]
        while len(lost):
            slot[lost] = (slot[lost] + 1) & (len(self.keys) - 1)
            out[lost] = self.values[slot[lost]]
            lost = lost[(self.keys[slot[lost]] != keys[lost]) & (out[lost] != NONE)]
        return out.reshape(shape)

    def _merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows after all merges, and their lengths."""
        done, rows = ids.copy(), np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            live = least != NONE
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                done[rows[~live], ids.shape[1] :] = -1
                rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            ids[n, at] = least
            source = columns[None, : ids.shape[1] - 1] + (columns[None, : ids.shape[1] - 1] > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            if ids.shape[1] == 1:
                done[rows, :1], done[rows, 1:] = ids, -1
                break
            pairs = columns[None, : ids.shape[1] - 1]
            ranks = np.take_along_axis(ranks, pairs + (pairs > at[:, None]), axis=1)
            left = np.maximum(at - 1, 0)
            ranks[n, left] = self.pair_ranks(ids[n, left], ids[n, left + 1])
            here = np.minimum(at, ids.shape[1] - 2)
            ranks[n, here] = self.pair_ranks(ids[n, here], ids[n, here + 1])
        return done, (done >= 0).sum(axis=1)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                rank = int(self.pair_ranks(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
                if rank != NONE:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if ids[i] != left or after[i] >= n or ids[after[i]] != right:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of ids of each piece)."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        n = np.ones(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (pieces, their ids row after row)
        known = np.flatnonzero(whole >= 0)
        parts.append((known, whole[known].astype(np.int32)))
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(size[rest], kind="stable")]
        width = 4
        while len(rest):
            fits = int(np.searchsorted(size[rest], width, side="right"))
            step = max(1, (1 << 19) // width)
            for low in range(0, fits, step):
                some = rest[low : min(low + step, fits)]
                raw = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
                mask = np.arange(width) < size[some][:, None]
                ids = np.full((len(some), width), -1, np.int32)
                ids[mask] = self.byte_ids[raw]
                ids, n[some] = self._merge_rows(ids)
                parts.append((some, ids[ids >= 0]))
            rest = rest[fits:]
            if width >= LONGEST_ROW:
                for i in rest:
                    ids = self._merge_long(pieces[i])
                    n[i] = len(ids)
                    parts.append((np.array([i]), ids))
                break
            width *= 2
        starts = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        for some, ids in parts:
            out[ragged(starts[some], n[some])] = ids
        return out, n

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.at[ids], self.size[ids])]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return shift + np.arange(total)


class _Index(dict):
    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


class Encoder:
    """Texts to ids, with a bounded cache of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self):
        self.index, self.ids = _Index(), np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of ids of each text)."""
        if len(self.index) > CACHE:
            self._forget()
        found = [self.split(t) for t in texts]
        pieces = np.array([len(f) for f in found], np.int64)
        known = len(self.index)
        at = np.fromiter((self.index[p] for f in found for p in f), np.int64, int(pieces.sum()))
        if len(self.index) > known:
            fresh = [p.encode() for p in list(self.index)[known:]]
            ids, n = self.vocabulary.encode(fresh)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.size = np.concatenate([self.size, n])
            self.ids = np.concatenate([self.ids, ids])
        n = self.size[at]
        ids = self.ids[ragged(self.start[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pieces)]
        return ids, np.diff(ends, prepend=0)


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens and ids, a binary of little-endian unsigned 32-bit numbers.

    Every match of `pattern` is encoded separately by the ranks; there are no special tokens. A
    null or empty text has no tokens. Rows are independent of each other, so repeated rows give
    repeated results, and other columns are ignored. The vocabulary travels with the job.
    """
    def run(batches):
        yield from _encoded(batches, Encoder(Vocabulary(ranks), pattern))

    return _texts(docs).mapInArrow(run, ENCODED)


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids and decoded, the bytes of the ids. Null ids decode to no bytes."""
    given = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches):
        vocabulary = Vocabulary(ranks)
        for batch in batches:
            yield _with_decoded(batch, vocabulary)

    return given.mapInArrow(run, DECODED)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """`encode_texts`, then `decode_ids` of the packed ids, in one task with one copy of the vocabulary."""
    texts = _texts(docs)

    def run(batches):
        vocabulary = Vocabulary(ranks)
        for batch in _encoded(batches, Encoder(vocabulary, pattern)):
            yield _with_decoded(batch, vocabulary)

    return texts.mapInArrow(run, DECODED)


ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = f"{ENCODED}, decoded binary"


def _texts(docs: DataFrame) -> DataFrame:
    return A.small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def _encoded(batches, encoder: Encoder):
    for piece in A.pieces(batches, "text", 1 << 19):
        ids, n = encoder.encode([t or "" for t in piece.column("text").to_pylist()])
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
        packed = [raw[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.record_batch(
            [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"]
        )


def _with_decoded(batch: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
    out = [
        vocabulary.decode(np.frombuffer(x or b"", "<u4").astype(np.int64)).tobytes() for x in batch.column("ids").to_pylist()
    ]
    return pa.record_batch([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
