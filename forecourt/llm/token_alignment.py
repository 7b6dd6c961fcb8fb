"""Tokens of two tokenizers over the same bytes: groups between common ends, links, counts of id pairs.

Within a task everything is Arrow: lists of ids are flattened, sums of token sizes restart with each
document, hash joins on (document, end) meet the ends of both tokenizers, and grouped counts leave
the task. A task packs the links of some megabytes of text into one row, a packet, and Spark merges
the counts of all packets and hands every packet the counts of its own id pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.byte_bpe import ragged
from forecourt.llm.components import cut

SPACE = "▁"  # how the pieces of the second tokenizer write a space
# A space at which either tokenizer begins a token, whatever stands around: behind a letter, digit or
# usual punctuation, before a letter.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_BEFORE = f"[{_LETTER}0-9.,;:!?)*$%&#\"'-]"
_BREAK = re.compile(f"(?<={_BEFORE}) (?=[{_LETTER}])")
_BETWEEN_BREAKS = re.compile(f"(?s)[{_LETTER}](?:.*{_BEFORE})?")
CACHE = 300_000  # stretches of text whose tokens a task remembers
JOINED = 1000  # of them that are encoded as one text
END_BITS = 40  # of a document-end key


@dataclass(frozen=True)
class AlignmentRules:
    encode_bytes: int = 1 << 20  # of text encoded at once, or one document
    packet_bytes: int = 8 << 20  # of text whose links share a packet, about


class ByteLevelTokenizer:
    """A tokenizer file whose entries spell bytes with printable characters; no special tokens."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_buffer(file)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()

    @cached_property
    def entries(self) -> pa.Array:
        """The bytes of each id."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(b): b for b in printable}
        spelled |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        known = self._tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(known.values()) + 1)
        for entry, i in known.items():
            out[i] = bytes(spelled[c] for c in entry) if all(c in spelled for c in entry) else entry.encode()
        return pa.array(out, pa.binary())

    @cached_property
    def sizes(self) -> np.ndarray:
        return pc.binary_length(self.entries).to_numpy().astype(np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and the text."""
        return [e.ids for e in self._tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of ids of each stretch).

        Stretches that begin and end as breaks need are encoded many at once, as one text, and
        told apart by the sizes of their tokens, since this tokenizer spells every byte.
        """
        whole = [bool(_BETWEEN_BREAKS.fullmatch(s) or (len(s) == 1 and re.match(f"[{_LETTER}]", s))) for s in stretches]
        many, one = ([i for i, w in enumerate(whole) if w is kind] for kind in (True, False))
        lots = [many[at : at + JOINED] for at in range(0, len(many), JOINED)] + [[i] for i in one]
        found = self.encode([" ".join([stretches[i] for i in lot]) for lot in lots])
        order = np.fromiter(chain.from_iterable(lots), np.int64, len(stretches))
        ids = np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))
        ends = np.cumsum(np.fromiter((len(stretches[i].encode()) + 1 for i in order.tolist()), np.int64, len(order)))
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
        n = np.empty(len(order), np.int64)
        n[order] = np.diff(last, prepend=0)
        start = np.empty(len(order), np.int64)
        start[order] = np.concatenate([[0], last[:-1]])
        return ids[ragged(start, n)], n


class PieceTokenizer:
    """A model of pieces with byte fallback, which puts a space before the text itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_proto=file)

    @cached_property
    def joins_words(self) -> bool:
        """Some piece holds a space behind another character, so that words don't break at spaces."""
        return any(SPACE in self._model.id_to_piece(i).lstrip(SPACE) for i in range(self._model.get_piece_size()))

    @cached_property
    def entries(self) -> pa.Array:
        model, out = self._model, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
        return pa.array(out, pa.binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(stretches)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size


def _flat(lists: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """(key, name): per token its id, and its document and the end of its bytes there as one number."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(ids))
    offsets = lists.offsets.to_numpy()
    # The running sum restarts with each document: what stood before its first token goes off.
    before = np.concatenate([[0], total.to_numpy()])[offsets[:-1]]
    end = pc.subtract(total, pa.array(np.repeat(before, np.diff(offsets)), pa.int64()))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(doc.cast(pa.int64()), END_BITS), end), name: ids})


def _spelled(lists: pa.ListArray, entries: pa.Array) -> pa.Array:
    """The bytes of all tokens of each document, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, entries.take(pc.list_flatten(lists))), b"")


def _joined(names: pa.Array, offsets: np.ndarray, between: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), between)


class _Stretches(dict):
    """Numbers of stretches of text, in the order they come."""

    def __missing__(self, text):
        self[text] = len(self)
        return self[text]


class StretchEncoder:
    """The ids of texts by both tokenizers, each stretch between breaks encoded once per cache.

    A space and a text is a row of spaces and stretches, and no token reaches over a break, so the
    tokens of the stretches are those of the text.
    """

    def __init__(self, a: ByteLevelTokenizer, b: PieceTokenizer):
        self.tokenizers = (a, b)
        self.split = (lambda text: [text]) if b.joins_words else _BREAK.split
        self._forget()

    def _forget(self) -> None:
        self.known = _Stretches()
        self.ids = [np.zeros(0, np.int32) for _ in self.tokenizers]
        self.start = [np.zeros(0, np.int64) for _ in self.tokenizers]
        self.size = [np.zeros(0, np.int64) for _ in self.tokenizers]

    def encode(self, texts: list[str]) -> list[pa.ListArray]:
        """For each tokenizer the ids of each text; empty texts have none."""
        if len(self.known) > CACHE:
            self._forget()
        cut = [self.split(t) if t else () for t in texts]
        n_cut = np.array([len(c) for c in cut], np.int64)
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n_cut.sum()))
        fresh = list(self.known)[before:]
        out = []
        for k, tokenizer in enumerate(self.tokenizers):
            if fresh:
                ids, size = tokenizer.encode_stretches(fresh)
                self.start[k] = np.concatenate([self.start[k], len(self.ids[k]) + np.cumsum(size) - size])
                self.size[k] = np.concatenate([self.size[k], size])
                self.ids[k] = np.concatenate([self.ids[k], ids])
            size = self.size[k][at]
            ids = self.ids[k][ragged(self.start[k][at], size)]
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_cut)])]
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
        return out


class Aligner:
    """Both tokenizers and what is known of their ids."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = ByteLevelTokenizer(file_a), PieceTokenizer(file_b)
        self.sizes = [pc.binary_length(t.entries).cast(pa.int64()) for t in (self.a, self.b)]
        self.ids_b = len(self.b.entries)
        self.encoder = StretchEncoder(self.a, self.b)
        self.names = pa.array(map(str, range(max(len(self.a.entries), self.ids_b))), pa.string())

    def align(self, texts: list[str]) -> tuple[pa.Table, pa.Table]:
        """(n_a, n_b, n_groups, n_links, groups_sha256 of each text; doc, pair, times of the links).

        A pair is a * ids of b + b. Texts that are empty, or that either tokenizer does not spell
        as a space and the text, have no tokens.
        """
        given = pa.array([f" {t}".encode() if t else None for t in texts], pa.binary())
        lists = self.encoder.encode(texts)
        right = [pc.equal(_spelled(ids, t.entries), given) for ids, t in zip(lists, (self.a, self.b), strict=True)]
        able = pc.fill_null(pc.and_(*right), False)
        at = np.flatnonzero(able.to_numpy(zero_copy_only=False))
        lists = [ids.filter(able) for ids in lists]
        lists = [pa.ListArray.from_arrays(pa.array(_offsets(ids), pa.int32()), pc.list_flatten(ids)) for ids in lists]
        a, b = (_flat(ids, size, name) for ids, size, name in zip(lists, self.sizes, "ab", strict=True))

        # Every end of either tokenizer closes a stretch of bytes that lies in one token of each, and
        # two tokens share one stretch at most, so stretches are links; common ends close groups.
        met = a.join(b, "key", join_type="full outer", use_threads=False)
        met = met.take(pa.array(np.argsort(met["key"].to_numpy()))).combine_chunks()
        doc = met["key"].to_numpy() >> END_BITS
        common = pc.and_(met["a"].is_valid(), met["b"].is_valid())
        linked_a, linked_b = (pc.fill_null_backward(met[name]).cast(pa.int64()) for name in "ab")
        pair = pc.add(pc.multiply(linked_a, self.ids_b), linked_b)
        held = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])

        n = len(at)
        per_doc = {
            "n_a": np.diff(_offsets(lists[0])), "n_b": np.diff(_offsets(lists[1])),
            "n_groups": np.bincount(doc[common.to_numpy()], minlength=n),
            "n_links": np.bincount(doc, minlength=n),
        }
        whole = {}
        for name, values in per_doc.items():
            whole[name] = np.zeros(len(texts), np.int64)
            whole[name][at] = values
        digests = [""] * len(texts)
        for i, text in zip(at.tolist(), self._groups(a, b, met, common, per_doc["n_groups"]), strict=True):
            digests[i] = hashlib.sha256(text).hexdigest()
        whole["groups_sha256"] = digests
        held = pa.table({"doc": pa.array(at)[0:0].cast(pa.int64()) if not n else pa.array(at, pa.int64()).take(held["doc"]),
                         "pair": held["pair"], "times": held["count_all"]})
        return pa.table(whole), held

    def _groups(self, a: pa.Table, b: pa.Table, met: pa.Table, common: pa.ChunkedArray, n_groups: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document that has tokens."""
        closed = common.to_numpy()
        sides = []
        for tokens, name in ((a, "a"), (b, "b")):
            seen = np.cumsum(met[name].is_valid().to_numpy())[closed]  # tokens up to each common end
            sides.append(_joined(self.names.take(A.column(tokens, name)), np.concatenate([[0], seen]), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        text = _joined(groups, np.concatenate([[0], np.cumsum(n_groups)]), ";")
        return text.cast(pa.binary()).to_pylist()


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


DOCUMENT = "doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"
PACKET = f"packet long, documents array<struct<{DOCUMENT}>>, pairs array<long>, holders array<long>, held binary, times binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _packets(batches, aligner: Aligner, rules: AlignmentRules):
    """One row per packet: its documents, its id pairs, in how many documents each is, and the links."""
    number, size, rows, links, first = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for piece in A.pieces(batches, "text", rules.encode_bytes):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        documents, held = aligner.align(texts)
        rows.append(documents.add_column(0, "doc_id", piece.column("doc_id")))
        links.append(held.set_column(0, "doc", pc.add(held["doc"], first)))
        first += len(texts)
        size += A.utf8(A.column(piece, "text"))[1][-1]
        if size >= rules.packet_bytes:
            yield _packet(number, rows, links)
            number, size, rows, links, first = number + 1, 0, [], [], 0
    if rows:
        yield _packet(number, rows, links)


def _packet(number: int, rows: list[pa.Table], links: list[pa.Table]) -> pa.RecordBatch:
    held = pa.concat_tables(links).combine_chunks()
    counted = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = counted["pair"].to_numpy()
    key = held["doc"].to_numpy() * max(len(pairs), 1) + np.searchsorted(pairs, held["pair"].to_numpy())
    order = np.argsort(key)
    times = held["times"].to_numpy()[order].astype("<u4")
    documents = pa.concat_tables(rows).select(NAMES).combine_chunks().to_struct_array().combine_chunks()
    one = [pa.array([0, len(x)], pa.int32()) for x in (documents, pairs)]
    return pa.record_batch(
        [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(one[0], documents),
            pa.ListArray.from_arrays(one[1], pa.array(pairs, pa.int64())),
            pa.ListArray.from_arrays(one[1], A.column(counted, "count_all").cast(pa.int64())),
            pa.array([A.pack_sorted(key[order].astype(np.uint64))], pa.binary()),
            pa.array([pa.compress(times.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
        ],
        ["packet", "documents", "pairs", "holders", "held", "times"],
    )


def _scored(packet: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a packet with the counts of their links."""
    documents = pa.Table.from_struct_array(packet["documents"].combine_chunks().flatten())
    n_pairs = max(packet["n_pairs"][0].as_py(), 1)
    key = A.unpack_sorted(packet["held"][0].as_py()).astype(np.int64)
    planes = pa.decompress(packet["times"][0].as_py(), decompressed_size=4 * len(key), codec="zstd", asbytes=True)
    times = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    at = counts["at"].to_numpy()
    count[at], best[at] = counts["count"].to_numpy(), counts["best"].to_numpy()
    doc, pair = key // n_pairs, key % n_pairs
    for name, value in (("n_best", best), ("count_sum", count)):
        total = np.zeros(len(documents), np.int64)
        np.add.at(total, doc, times * value[pair])
        documents = documents.append_column(name, pa.array(total))
    return documents.select([f.split()[0] for f in OUT.split(", ")])


def align_tokens(docs: DataFrame, file_a: bytes, file_b: bytes, rules: AlignmentRules = AlignmentRules()) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The files are those of a byte-level BPE and of a piece model; both travel with the job. Null and
    empty texts, and those that a tokenizer changes (so that its tokens do not spell a space and
    the text), have no tokens: zeros and ''. Every row is a document of its own, also with a
    repeated or null doc_id; other columns are ignored; no rows, no rows.
    """
    texts = A.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        yield from _packets(batches, Aligner(file_a, file_b), rules)

    packets = cut(texts.mapInArrow(run, PACKET), "packets")
    ids_b = _count_pieces(file_b)
    counted = (
        packets.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("count"))
    )
    # The partners of one id are at most the ids of the other tokenizer.
    highest = F.max("count").over(Window.partitionBy(F.expr(f"pair div {ids_b}")))
    judged = counted.select("pair", "count", (F.col("count") == highest).cast("int").alias("best"))
    asked = packets.select("packet", F.posexplode("pairs").alias("at", "pair")).join(judged, "pair").select(F.col("packet").alias("of"), "at", "count", "best")
    kept = packets.select("packet", "documents", "held", "times", F.size("pairs").alias("n_pairs"))
    return kept.groupBy("packet").cogroup(asked.groupBy("of")).applyInArrow(_scored, OUT)


def _count_pieces(file: bytes) -> int:
    return len(PieceTokenizer(file).entries)
