"""N-gram Jaccard join by parity sketches, without losing a pair.

A set of shingles is cut into K segments by hash; the XOR of the hashes in a segment is its parity.
One shingle more or less changes one segment, so two sets differ in at most as many segments as
their symmetric difference has members. For a band of set sizes the similarity bounds that
difference by d, so of more than d segments one at least agrees, and pairs are found by joining
equal segments. The segments number d + 1 and a few more, so that a set may leave out segments that
are empty, which would agree with everyone's. A sketch of one parity bit per cell bounds the
difference again, by its Hamming distance, before whole sets are compared.

Sets that agree in a segment first meet the least set among them only; once the links found so
have been joined to components, sets of different components that share a segment meet each other.
A group of many near copies therefore costs a star of comparisons, not all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.bitmaps import bitmap, marks
from forecourt.llm.components import connected_components, cut, two_levels

_U = np.uint64
SKETCH_BITS = 512
TILE_BYTES = 8 << 20  # of sketches or sets that one task holds of either side of a tile of pairs, about
LEAST_TILES = 4
FLUSH = 1 << 19  # segments that a task holds before it sends them
BITMAP_BITS = 24
IDS = "doc_id long, print long, n long, class long, sketch array<long>, wide binary"
SEGMENTS = "block int, payload binary"
MET = "kind int, key long, a long, b long"


class Bands:
    """Bands of set sizes such that similar sets lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], [den // num]

    def grow(self, n: int) -> None:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)

    def segments(self, band: int) -> tuple[int, int]:
        """(segments of a band, empty segments that a set may leave out)."""
        self.grow(self.high[-1] + 1) if band >= len(self.low) else None
        most = 2 * self.high[band] * (self.den - self.num) // (self.den + self.num)
        spare = 0 if most == 0 else 1 + most // 25
        return most + 1 + spare, spare


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, ascending within each text; the first of each text and the end)."""
    found = A.words(texts)
    hashes = A.word_hashes(found, lower=True)
    n_words = np.diff(found.first)
    at = A.inside(found.first, size)
    values = A.window_hashes(hashes, size)[at]
    owner = np.searchsorted(found.first, at, side="right") - 1
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        whole = []
        for i in short.tolist():
            value = np.array([n_words[i]], _U)
            for h in hashes[found.first[i] : found.first[i + 1]]:
                value = A.mix(value * _U(0x9E3779B97F4A7C15) + h)
            whole.append(value[0])
        values, owner = np.concatenate([values, np.array(whole, _U)]), np.concatenate([owner, short])
    order = np.argsort(values)
    mine = owner[order]
    order = order[np.argsort(mine.astype(np.uint16) if len(n_words) < 65536 else mine, kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n_words) + 1))


def _classes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set; 0 for empty sets."""
    n = np.diff(first)
    out = np.zeros(len(n), _U)
    some = np.flatnonzero(n)
    if len(some):
        mixed = A.mix(values + _U(0x632BE59BD9B4E019))
        starts = first[:-1][some]
        sums = np.add.reduceat(mixed, starts)
        xors = np.bitwise_xor.reduceat(A.mix(mixed ^ _U(0xA5A5A5A5A5A5A5A5)), starts)
        out[some] = A.mix(sums ^ A.mix(xors + n[some].astype(_U)))
        out[some] += out[some] == 0
    return out


def _sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, longs): parity of the shingles in each of SKETCH_BITS cells."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    cell = (A.mix(values ^ _U(0x1234567890ABCDEF)) & _U(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * SKETCH_BITS + cell, minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view("<i8")


def _segment_keys(values: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key of each segment sent, the set it belongs to)."""
    n = np.diff(first)
    if not n.any():
        return np.zeros(0, _U), np.zeros(0, np.int64)
    bands.grow(int(n.max()) * 2 + 2)
    band = np.searchsorted(np.array(bands.low), np.maximum(n, 1), side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    mixed = A.mix(values ^ _U(0x0F1E2D3C4B5A6978))
    keys, sets = [], []
    for step in (0, 1):  # as a member of its band, and as the smaller one beside the next
        tag = band + step
        use = (n > 0) & ((step == 0) | (n * bands.den // bands.num >= np.array(bands.low)[tag]))
        table = np.array([bands.segments(b) for b in range(len(bands.low))], np.int64)
        segments, spare = table[tag, 0], table[tag, 1]
        chosen = use[owner]
        who = owner[chosen]
        if not len(who):
            continue
        place = ((values[chosen] >> _U(32)) * segments[who].astype(_U)) >> _U(32)
        new = np.ones(len(who), bool)
        new[1:] = (place[1:] != place[:-1]) | (who[1:] != who[:-1])
        start = np.flatnonzero(new)
        parity = np.bitwise_xor.reduceat(mixed[chosen], start)
        holder, part = who[start], place[start]
        code = (tag[holder].astype(_U) << _U(40)) + part
        keys.append(A.mix(parity + A.mix(code)))
        sets.append(holder)
        empty = np.where(use, segments - np.bincount(holder, minlength=len(n)), 0)
        for i in np.flatnonzero(empty > spare).tolist():  # too many empty ones: these must count as well
            filled = part[holder == i].astype(np.int64)
            missing = np.setdiff1d(np.arange(segments[i]), filled).astype(_U)
            keys.append(A.mix(A.mix((_U(int(tag[i])) << _U(40)) + missing)))
            sets.append(np.full(len(missing), i))
    return np.concatenate(keys), np.concatenate(sets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64), pa.int64())


def _met(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    columns = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(4)]
    return pa.table({c: pa.array(x.astype(np.int32 if i == 0 else np.int64), k) for i, (c, x, k) in enumerate(zip(("kind", "key", "a", "b"), columns, kinds, strict=True))})


def _meet_least(found: pa.Table) -> pa.Table:
    """Of segments that several sets share: (1, key, set, 0) for each, and (0, 0, least set, set)."""
    A.lean()
    pairs = np.concatenate([np.frombuffer(p, "<i8").reshape(2, -1) for p in found.column("payload").to_pylist()], axis=1)
    order = np.lexsort((pairs[1], pairs[0]))
    key, member = pairs[0][order], pairs[1][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
    key, member = key[new], member[new]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    run = np.cumsum(start) - 1
    shared = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    least = member[np.flatnonzero(start)][run] if len(run) else member
    key, member, least = key[shared], member[shared], least[shared]
    star = np.unique(np.stack([least, member], axis=1)[least != member], axis=0)
    zeros, ones = np.zeros(len(star), np.int64), np.ones(len(key), np.int64)
    return _met([(zeros, zeros, star[:, 0], star[:, 1]), (ones, key, member, 0 * member)])


def _similar(one: np.ndarray, two: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return den * common >= num * (len(one) + len(two) - common)


def _wide_sketches(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity of the shingles of each set in as many cells as suit its size: one to two a shingle.

    Two sets of n without a common shingle differ in four of ten of so many cells or more, and
    similar ones in two of ten shingles at most, so a wide sketch never fills up.
    """
    out, cells = [], A.mix(values ^ _U(0x0BADC0DE5EED1234))
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        width = max(1 << (high - low).bit_length(), SKETCH_BITS)
        cell = (cells[low:high] & _U(width - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(cell, minlength=width) & 1).astype(np.uint8)).tobytes())
    return out


def _side_by_side(packed: list[bytes]) -> np.ndarray:
    """Wide sketches as one matrix; wider ones are folded to the width of the narrowest, cell on cell."""
    width = min(map(len, packed)) // 8
    folded = [np.bitwise_xor.reduce(np.frombuffer(p, _U).reshape(-1, width), axis=0) for p in packed]
    return np.stack(folded)


def _near(one: bytes, two: bytes, n_one: int, n_two: int, num: int, den: int) -> bool:
    """Wide sketches leave the similarity possible."""
    bits = _side_by_side([one, two])
    return int(np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64)) <= (n_one + n_two) * (den - num) // (den + num)


def _alike(one: bytes, two: bytes, n_one: int, n_two: int, num: int, den: int) -> bool:
    """Whole sets have the similarity."""
    return _similar(np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8"), num, den)


def compared(pairs: DataFrame, bodies: DataFrame, test, num: int, den: int, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The pairs (a, b) whose bodies (class, n, body) pass the test.

    Classes are dealt into tiles by hash, and the pairs between two tiles are one group, to which
    each body goes once, however many pairs it is in. The more bytes, the more tiles, so that a
    group holds about two tiles of bodies at any size; a class with very many partners meets them
    in as many groups as there are tiles.
    """
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    held = cut(ends.join(bodies, "class").select("class", "n", "body"), "bodies")
    total = held.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    tiles = max(LEAST_TILES, math.ceil(total / tile_bytes))

    def tile(name: str):
        return F.pmod(F.xxhash64(F.lit(11), F.col(name)), F.lit(tiles))

    tiled = pairs.select("a", "b", tile("a").alias("ta"), tile("b").alias("tb"))
    wanted = tiled.select(F.col("a").alias("class"), "ta", "tb").union(tiled.select("b", "ta", "tb")).distinct()
    sent = wanted.join(held, "class").select("class", "n", "body", F.col("ta").alias("xa"), F.col("tb").alias("xb"))

    def run(group: pa.Table, bodies: pa.Table) -> pa.Table:
        A.lean()
        at = {c: i for i, c in enumerate(bodies.column("class").to_pylist())}
        body, n = bodies.column("body"), bodies.column("n").to_pylist()
        passed = []
        for a, b in zip(group.column("a").to_pylist(), group.column("b").to_pylist(), strict=True):
            i, j = at[a], at[b]
            passed.append(test(body[i].as_py(), body[j].as_py(), n[i], n[j], num, den))
        return group.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return tiled.groupBy("ta", "tb").cogroup(sent.groupBy("xa", "xb")).applyInArrow(run, "a long, b long")


def _cross_pairs(num: int, den: int, spanning: bool):
    """Pairs of different components in a segment that sizes and wide sketches allow.

    Spanning takes such pairs for links, and gives as many as would join the components.
    """

    def run(found):
        A.lean()
        key, member, root, size = (found.column(c).to_numpy() for c in ("key", "class", "root", "n"))
        packed = found.column("wide").to_pylist()
        pairs: set[tuple[int, int]] = set()
        order = np.lexsort((root, key))
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            bits = _side_by_side([packed[r] for r in rows.tolist()])
            n = size[rows]
            _, group, count = np.unique(root[rows], return_inverse=True, return_counts=True)
            group = group.ravel()
            for i in np.flatnonzero(group != count.argmax()).tolist():
                others = np.flatnonzero((group != group[i]) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num))
                far = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = others[far <= (n[others] + n[i]) * (den - num) // (den + num)]
                while len(near):
                    j, near = near[0], near[1:]
                    a, b = int(member[rows[i]]), int(member[rows[j]])
                    pairs.add((min(a, b), max(a, b)))
                    if spanning:
                        group[group == group[j]] = group[i]
                        near = near[group[near] != group[i]]
        out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    return run


def ngram_jaccard_groups(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document doc_id, n_shingles, component_id, of all pairs with den * common >= num * union.

    A set holds the distinct shingles of `size` words, A-Z in lower case; a text with fewer words is
    one shingle; a null text, an empty one and one without words have the empty set, which links
    with nothing. Texts with equal sets are one class and link; the same text under several ids
    and repeated rows too. component_id is the least doc_id that links reach, its own without
    links; a null doc_id links nothing together and has none. Every row gives a row; other columns
    are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    texts = A.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))

    def identify(batches):
        for piece in A.pieces(batches, "text", 2 << 20):
            values, first = shingle_sets(A.column(piece, "text"), size)
            sketches = _sketches(values, first)
            width = sketches.shape[1]
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    piece.column("print"),
                    pa.array(np.diff(first), pa.int64()),
                    _signed(_classes(values, first)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1) * width, pa.int32()), pa.array(sketches.ravel(), pa.int64())),
                    pa.array(_wide_sketches(values, first), pa.binary()),
                ],
                ["doc_id", "print", "n", "class", "sketch", "wide"],
            )

    ids = cut(texts.mapInArrow(identify, IDS), "sets")
    total = int(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_bytes))

    def send(batches):
        bands = Bands(num, den)
        keys, classes, seen, held = [], [], set(), 0

        def flush():
            key, member = np.concatenate(keys), np.concatenate(classes)
            block = ((key >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            names, low = np.unique(block[order], return_index=True)
            parts = np.split(order, low[1:])
            packed = [np.stack([key[p], member[p]]).view("<i8").tobytes() for p in parts]
            return pa.record_batch([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["block", "payload"])

        for piece in A.pieces(batches, "text", 2 << 20):
            values, first = shingle_sets(A.column(piece, "text"), size)
            whole = _classes(values, first)
            _, once = np.unique(whole, return_index=True)
            fresh = np.zeros(len(whole), bool)
            fresh[[i for i in once.tolist() if whole[i] and int(whole[i]) not in seen]] = True
            seen.update(whole[fresh].tolist())
            take = np.repeat(fresh, np.diff(first))
            kept = np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
            key, member = _segment_keys(values[take], kept, bands)
            if len(key):
                keys.append(key)
                classes.append(whole[fresh][member])
                held += len(key)
            if held > FLUSH:
                yield flush()
                keys, classes, seen, held = [], [], set(), 0
        if held:
            yield flush()

    met = cut(texts.mapInArrow(send, SEGMENTS).groupBy("block").applyInArrow(_meet_least, MET), "met")
    sets = ids.filter("n > 0").select("class", "print", "n", "sketch", "wide").dropDuplicates(["class"])

    def allowed(pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches leave the similarity possible: short sketches first, then wide ones."""
        one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        near = (apart <= F.floor((F.col("na") + F.col("nb")) * (den - num) / (den + num)))
        alike = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
        short = cut(pairs.join(one, "a").join(two, "b").filter(alike & near).select("a", "b"), "near")
        return compared(short, sets.select("class", "n", F.col("wide").alias("body")), _near, num, den)

    def members_of(classes: DataFrame) -> DataFrame:
        """The shingles of classes, one row each, out of one text of each; a few more classes come along."""
        prints = sets.join(classes.distinct(), "class", "left_semi").select("print")
        wanted = bitmap(prints, BITMAP_BITS)

        def fetch(batches):
            bits = marks(wanted)
            for piece in A.pieces(batches, "text", 2 << 20):
                prints = piece.column("print").to_numpy().view(_U)
                found = piece.filter(pa.array(bits[(prints & _U((1 << BITMAP_BITS) - 1)).astype(np.int64)]))
                values, first = shingle_sets(A.column(found, "text"), size)
                whole = _classes(values, first)
                at = np.unique(whole, return_index=True)[1]
                at = at[whole[at] > 0]
                packed = [values[first[i] : first[i + 1]].tobytes() for i in at.tolist()]
                yield pa.record_batch([_signed(whole[at]), pa.array(packed, pa.binary())], ["class", "members"])

        return texts.mapInArrow(fetch, "class long, members binary").dropDuplicates(["class"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar."""
        members = members_of(pairs.select(F.col("a").alias("class")).union(pairs.select("b")))
        bodies = members.select("class", (F.octet_length("members") / 8).cast("long").alias("n"), F.col("members").alias("body"))
        return compared(pairs, bodies, _alike, num, den)

    stars = cut(allowed(met.filter("kind = 0").select("a", "b").distinct()), "stars")
    links = cut(verified(stars), "links")
    groups = two_levels(links)

    # What shares a segment and is still apart: first as many pairs as would join it, if wide sketches
    # are right. Where whole sets refuse some of these, stars that were refused before among them,
    # all pairs of the segments concerned follow.
    shared = met.filter("kind = 1").select("key", F.col("a").alias("class"))
    tested = stars
    for spanning in (True, False):
        rooted = shared.join(groups.select(F.col("node").alias("class"), "component"), "class", "left")
        rooted = rooted.select("key", "class", F.coalesce("component", "class").alias("root"))
        split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        unsettled = rooted.join(split, "key", "left_semi")
        dealt = unsettled.join(sets.select("class", "n", "wide"), "class")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(16 * blocks)))
        dealt = dealt.select("block", "key", "class", "root", "n", "wide")
        chosen = cut(dealt.groupBy("block").applyInArrow(_cross_pairs(num, den, spanning), "a long, b long").distinct(), "cross")
        some = bool(chosen.head(1))
        if some:
            fresh = cut(chosen.join(tested, ["a", "b"], "left_anti"), "fresh")
            if fresh.head(1):
                links = links.union(cut(verified(fresh), "links"))
        if some or spanning:
            groups = connected_components(links)
        if not (some and spanning):
            break
        refused = chosen.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("class")).distinct()
        if not refused.head(1):
            break
        tested = tested.union(fresh)
        shared = shared.join(shared.join(refused, "class", "left_semi").select("key").distinct(), "key", "left_semi")

    least = ids.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = least.join(groups.select(F.col("node").alias("class"), "component"), "class", "left")
    rooted = rooted.select("class", "least", F.coalesce("component", "class").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(lowest, "root").select("class", "component_id")
    out = ids.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(known, "class", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs without those that link to a smaller doc_id, however far.

    Of rows that repeat with one id and text all stay or go together. Rows with a null id stay.
    """
    gone = ngram_jaccard_groups(docs, **how).filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
