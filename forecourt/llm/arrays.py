"""Words, their hashes and hashes of word windows as numpy arrays over an Arrow column of texts.

A word is a run of bytes other than the six ASCII white-space bytes. Nothing here looks at one
row at a time; words of over LONG bytes, which are rare, are hashed one by one.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONG = 48
BATCH_ROWS = 500
_U = np.uint64


class Words(NamedTuple):
    data: np.ndarray  # all bytes of all texts
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one more entry closes the last text
    offsets: np.ndarray  # of each text, its first byte; one more entry closes the last text


def lean() -> None:
    """Freed blocks of over 1 MB go back to the system at once.

    Otherwise each worker keeps the most that any of its tasks ever held, also while it is idle.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has this call
        ctypes.CDLL(None).mallopt(-3, 1 << 20)


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; from now on its session hands at most BATCH_ROWS rows to Python at once.

    Texts are large values, and the usual 10,000 of them in one batch would fill the memory that an
    executor has beside its heap, once for the batch and once for its copy in Python.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    values = table.column(name)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
        if isinstance(values, pa.ChunkedArray):
            values = values.chunk(0) if values.num_chunks else pa.array([], values.type)
    return values


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batches, name: str, limit: int = 4 << 20):
    """The batches in slices of at most `limit` bytes of text, or one row."""
    lean()
    for batch in batches:
        _, offsets = utf8(column(batch, name))
        low, n = 0, batch.num_rows
        while low < n:
            high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
            high = min(max(high, low + 1), n)
            yield batch.slice(low, high - low)
            low = high


def words(texts: pa.Array) -> Words:
    lean()
    data, offsets = utf8(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~space
    begins = solid.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= space[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(found: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; `lower` takes A-Z as a-z."""
    data = found.data
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    size = found.end - found.start
    out = np.full(len(size), 0xCBF29CE484222325, _U)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    start, sizes = found.start[order], size[order]
    whole = np.searchsorted(-sizes, -LONG, side="left")  # the words before this one are longer
    rolled = out[order]
    most = int(sizes[whole]) if whole < len(sizes) else 0
    for j in range(most):
        alive = int(np.searchsorted(-sizes, -j, side="left"))
        rolled[whole:alive] = (rolled[whole:alive] ^ data[start[whole:alive] + j]) * _U(0x100000001B3)
    for i in range(whole):
        text = data[start[i] : start[i] + sizes[i]].tobytes()
        rolled[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
    out[order] = rolled
    return mix(out ^ (size.astype(_U) << _U(48)))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n values from each position on; positions without n values are left out."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    block, width, out, done = hashes, 1, None, 0
    while True:
        if n & width:
            part = block[done : done + len(hashes) - n + 1]
            out = part.copy() if out is None else mix(out * _U(0x9E3779B97F4A7C15) + part)
            done += width
        if done == n:
            return mix(out)
        block = mix(block[:-width] * _U(0xD6E8FEB86659FD93) + block[width:])
        width *= 2


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """The positions of words from which n words lie in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.ones(total, bool)
    for back in range(1, n):
        at = first[1:] - back
        ok[at[at >= first[:-1]]] = False
    return np.flatnonzero(ok)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers, less than 2**32 apart, as compressed differences."""
    steps = np.diff(values, prepend=values[:1]).astype("<u4")
    head = np.array([len(values), values[0] if len(values) else 0], "<u8").tobytes()
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_sorted(packed: bytes) -> np.ndarray:
    n, least = np.frombuffer(packed[:16], "<u8")
    n = int(n)
    planes = pa.decompress(packed[16:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=_U) + _U(least)


def pack_bits(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(8, "little") + pa.compress(np.packbits(mask).tobytes(), codec="zstd", asbytes=True)


def unpack_bits(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], decompressed_size=(n + 7) // 8, codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
