"""A bit table of fixed size over hashes, made by Spark page by page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PAGE = 16


def bitmap(values: DataFrame, bits: int) -> bytes:
    """One bit for each remainder modulo 2**bits (over 16) that the only column of `values` has.

    It has 2**bits / 8 bytes at any size of the input, and no more comes to the driver, in one job. A set bit may stand for several hashes, so
    it lets too much through at worst, and never loses any.
    """
    place = F.col(values.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    pages = values.select(
        F.shiftright(place, PAGE).cast("int").alias("page"), place.bitwiseAND(F.lit((1 << PAGE) - 1)).cast("int").alias("at")
    )

    def page(found):
        marks = np.zeros(1 << PAGE, bool)
        marks[found.column("at").to_numpy()] = True
        return pa.table({"page": found.column("page").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    whole, size = bytearray((1 << bits) // 8), (1 << PAGE) // 8
    for row in pages.distinct().groupBy("page").applyInArrow(page, "page int, marks binary").collect():
        whole[row["page"] * size : (row["page"] + 1) * size] = row["marks"]
    return bytes(whole)


def marks(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
