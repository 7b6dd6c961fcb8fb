"""Incremental append without duplicates, by a digest of the key and a filter per batch folder."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from forecourt.session import scratch_path
from forecourt.sources.tables import read_table_or_none

BATCH, WRITER, DIGEST = "batch_id", "writer", "key_digest"
ROW = "key_digest_row"  # number of a row in a batch as it was written
# Folders of this name lie beside the batches; Spark does not take them for rows of the target.
FILTERS = "_filters"
CELL_BITS = 32_768  # of a filter's cell, the size of Spark's bitmaps
KEY_BITS = 32  # of a filter for each key in its folder; some six keys in a million pass wrongly
PROBES = 8  # bits of a key, all in one cell
SMALL_BATCH = 100_000  # keys whose digests, 32 bytes each, may be sent to every executor
FOLDER = f"{WRITER} string, {BATCH} long"


def key_digest(keys: list[str]) -> Column:
    """SHA-256 of the key; nulls are equal, and no two keys are spelled alike."""
    parts = [F.coalesce(F.concat(F.length(x := F.col(k).cast("string")), F.lit(":"), x), F.lit("-")) for k in sorted(keys)]
    return F.unhex(F.sha2(F.concat_ws(",", *parts), 256))


def batch_folder(target: str, batch_id: int, writer: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", writer):
        raise ValueError("a writer's name has letters, digits, _ and - only")
    return f"{target}/{WRITER}={writer}/{BATCH}={batch_id}"


def _cells(digest: Column, cells: Column) -> list[Column]:
    """The cell of a digest among so many, and its bits there."""
    return [
        F.pmod(F.xxhash64(digest, F.lit(0)), cells).alias("cell"),
        F.array(*[F.pmod(F.xxhash64(digest, F.lit(k + 1)), F.lit(CELL_BITS)) for k in range(PROBES)]).alias("bits"),
    ]


def _by_cell(rows: DataFrame) -> DataFrame:
    """The rows dealt and sorted by cell, to be joined to bitmaps.

    Bitmaps begun before the shuffle would cross it from every task, each task's nearly as large as all together.
    """
    return rows.repartition("cell").sortWithinPartitions("cell")


def _write_filter(rows: DataFrame, n: int, path: str) -> None:
    """The folder's digests as bitmaps, one row a cell."""
    cells = 1 << max(0, math.ceil(math.log2(max(1, n * KEY_BITS / CELL_BITS))))
    cell, bits = _cells(F.col(DIGEST), F.lit(cells))
    dealt = _by_cell(rows.select(DIGEST, cell)).select("cell", F.explode(bits).alias("bit"))
    bitmaps = dealt.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    bitmaps.select(F.lit(cells).alias("cells"), "cell", "bitmap").write.mode("overwrite").parquet(path)


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.call_function("getbit", byte, (bit % 8).cast("int")) == 1


def possible_folders(spark: SparkSession, target: str, digests: DataFrame) -> list[tuple[str, int]] | None:
    """(writer, batch_id) of the folders whose filter admits one of the digests; None without filters.

    The digests probe the filters of each size once, joined by cell. Folder names alone reach the driver.
    """
    filters = read_table_or_none(spark, f"{target}/{FILTERS}", f"cells long, cell long, bitmap binary, {FOLDER}")
    if filters is None:
        return None
    # Sizes are powers of two, so there are a few dozen at most.
    sizes = sorted(r[0] for r in filters.select("cells").distinct().collect())
    asked = digests.select(DIGEST, F.explode(F.array(*map(F.lit, sizes))).alias("cells"))
    probes = asked.select("cells", *_cells(F.col(DIGEST), F.col("cells")))
    met = filters.join(F.broadcast(probes), ["cells", "cell"])
    admitted = met.filter(F.forall("bits", lambda bit: _is_set(F.col("bitmap"), bit)))
    return sorted((r[0], r[1]) for r in admitted.select(WRITER, BATCH).distinct().collect())


def stored_digests(spark: SparkSession, target: str, folders: list[tuple[str, int]] | None) -> DataFrame | None:
    """The digests of some folders, or of all; None if there is nothing to read. Reads no other column."""
    if folders is None:
        return read_table_or_none(spark, target, f"{DIGEST} binary, {FOLDER}")
    paths = [batch_folder(target, batch_id, writer) for writer, batch_id in folders]
    return spark.read.schema(f"{DIGEST} binary, {FOLDER}").option("basePath", target).parquet(*paths) if paths else None


def unknown_digests(arriving: DataFrame, stored: DataFrame, small: bool) -> DataFrame:
    """The arriving rows whose digest is not stored.

    A small batch sends its digests to the tasks that scan the target, which hand back those they
    hold: the target is not shuffled. A large one meets the target's digests in a shuffle join.
    """
    digests = arriving.select(DIGEST)
    held = stored.select(DIGEST).join(F.broadcast(digests) if small else digests, DIGEST, "left_semi").distinct()
    return arriving.join(held, DIGEST, "left_anti")


def _rows_at(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows with the numbers given, where they lie: the numbers go to every task as bitmaps, a bit a row."""

    def place(number: Column) -> tuple[Column, Column]:
        return F.shiftright(number, CELL_BITS.bit_length() - 1), number.bitwiseAND(CELL_BITS - 1)

    cell, bit = place(F.col(ROW))
    dealt = _by_cell(numbers.select(cell.alias("cell"), bit.alias("bit")))
    bitmaps = F.broadcast(dealt.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    cell, bit = place(rows[ROW])
    met = rows.join(bitmaps, cell == bitmaps["cell"]).filter(_is_set(bitmaps["bitmap"], bit))
    return met.select(*[rows[c] for c in rows.columns])


def append_new(
    batch: DataFrame, target: str, keys: list[str], batch_id: int, writer: str, small_batch: int = SMALL_BATCH
) -> DataFrame:
    """Add the rows of the batch whose key the target lacks; returns the rows added.

    Every batch of a writer is a folder `writer=w/batch_id=n` of the target, written by overwriting
    that folder alone, with the digest of its key in each row and a filter of the digests beside it.
    Folders whose filter admits none of the batch's keys are not read. A filter is written before
    its rows, and holds all keys that its folder may get, so a folder is never left out wrongly.

    A repeated batch, after a lost driver for example, compares with all other folders and replaces
    what it wrote before. The name tells writers apart: batches of different writers never share a
    folder, so none overwrites or leaves out rows of another. One writer must not number two
    different batches alike. Writers that run at the same time don't see each other. All rows of a
    target must come by this function, with the same keys.

    The batch is written once as it comes. Digests and row numbers alone are shuffled, to find one
    row for each key that is new; those rows are then taken from the written batch.
    """
    path = batch_folder(target, batch_id, writer)
    spark = batch.sparkSession
    cut, firsts = scratch_path(spark, "arriving"), scratch_path(spark, "arriving-keys")
    batch.withColumns({DIGEST: key_digest(keys), ROW: F.monotonically_increasing_id()}).write.parquet(cut)
    whole = spark.read.parquet(cut)
    whole.groupBy(DIGEST).agg(F.min(ROW).alias(ROW)).write.parquet(firsts)
    arriving = spark.read.parquet(firsts)
    n = arriving.count()
    small = n <= small_batch
    folders = possible_folders(spark, target, arriving) if small else None
    if folders is not None:
        folders = [f for f in folders if f != (writer, batch_id)]
    stored = stored_digests(spark, target, folders)
    fresh = arriving
    if stored is not None:
        others = stored.filter(~((F.col(WRITER) == writer) & (F.col(BATCH) == batch_id)))
        fresh = unknown_digests(arriving, others, small)
    _write_filter(arriving, n, f"{target}/{FILTERS}/{WRITER}={writer}/{BATCH}={batch_id}")
    _rows_at(whole, fresh).select(*batch.columns, DIGEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(batch.schema).parquet(path)
