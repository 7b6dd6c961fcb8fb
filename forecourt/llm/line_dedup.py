"""Removal of repeated runs of lines.

`dedup_lines` starts from every two lines in a row: those that occur elsewhere, byte for byte, are
the parts of all repeated runs of two lines and more, and where they follow each other they add up
to the whole run.

`dedup_chunks` is the rule that the SQL of op2_line_dedup states. The lines of a text are hashed; a
rolling hash over the last few line hashes places the boundaries between chunks, so an inserted line
moves the boundaries near it only. Chunks of several lines that occur elsewhere are removed, but for
the first, once their bytes have been compared. A short run between other lines mostly shares its
chunks with them and stays.

Everything is done by expressions of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.operators.columns import evaluate_once

REACH = 3  # lines under the rolling hash
SKIP = 8  # low bits of the rolling hash left out, as they depend on the last line only
MASK = 3  # a boundary in one of MASK + 1 lines


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _rolled_in(bits: int):
    return lambda rolled, older: rolled.bitwiseXOR(F.shiftleft(older, bits))


def _chunks(hashes: Column, lines: Column) -> tuple[Column, Column]:
    """(last line of each chunk, the line before its first), line numbers from 0."""
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), REACH - 1), hashes)
    size = F.size(lines)
    rolled = F.slice(padded, F.lit(REACH), size)
    for back in range(1, REACH):
        older = F.slice(padded, F.lit(REACH - back), size)
        rolled = F.zip_with(rolled, older, _rolled_in(back))
    marked = F.transform(
        rolled, lambda h, i: F.when(F.shiftright(h, SKIP).bitwiseAND(F.lit(MASK).cast("long")) == 0, i)
    )
    ends = F.array_distinct(F.concat(F.filter(marked, lambda i: i.isNotNull()), F.array(size - 1)))
    return ends, F.concat(F.array(F.lit(-1)), ends)


def _repeats(found: DataFrame) -> DataFrame:
    """(_gone_id, _gone_key, _gone): the places of each text whose `_chunk` has an earlier copy, by bytes."""
    found = found.withColumn("_digest", F.sha2("_chunk", 256))
    where = F.struct("doc_id", "_key", "_place")
    repeated = (
        found.groupBy("_digest")
        .agg(F.min("_chunk").alias("_least"), F.max("_chunk").alias("_most"), F.min(where).alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & (F.col("_least") == F.col("_most")))
        .select("_digest", "_first")
    )
    again = found.select("_digest", "doc_id", "_key", "_place").join(repeated, "_digest").filter(~where.eqNullSafe(F.col("_first")))
    return again.groupBy(F.col("doc_id").alias("_gone_id"), F.col("_key").alias("_gone_key")).agg(
        F.collect_set("_place").alias("_gone")
    )


def _same_text() -> Column:
    return (F.col("_key") == F.col("_gone_key")) & F.col("doc_id").eqNullSafe(F.col("_gone_id"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without repeated runs of lines, and n_lines, n_removed (lines).

    A text is split at line feeds; lines differ if any byte does. Two lines in a row that also occur
    in a row elsewhere, in the same text or another, are removed everywhere but at their first
    occurrence by (doc_id, hash of the text, place); a null doc_id comes first. So each later copy of
    a run of two lines and more goes as a whole, whatever stands around it, and each line removed has
    a copy that stays. A single line stays, and so do two lines in a row without a word, unless a
    repeated run holds them. Pairs are sought by a 64-bit hash and removed as chunks are in
    `dedup_chunks`, which also says what becomes of nulls, empty texts, repeated rows and columns.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    given = docs.select(*kept_columns).withColumn("_key", F.xxhash64("doc_id", "text"))
    lines = {"_lines": F.split(F.col("text"), "\n", -1)}

    several = evaluate_once(given.select("doc_id", "text", "_key").filter(F.col("text").contains("\n")), lines)
    pairs = F.zip_with(
        F.slice("_lines", F.lit(1), F.size("_lines") - 1),
        F.slice("_lines", F.lit(2), F.size("_lines") - 1),
        lambda a, b: F.when(a.rlike(r"\S") | b.rlike(r"\S"), F.concat(a, F.lit("\n"), b)),
    )
    found = several.select("doc_id", "_key", F.posexplode(pairs).alias("_place", "_chunk")).filter(F.col("_chunk").isNotNull())
    found = found.withColumn("_seed", F.xxhash64("_chunk"))
    seeds = found.groupBy("_seed").agg(F.count("*").alias("_n")).filter("_n > 1").select("_seed")
    gone = _repeats(found.join(seeds, "_seed").drop("_seed"))

    rows = evaluate_once(given.join(gone, _same_text(), "left"), lines)
    lost = F.array_union(F.col("_gone"), F.transform("_gone", lambda i: i + 1))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), lost), lambda i: F.get("_lines", i))
    rows = evaluate_once(rows, {"_stay": F.when(F.col("_gone").isNotNull(), stay), "_n_lines": F.size("_lines").cast("long")})
    zero = F.lit(0).cast("long")
    return rows.select(
        *[F.coalesce(F.array_join("_stay", "\n"), F.col("text")).alias(c) if c == "text" else F.col(c) for c in kept_columns],
        F.when(F.col("text").isNull(), zero).otherwise(F.col("_n_lines")).alias("n_lines"),
        F.when(F.col("_gone").isNotNull(), F.col("_n_lines") - F.size("_stay")).otherwise(zero).alias("n_removed"),
    )


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """All columns of docs, text without repeated chunks, and n_lines, n_removed (lines).

    A text is split at line feeds; lines differ if any byte does. A chunk of at least two lines that
    also occurs elsewhere, in the same text or another, is removed everywhere but at its first
    occurrence by (doc_id, hash of the text, place); a null doc_id comes first. Chunks are found by
    SHA-256 and removed only if all chunks with that digest have the same bytes. Chunks of one line
    stay. A null text stays null with 0 lines; an empty text is one empty line. A text whose chunks
    all go becomes empty; its row stays. Rows that repeat with one id and text count as one
    document. Columns n_lines and n_removed of the input are replaced; others pass through.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    given = docs.select(*kept_columns).withColumn("_key", F.xxhash64("doc_id", "text"))

    def chunked(rows: DataFrame) -> DataFrame:
        rows = evaluate_once(rows, {"_lines": F.split(F.col("text"), "\n", -1)})
        rows = evaluate_once(rows, {"_hashes": F.transform("_lines", _line_hash)})
        ends, before = _chunks(F.col("_hashes"), F.col("_lines"))
        rows = evaluate_once(rows, {"_ends": ends, "_before": before})
        before = F.slice("_before", F.lit(1), F.size("_ends"))
        spans = F.zip_with("_ends", before, lambda e, b: F.struct(e.alias("end"), b.alias("before")))
        text = F.transform(
            spans,
            lambda s: F.struct(
                (s["end"] - s["before"]).alias("lines"),
                F.array_join(F.slice("_lines", s["before"] + 2, s["end"] - s["before"]), "\n").alias("chunk"),
            ),
        )
        rows = evaluate_once(rows, {"_chunks": text, "_n_lines": F.size("_lines").cast("long")})
        return rows.drop("_lines", "_hashes", "_ends", "_before")

    several = chunked(given.select("doc_id", "text", "_key").filter(F.col("text").contains("\n")))
    found = several.select("doc_id", "_key", F.posexplode("_chunks").alias("_place", "_chunk")).filter("_chunk.lines > 1")
    gone = _repeats(found.select("doc_id", "_key", "_place", F.col("_chunk.chunk").alias("_chunk")))
    rows = chunked(given.join(gone, _same_text(), "left"))
    stay = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_chunks") - 1), F.col("_gone")), lambda i: F.get("_chunks", i)
    )
    rows = evaluate_once(rows, {"_stay": F.when(F.col("_gone").isNotNull(), stay)})
    left = F.aggregate("_stay", F.lit(0).cast("long"), lambda n, c: n + c["lines"])
    text = F.array_join(F.transform("_stay", lambda c: c["chunk"]), "\n")
    n_lines = F.coalesce("_n_lines", F.lit(0).cast("long"))
    return rows.select(
        *[F.coalesce(text, F.col("text")).alias(c) if c == "text" else F.col(c) for c in kept_columns],
        F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"),
        F.when(F.col("_gone").isNotNull(), F.col("_n_lines") - left).otherwise(F.lit(0).cast("long")).alias("n_removed"),
    )
