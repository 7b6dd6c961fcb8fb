"""How far the sources of a language diverge, by exact shares of their terms.

Tasks count the terms of their texts and hand on sums. The kept terms of a language are dealt into
blocks; for every block and pair of tiles of sources, one task builds the hash-consed segment trees
of the sources in it and prices every pair of them by a memoised traversal. Prices of blocks add up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.components import cut
from forecourt.llm.segment_trees import Forest

# Every byte that is no letter becomes a space, A-Z become a-z; bytes from 0x80 belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
HELD_TERMS = 200_000  # counts that a task holds before it hands them on
SLICE_BYTES = 4 << 20  # of a text that is split into terms at once


@dataclass(frozen=True)
class AuditRules:
    least_docs: int = 3  # a term is kept if so many documents of its language hold it
    top_terms: int = 200  # ranks reported in the part `term`
    block_terms: int = 8192  # terms of a tree, about
    tile_sources: int = 48  # sources whose trees one task holds twice, about


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term.

    Each group has a row with term null besides, also without terms. Every row is a document.
    """
    given = A.small_batches(docs).select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches):
        A.lean()
        counts, documents, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for i in range(batch.num_rows):
                group = (batch.column("lang")[i].as_py(), batch.column("source")[i].as_py())
                mine = _terms_of(batch.column("text")[i].as_py().translate(TERM_BYTES))
                held += group not in counts
                n, d = counts[group], documents[group]
                held -= len(n)
                n.update(mine)
                d.update(mine.keys())
                held += len(n)
                if held > HELD_TERMS:
                    yield from _rows(counts, documents)
                    held = 0
        yield from _rows(counts, documents)

    parts = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _terms_of(letters: bytes) -> Counter:
    """The counts of the terms, of a very long text slice by slice."""
    out, at = Counter(), 0
    while at < len(letters):
        end = letters.find(b" ", at + SLICE_BYTES)
        end = len(letters) if end < 0 else end
        out.update(letters[at:end].split())
        at = end
    return out


def _rows(counts: dict, documents: dict):
    for (lang, source), n in counts.items():
        d = documents[(lang, source)]
        terms = [*n.keys(), None]
        yield pa.record_batch(
            [
                pa.array([lang] * len(terms), pa.string()),
                pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([*n.values(), 0], pa.int64()),
                pa.array([*(d[t] for t in n), 0], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )
    counts.clear()
    documents.clear()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """As `segment_trees.shares`: exact in 64 bits up to some 90 trillion terms."""
    whole, first = total + kept, (n + 1) * 100_000
    return 1 + F.call_function("div", first, whole) * 10_000 + F.call_function("div", first % whole * 10_000, whole)


def _dealt(value: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(value), parts)


def source_divergence(docs: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """lang, source, part, item, value, rank of every occurring (lang, source).

    Null text, lang and source are read as ''. Part `pair` prices the group against every other
    source of its language over all kept terms, at all ranks; part `term` has the terms that the
    group holds more of than its language, to `top_terms` ranks. Ranks go by value downwards, then
    by the bytes of item. Repeated rows count each; other columns are ignored; no rows, no rows.
    A language without kept terms prices every pair 0.
    """
    counted = cut(term_counts(docs), "terms")
    kept = (
        counted.filter(F.col("term").isNotNull()).groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= rules.least_docs).drop("docs")
    )
    groups = counted.filter(F.col("term").isNull()).select("lang", "source")
    # One row a language: how many kept terms it has, in how many blocks and tiles.
    langs = (
        groups.groupBy("lang").agg(F.count("*").alias("sources"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        .na.fill(0)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / rules.block_terms)).cast("int"))
        .withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("sources") / rules.tile_sources)).cast("int"))
    )
    langs = cut(langs, "langs")
    order = Window.partitionBy("lang", "block").orderBy(F.col("lang_n").desc(), "term")
    numbered = (
        kept.join(langs.select("lang", "blocks"), "lang")
        .select("lang", "term", "lang_n", _dealt(F.col("term"), F.col("blocks")).alias("block"))
        .withColumn("place", F.row_number().over(order) - 1)
    )
    found = cut(counted.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "kept")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang"), "groups")
    return _pairs(found, groups).unionByName(_terms(found, groups, rules))


def _pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """The part `pair`: all sources of a language by blocks of terms and pairs of tiles."""
    sizes = found.groupBy("lang", "block").agg((F.max("place") + 1).alias("terms"))
    rows = found.groupBy("lang", "source", "block").agg(
        F.collect_list("place").alias("places"), F.collect_list("n").alias("counts")
    )
    tile = _dealt(F.col("source"), F.col("tiles"))
    cells = (
        groups.select("lang", "source", "total", "kept", "tiles", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")).alias("block"))
        .join(sizes, ["lang", "block"], "left")
        .join(rows, ["lang", "source", "block"], "left")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1).cast("array<long>")))
        .withColumn("low", F.least("tile", "other"))
        .withColumn("high", F.greatest("tile", "other"))
        .select("lang", "block", "low", "high", "tile", "source", "total", "kept", F.coalesce("terms", F.lit(0)).alias("terms"), "places", "counts")
    )
    priced = cells.groupBy("lang", "block", "low", "high").applyInArrow(
        _priced, "lang string, source string, item string, value long"
    )
    summed = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _priced(cells: pa.Table) -> pa.Table:
    """The prices of all pairs of sources in one block, between two tiles or inside one."""
    low, high = cells.column("low")[0].as_py(), cells.column("high")[0].as_py()
    kept, terms = cells.column("kept")[0].as_py(), cells.column("terms")[0].as_py()
    sources, tiles = cells.column("source").to_pylist(), cells.column("tile").to_pylist()
    totals = cells.column("total").to_pylist()
    counts = np.zeros((len(sources), max(terms, 1)), np.int64)
    for g, (places, n) in enumerate(zip(cells.column("places"), cells.column("counts"), strict=True)):
        if places.is_valid:
            counts[g, places.values.to_numpy()] = n.values.to_numpy()
    forest = Forest(counts[:, :terms] if terms else np.full((len(sources), 1), -1, np.int64))
    memo: dict = {}
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(sources)):
        for j in range(i + 1, len(sources)):
            if low != high and tiles[i] == tiles[j]:
                continue  # priced where the tile meets itself
            a, b = (int(forest.roots[i]), totals[i]), (int(forest.roots[j]), totals[j])
            if (a, b) not in memo:
                there, back = forest.price(a[0], b[0], a[1], b[1], kept)
                memo[a, b], memo[b, a] = (there, back), (back, there)
            for values, more in zip(out, ((sources[i], sources[j]), (sources[j], sources[i]), memo[a, b]), strict=True):
                values.extend(more)
    return pa.table(
        [pa.array([cells.column("lang")[0].as_py()] * len(out[0]), pa.string()), pa.array(out[0], pa.string()),
         pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
        ["lang", "source", "item", "value"],
    )


def _terms(found: DataFrame, groups: DataFrame, rules: AuditRules) -> DataFrame:
    """The part `term`; the limit on ranks is applied in each task before rows are shuffled."""
    shares = found.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    above = shares.filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= rules.top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
