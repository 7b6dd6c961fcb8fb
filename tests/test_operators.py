"""Distinct, append, budget, lookups, filters, tables."""

import random
import re
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter, functions as F

from forecourt.operators import distinct, filters, lookups
from forecourt.operators.append import (
    DIGEST, _write_filter, append_new, key_digest, possible_folders, stored_digests, unknown_digests,
)
from forecourt.operators.columns import convert_volume, evaluate_once
from forecourt.operators.numbering import numbered
from forecourt.operators.page_budget import pages_taken
from forecourt.params import Budget
from forecourt.queries import listings, lookups as queries
from forecourt.schema import CLEAN
from forecourt.session import usable_by_all
from forecourt.sources.selection import select_listings, select_or_drop_brand, select_or_drop_range
from forecourt.sources.tables import missing_sources, null_tokens_to_null, read_clean_or_empty, read_csv, read_table, require_sources
from forecourt.streaming.append_stream import append_stream


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def loop_budget(pages, min_rows, max_pages):
    """The plain loop over pages that the window form must equal."""
    seen, total, taken = set(), 0, []
    for page in range(1, max_pages + 1):
        new = set(pages.get(page, [])) - seen
        if not new:
            break
        seen |= new
        total += len(new)
        taken.append((page, len(new), total))
        if total >= min_rows:
            break
    return taken


def taken(spark, pages, min_rows, max_pages):
    rows = [(p, k) for p, keys in pages.items() for k in keys]
    df = spark.createDataFrame(rows, "page int, key string")
    return sorted(tuple(r) for r in pages_taken(distinct.first_by_key(df, ["key"], ["page"]), min_rows, max_pages).collect())


def test_page_budget_cases(spark):
    pages = {1: ["a", "b"], 2: ["b", "c"], 3: ["a", "c"], 4: ["d"]}
    assert taken(spark, pages, 3, 5) == [(1, 2, 2), (2, 1, 3)]
    assert taken(spark, pages, 2, 5) == [(1, 2, 2)]
    assert taken(spark, pages, 10, 5) == [(1, 2, 2), (2, 1, 3)]
    assert taken(spark, pages, 10, 1) == [(1, 2, 2)]
    assert taken(spark, {2: ["a"]}, 10, 5) == []


def test_page_budget_like_a_loop(spark, monkeypatch):
    monkeypatch.setattr("forecourt.operators.page_budget.BLOCK", 3)
    rng = random.Random(1)
    for _ in range(6):
        pages = {p: [str(rng.randrange(30)) for _ in range(rng.randrange(1, 6))] for p in range(1, 12) if rng.random() < 0.97}
        for min_rows, max_pages in ((5, 20), (100, 9), (100, 20)):
            assert taken(spark, pages, min_rows, max_pages) == loop_budget(pages, min_rows, max_pages)


def test_budget_checks():
    for bad in ({"min_rows": 0}, {"max_pages": 0}, {"min_price": -1}, {"min_price": 5, "max_price": 5}):
        with pytest.raises(ValueError):
            Budget(**bad)


def test_append(spark, tmp_path):
    target = str(tmp_path / "target")
    old = spark.createDataFrame([("a", None), ("b", 2)], "k string, n int")
    new = spark.createDataFrame([("a", None), ("c", 3), ("c", 3)], "k string, n int")
    assert append_new(old, target, ["k", "n"], 0, "w").count() == 2
    assert values(append_new(new, target, ["k", "n"], 1, "w")) == [("c", 3)]
    assert append_new(new, target, ["k", "n"], 2, "w").count() == 0
    # A batch that runs again replaces what it wrote.
    assert values(append_new(new, target, ["k", "n"], 1, "w")) == [("c", 3)]
    assert spark.read.parquet(target).count() == 3
    # Another writer with the same number neither overwrites nor leaves out what is stored.
    more = spark.createDataFrame([("b", 2), ("d", 4)], "k string, n int")
    assert values(append_new(more, target, ["k", "n"], 1, "other")) == [("d", 4)]
    assert values(spark.read.parquet(target).select("k", "n")) == [("a", None), ("b", 2), ("c", 3), ("d", 4)]
    with pytest.raises(ValueError):
        append_new(more, target, ["k", "n"], 3, "a/b")


@pytest.mark.parametrize("small_batch", [0, 100_000])
def test_append_of_large_and_small_batches(spark, tmp_path, small_batch):
    target = str(tmp_path / "target")
    batches = [[(f"k{i}", i % 3 or None) for i in range(low, low + 40)] for low in (0, 20, 20, 0, 70)]
    added = [
        append_new(spark.createDataFrame(rows, "k string, n int"), target, ["n", "k"], i, "w", small_batch).count()
        for i, rows in enumerate(batches)
    ]
    assert added == [40, 20, 0, 0, 40]
    assert values(spark.read.parquet(target).select("k", "n")) == sorted({r for rows in batches for r in rows}, key=str)


def test_keys_are_not_mixed_up(spark):
    rows = [("a", "b"), ("a,1:b", None), (None, "a"), ("a", None), ("-", None), (None, None), ("", None), ("ab", ""), ("a", "b")]
    df = spark.createDataFrame(rows, "k string, n string")
    assert df.select(key_digest(["k", "n"])).distinct().count() == len(set(rows))


def test_small_batch_reads_only_folders_that_may_hold_it(spark, tmp_path):
    target = str(tmp_path / "target")
    for i in range(4):
        append_new(spark.range(i * 3000, (i + 1) * 3000).select(F.col("id").cast("string").alias("k")), target, ["k"], i, "1")
    asked = spark.createDataFrame([("3500",), ("3600",), ("no",)], "k string").withColumn(DIGEST, key_digest(["k"]))
    folders = possible_folders(spark, target, asked)
    assert folders == [("1", 1)]
    stored = stored_digests(spark, target, folders)
    assert stored.count() == 3000 and all("batch_id=1" in f for f in stored.inputFiles())
    path = str(tmp_path / "asked")
    asked.write.parquet(path)
    fresh = unknown_digests(spark.read.parquet(path), stored, small=True)
    assert [r.k for r in fresh.collect()] == ["no"]
    # The target's digests, and no other column, are scanned beside a broadcast and not shuffled before it.
    plan = unknown_digests(spark.read.parquet(path), stored, small=True)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("LeftSemi"):].split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in below and "ReadSchema: struct<key_digest:binary>" in below


def shuffled_plans(plan):
    """What lies below each shuffle of a plan."""
    lines = plan.split("\n")
    depths = [len(re.match(r"[\s:|+-]*", line)[0]) for line in lines]
    for i, line in enumerate(lines):
        if re.search(r"(?<!Broadcast)Exchange ", line):
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            yield "\n".join(lines[i:end])


@pytest.mark.parametrize("small_batch", [0, 100_000])
def test_append_shuffles_digests_only(spark, tmp_path, monkeypatch, small_batch):
    plans, write = [], DataFrameWriter.parquet

    def watched(writer, path, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    target = str(tmp_path / "target")
    # Keys come up to three times, in the same and in other tasks, and are null; the rest of their rows differs.
    rows = [(None if i % 50 == 0 else f"k{i % 400}", i % 3 or None, f"long text {i}") for i in range(1000)]
    for low in (0, 200):
        batch = spark.createDataFrame(rows[low : low + 800], "k string, n int, body string").repartition(4)
        append_new(batch, target, ["k", "n"], low, "w", small_batch)
    below = [part for plan in plans for part in shuffled_plans(plan) if "key_digest" in part]
    assert len(below) >= 6 and not any("body" in part for part in below)
    stored = spark.read.parquet(target)
    assert values(stored.select("k", "n")) == sorted({r[:2] for r in rows}, key=str)
    assert {tuple(r) for r in stored.select("k", "n", "body").collect()} <= set(rows)


def test_filter_grows_with_its_keys_only(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter, "parquet",
        lambda w, path: (plans.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, path))[1],
    )
    digests = spark.range(5000, numPartitions=4).select(key_digest(["id"]).alias(DIGEST))
    _write_filter(digests, 5000, str(tmp_path / "filter"))
    # No bitmaps are begun before the shuffle.
    assert not any("bitmap_construct_agg" in part for part in shuffled_plans(plans[0]))
    kept = spark.read.parquet(str(tmp_path / "filter"))
    assert kept.select("cell").distinct().count() == kept.count() == kept.first()["cells"]


def test_filters_admit_every_stored_key(spark, tmp_path):
    target = str(tmp_path / "target")
    rows = spark.range(20_000).select("id")
    append_new(rows, target, ["id"], 0, "w")
    append_new(spark.range(20_000, 20_010), target, ["id"], 1, "w")
    for low in range(0, 20_000, 4_000):
        one = spark.range(low, low + 1).withColumn(DIGEST, key_digest(["id"]))
        assert ("w", 0) in possible_folders(spark, target, one)
    absent = spark.range(10**6, 10**6 + 300).withColumn(DIGEST, key_digest(["id"]))
    assert possible_folders(spark, target, absent) == []


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"k{i % 7}", None if i % 3 else i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(5)
    df.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new in its input
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        append_stream(stream, target, ["k", "n"], str(tmp_path / "offsets")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.select("batch_id").distinct().count() > 1
    assert values(stored.select("k", "n")) == values(distinct.distinct_rows(df))


@pytest.mark.parametrize("as_file", [False, True])
def test_streamed_tables_are_folders_or_files(spark, tmp_path, as_file):
    tables = {
        "documents": ("text string, lang string", [("a", "cs"), ("a", "cs"), (None, None), ("b", "de"), ("c", "user")]),
        "conversations": ("text string, role string", [("a", "user"), ("c", "user"), (None, None), ("d", None)]),
    }
    folder = tmp_path / "tables"
    folder.mkdir()
    for name, (schema, rows) in tables.items():
        written = spark.createDataFrame(rows, schema).coalesce(1) if as_file else spark.createDataFrame(rows, schema).repartition(3)
        path = tmp_path / name if as_file else folder / f"{name}.parquet"
        written.write.parquet(str(path))
        if as_file:
            shutil.copy(next(path.glob("part-*.parquet")), folder / f"{name}.parquet")
    expected = {(text, kind) for _, rows in tables.values() for text, kind in rows}
    assert values(listings.streamed_append(spark, str(folder))) == sorted(expected, key=str)


def test_distinct_operators(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1)], "id int, k string, n int")
    assert values(distinct.distinct_rows(df.drop("id"))) == [("a", None), ("b", 1)]
    assert values(distinct.first_by_key(df, ["k"], ["id"])) == [(1, "a", None), (3, "b", 1)]
    other = spark.createDataFrame([("c", 9)], "k string, id int")
    assert values(distinct.union_tables(df, other))[-1] == (9, "c", None)
    assert distinct.union_distinct(df, df).count() == 3


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(0, 20_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    first = distinct.first_by_key(df, ["k"], ["id"])
    assert first.filter("k = 'hot'").first()["id"] == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    # Top of the plan first: final limit, shuffle, limit per task.
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_lookups(spark):
    df = spark.createDataFrame(
        [("S", "O", 2.0), ("S", "O", 1.6), ("S", "F", 1.0), ("A", "Q", None), (None, "x", 1.0), ("S", "O", 2.0)],
        "brand string, model string, volume_l double",
    )
    assert [r[0] for r in lookups.domain(df, "brand").collect()] == ["A", "S"]
    assert [tuple(r) for r in lookups.domain(df, "brand", "model").collect()] == [("A", "Q"), ("S", "F"), ("S", "O")]
    lists = lookups.domain_whole(df, ["brand"], "model").collect()
    assert sorted((r.brand, r["values"]) for r in lists) == [("A", ["Q"]), ("S", ["F", "O"])]
    volumes = lookups.domain_whole(lookups.lookup(df, brand="S", model="O"), ["brand", "model"], "volume_l")
    assert volumes.select(lookups.labels(F.col("values"))).first()[0] == ["1.6", "2.0"]
    assert [tuple(r) for r in lookups.top_values(df, "model", 2).collect()] == [("O", 3), ("F", 1)]
    assert [r[0] for r in lookups.preview(df, [F.col("volume_l").desc()], 2).collect()] == ["S", "S"]


def test_queries_give_a_long_domain_in_one_row(spark, tmp_path):
    ids = spark.range(10_500)
    part = ids.select(F.lit("b").alias("p_brand"), F.lit("n").alias("p_name"), F.col("id").cast("int").alias("p_size"))
    part = part.union(ids.select(F.lit("c"), F.format_string("m%05d", "id"), F.lit(10)))
    part.write.parquet(str(tmp_path / "part.parquet"))
    two = queries.domain_by_two(spark, str(tmp_path)).filter("p_brand = 'b'").collect()
    assert [r.volumes.split("|") for r in two] == [[str(i / 10) for i in range(10_500)]]
    one = queries.domain_by_brand(spark, str(tmp_path)).filter("p_brand = 'c'").collect()
    assert [r.models.split("|") for r in one] == [[f"m{i:05d}" for i in range(10_500)]]


def test_null_order_of_prices(spark):
    df = spark.createDataFrame([("3",), (None,), ("Cenanadotaz",), ("20",), ("1",)], "price string")
    prices = [r[0] for r in lookups.sorted_by_price(df).collect()]
    assert prices[:3] == ["1", "3", "20"] and set(prices[3:]) == {None, "Cenanadotaz"}


def test_export_by_price(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["250000", "250000", "x", None, str(rng.randrange(10**6)), "1e3"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, price string").repartition(6)
    path, coalesce = str(tmp_path / "out"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        lookups.export_by_price(df, path, ["id"])
    finally:
        spark.conf.unset(coalesce)

    def key(row):
        readable = row[1] not in (None, "x")
        return (not readable, float(row[1]) if readable else 0.0, row[0])

    files = sorted(tmp_path.glob("out/part-*.parquet"))
    found = [tuple(r) for f in files for r in spark.read.parquet(str(f)).orderBy("position").collect()]
    assert len(files) > 1 and found == [(*row, at + 1) for at, row in enumerate(sorted(rows, key=key))]
    lookups.export_by_price(df.limit(0), path, ["id"])
    assert spark.read.parquet(path).count() == 0


@pytest.mark.parametrize(("master", "path", "usable"), [
    ("local[4]", "file:/w", True), ("local", "/w", True), ("local-cluster[2,1,1024]", "file:/w", False),
    ("spark://h:7077", "/w", False), ("yarn", "hdfs://n/w", True),
])
def test_scratch_folder_on_a_cluster(master, path, usable):
    assert usable_by_all(master, path) is usable


def test_numbers_within_groups(spark):
    rows = [(g, n) for g, size in (("a", 300), ("b", 1), ("c", 40)) for n in range(size)]
    out = numbered(spark.createDataFrame(rows, "g string, n int").repartition(5), ["g", F.col("n").desc()], ["g"], "k").collect()
    sizes = {"a": 300, "b": 1, "c": 40}
    assert len(out) == len(rows) and all(r.k == sizes[r.g] - 1 - r.n for r in out)


def test_required_sources(spark, tmp_path):
    there, none = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(3).write.parquet(there)
    assert missing_sources(spark, there, none) == [none] and require_sources(spark, there)[0].count() == 3
    with pytest.raises(FileNotFoundError, match="/b"):
        require_sources(spark, there, none)


def test_filters(spark):
    df = spark.createDataFrame([("BMW", "Rada"), ("Audi", "Rada"), (None, "RADA"), (None, None)], "brand string, model string")
    assert filters.exclude_pair(df, "brand", "model", ("BMW", "rada")).count() == 3
    assert values(filters.block(df, ["brand", "model"], ("audi",))) == [("BMW", "Rada"), (None, "RADA"), (None, None)]
    assert filters.drop_empty_rows(df).count() == 3
    assert filters.require(df, ["brand"]).count() == 2
    found = spark.createDataFrame([("", "x"), ("Nezjištěno", "x"), (None, "x")], "a string, b string")
    assert values(filters.drop_not_found(found, ["a", "b"])) == [("", "x")]


def test_selection(spark):
    df = spark.createDataFrame([("S", 10), ("S", 20), ("A", 15)], "brand string, price int")
    assert values(select_listings(df, "S", 15)) == [("S", 20)]
    assert select_listings(df).count() == 3
    assert values(select_or_drop_brand(df, "S", 15, 30)) == [("S", 20)]
    assert values(select_or_drop_brand(df, "X", 15, 30)) == [("A", 15), ("S", 20)]
    assert values(select_or_drop_range(df, "S", 15, 30)) == [("S", 20)]
    assert values(select_or_drop_range(df, "S", 90, 99)) == [("S", 10), ("S", 20)]


def test_convert_volume(spark):
    columns = ["brand", "volume_l"]
    b = spark.createDataFrame([("a", "1050"), ("b", None)], "brand string, volume_cm3 string")
    assert values(convert_volume(b, columns)) == [("a", 1.0), ("b", None)]
    a = spark.createDataFrame([("2.0", "a")], "volume_l string, brand string")
    assert values(convert_volume(a, columns)) == [("a", "2.0")]
    with pytest.raises(AnalysisException):
        convert_volume(a.drop("volume_l"), columns)


def test_evaluate_once_keeps_order_and_blocks_pushdown(spark):
    df = spark.range(5).select("id", F.lit("x").alias("t"))
    out = evaluate_once(df, {"t": F.upper("t"), "u": F.regexp_replace("t", "x", "y")})
    assert out.columns == ["id", "t", "u"] and out.first() == (0, "X", "y")
    plan = out.filter("u = 'y'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1


def test_csv_edge(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿Značka,Model,Rok\nŠkoda,\"a \"\"b\"\", c\nd\",NA\n,nan,2018\n".encode())
    assert values(read_csv(spark, str(path))) == [("Škoda", 'a "b", c\nd', None), (None, None, "2018")]
    assert read_csv(spark, str(path)).columns == ["brand", "model", "year"]
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "missing.csv"))


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_headers_must_agree(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("Model,Cena\nFabia,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Cena,Model\n2,Octavia\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path), multi_line).collect()


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA", 1), ("na", 2), ("", 3)], "t string, n int")
    assert values(null_tokens_to_null(df)) == [("na", 2), (None, 1), (None, 3)]


def test_empty_table_fallback(spark, tmp_path):
    assert read_clean_or_empty(spark, str(tmp_path / "none")).columns == CLEAN
    other = str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    assert read_clean_or_empty(spark, other).count() == 0
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "none"))
