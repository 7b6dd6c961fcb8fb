"""Verdicts on URLs by rules over hosts and path prefixes, as an equi-join on hash prefixes.

Every distinct URL is expanded into the expressions that a rule could be written as: each suffix of
its host with each prefix of its path, of the lengths that rules have. Expressions meet the rules
on the first bits of their digest; the full digest decides whether a rule really fits, and the
longest fitting rule gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULES = "host string, path string, verdict string"
ALLOW = "allow"
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """What lies between the first `://` and the next `/`, `?` or `#`, with A-Z in lower case; else empty."""
    host = F.regexp_extract(_after(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url)))


def url_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of (host, path, verdict)."""
    return spark.createDataFrame(rules, RULES)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def judge_urls(urls: DataFrame, rules: DataFrame, column: str = "url", default: str = ALLOW) -> DataFrame:
    """All columns of `urls` with host, path, rule and verdict, which replace columns of their names.

    A rule fits its host and all subdomains where the path starts with the rule's path. The longest
    rule, host and path together, wins; among equally long ones `block` comes before others, then
    the first by text. Without a fitting rule, rule is null and the verdict is `default`. A null
    URL, or one without `://`, has an empty host and path. Rules with a null or empty host fit
    nothing; repeated rules count once. Each distinct URL is judged once, so a URL that fills a
    third of the rows is one row until the join back, whose large side may be split.
    """
    rules = rules.filter(F.length("host") > 0).select(
        F.col("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).distinct()
    known = rules.select(
        F.concat("host", F.lit(" "), "path").alias("written"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
    )
    known = known.select("*", _digest(F.col("written")).alias("rule_digest"))
    known = known.select(F.substring("rule_digest", 1, PREFIX_HEX).alias("prefix"), "rule_digest", "rule", "rule_verdict")
    # Path lengths of rules: few numbers, as a URL has few lengths. They ride along in one row.
    lengths = rules.agg(F.collect_set(F.length("path")).alias("lengths"))
    distinct = urls.select(F.col(column).cast("string").alias("_url")).filter(F.col("_url").isNotNull()).distinct()
    parts = distinct.select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    expanded = (
        parts.join(F.broadcast(lengths))
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("length", F.explode("lengths"))
        .filter(F.length("path") >= F.col("length"))
        .select("_url", _digest(F.concat("suffix", F.lit(" "), F.expr("substring(path, 1, length)"))).alias("digest"))
        .select("_url", F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "digest")
    )
    fitting = expanded.join(known, "prefix").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(
        F.length("rule").alias("size"), (F.col("rule_verdict") == "block").alias("blocks"), F.col("rule"), F.col("rule_verdict")
    )
    best = fitting.groupBy("_url").agg(F.max(rank).alias("_best"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    given = urls.select(*kept, F.col(column).cast("string").alias("_url"))
    return given.join(best, "_url", "left").select(
        *kept,
        host_of(F.col("_url")).alias("host"),
        path_of(F.col("_url")).alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
    )
