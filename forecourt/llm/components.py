"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from forecourt.session import scratch_path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The table written to the shared folder and read again, which ends its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, most_rounds: int = 60, file_rows: int = 100_000) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the least node that each can reach.

    Every round hangs larger neighbours below the least one, then joins a node's smaller
    neighbours, until nothing changes; the depth halves, so rounds grow with the logarithm of the
    longest path. A node's links are only combined by a minimum, which starts before the shuffle,
    and by a join whose large side can be split. Every round writes a file for each `file_rows` links of
    the round before, and six at least, since a few links in hundreds of files cost more than the
    round. Null ends and loops are left out; no links, no rows.
    """
    n_links = links.count()
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    state = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        raised = large.join(parent, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = raised.union(parent.select("u", F.col("m").alias("v"))).distinct()
        links = cut(hung.coalesce(max(6, math.ceil(n_links / file_rows))), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state, n_links = tuple(now), now[0]
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    own = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)


def two_levels(links: DataFrame) -> DataFrame:
    """(node, component) where component is a smaller node that links (a < b) reach in two steps.

    Nodes with one component are connected, but connected nodes may have several; that is enough
    where it only saves comparisons, at a small part of the cost of connected_components.
    """
    parent = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("component"))


class Roots:
    """Union of few members in a task; the root of a set is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
