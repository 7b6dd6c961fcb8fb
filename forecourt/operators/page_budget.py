"""How many result pages a collection takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 4096


def _running(pages: DataFrame) -> DataFrame:
    """Add `before`, the sum of `n_new` over all earlier pages, and `gaps`, the pages without
    anything new up to this one.

    Two levels, so that no task sees more than BLOCK pages or one row per block.
    """
    blocked = pages.withColumns({
        "block": F.floor((F.col("page") - 1) / BLOCK),
        "gap": (F.col("n_new") == 0).cast("bigint"),
    })
    blocks = blocked.groupBy("block").agg(F.sum("n_new").alias("rows"), F.sum("gap").alias("gaps"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "block",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_start"),
        F.coalesce(F.sum("gaps").over(earlier), F.lit(0)).alias("gaps_start"),
    )
    inside = Window.partitionBy("block").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumns({
            "rows_inside": F.sum("n_new").over(inside) - F.col("n_new"),
            "gaps_inside": F.sum("gap").over(inside),
        })
        .join(starts, "block")
        .select(
            "page",
            "n_new",
            (F.col("rows_start") + F.col("rows_inside")).alias("before"),
            (F.col("gaps_start") + F.col("gaps_inside")).alias("gaps"),
        )
    )


def pages_taken(first_seen: DataFrame, min_rows: int, max_pages: int, page: str = "page") -> DataFrame:
    """(page, n_new, total) of the result pages taken, out of one row per distinct listing.

    `first_seen` holds, for every listing, the first page that shows it. Pages are taken in order
    until a page has nothing new, or the total reaches `min_rows` (that page counts in full), or
    `max_pages` is reached.
    """
    counts = (
        first_seen.filter(F.col(page) <= max_pages)
        .groupBy(F.col(page).cast("bigint").alias("page"))
        .agg(F.count(F.lit(1)).alias("n_new"))
    )
    numbered = (
        first_seen.sparkSession.range(1, max_pages + 1)
        .withColumnRenamed("id", "page")
        .join(counts, "page", "left")
        .na.fill(0, ["n_new"])
    )
    return (
        _running(numbered)
        .filter((F.col("gaps") == 0) & (F.col("before") < min_rows))
        .select("page", "n_new", (F.col("before") + F.col("n_new")).alias("total"))
    )
