"""Result pages and detail pages to the raw listings of one source, wave by wave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from forecourt.operators.distinct import first_by_key
from forecourt.operators.page_budget import pages_taken
from forecourt.params import SITE_A, SITE_B, Budget, Site
from forecourt.schema import RAW_A, RAW_B
from forecourt.session import scratch_path
from forecourt.sources.detail_pages import accepted, extract_a, extract_b
from forecourt.sources.listing_links import page_links

FIRST_WAVE = 64  # result pages; every wave has twice as many as the one before
SMALL_FRONTIER = 100_000  # addresses that may be sent to every executor


def first_page_of_link(result_pages: DataFrame, site: Site) -> DataFrame:
    """(url, page): the first result page that shows each listing."""
    links = page_links(result_pages.select("page", "html"), site.base, site.link_class)
    return links.groupBy(F.col("link").alias("url")).agg(F.min("page").alias("page"))


def frontier_listings(
    detail_pages: DataFrame, frontier: DataFrame, extract: Callable[[DataFrame], DataFrame], small: bool
) -> DataFrame:
    """The listings of the detail pages that the frontier (url, page) links to, with `page`.

    Pages are cut before they are parsed. A small frontier goes to the tasks that read the pages,
    so page texts stay where they lie.
    """
    wanted = frontier.select("url")
    linked = detail_pages.join(F.broadcast(wanted) if small else wanted, "url", "left_semi")
    return accepted(extract(linked)).distinct().join(frontier, "url")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unseen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    known = seen.select(F.struct(*keys).alias("_key"))
    return new.withColumn("_key", F.struct(*keys)).join(known, "_key", "left_anti").drop("_key")


def _ended(seen: DataFrame, budget: Budget, last: int) -> bool:
    """The budget is met, or a page without anything new came, within the first `last` pages."""
    end = pages_taken(seen, budget.min_rows, last).agg(F.max("page"), F.max("total")).first()
    return end[0] is None or end[0] < last or end[1] >= budget.min_rows


def collect(
    result_pages: DataFrame, detail_pages: DataFrame, budget: Budget, site: Site, keys: list[str],
    extract: Callable[[DataFrame], DataFrame], first_wave: int = FIRST_WAVE,
) -> DataFrame:
    """result_pages(page, html) and detail_pages(url, html) to distinct raw listings within the budget.

    A wave takes the next result pages, drops links that earlier waves followed, parses the detail
    pages of the others and keeps listings whose values (`keys`) are new. Links and listings of a
    wave are written to the shared folder, so nothing is parsed again, not even after the loss of
    an executor. Waves end with the budget: no later result page is read.
    """
    followed, seen, last, wave = None, None, 0, first_wave
    while seen is None or (last < budget.max_pages and not _ended(seen, budget, last)):
        in_reach = result_pages.filter(F.col("page").between(last + 1, min(last + wave, budget.max_pages)))
        last, wave = min(last + wave, budget.max_pages), 2 * wave
        links = first_page_of_link(in_reach, site)
        if followed is not None:
            links = links.join(followed.select("url"), "url", "left_anti")
        links = _written(links, "links")
        found = frontier_listings(detail_pages, links, extract, links.count() <= SMALL_FRONTIER)
        new = first_by_key(found, keys, ["page", "url"])
        new = _written(new if seen is None else _unseen(new, seen, keys), "listings")
        followed = links if followed is None else followed.unionByName(links)
        seen = new if seen is None else seen.unionByName(new)
    taken = pages_taken(seen, budget.min_rows, last).select("page")
    return seen.join(taken, "page", "left_semi").select(*keys)


def collect_a(result_pages: DataFrame, detail_pages: DataFrame, budget: Budget, site: Site = SITE_A, **waves) -> DataFrame:
    return collect(result_pages, detail_pages, budget, site, RAW_A, extract_a, **waves)


def collect_b(result_pages: DataFrame, detail_pages: DataFrame, budget: Budget, site: Site = SITE_B, **waves) -> DataFrame:
    return collect(result_pages, detail_pages, budget, site, RAW_B, extract_b, **waves)
