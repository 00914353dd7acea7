"""Links: generators from parsed pages, anti-joins on what was seen, level by level traversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import chunks
from pagemill.operators.lineage import cut


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the first in order. Null keys form one group."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the last in order, as one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def page_links(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, pos, link, text): one row per anchor."""
    return parsed.select(*keep, F.posexplode("links").alias("pos", "l")).select(*keep, "pos", F.col("l.url").alias("link"), F.col("l.text").alias("text"))


def same_host(links: DataFrame, page_url: str = "url") -> DataFrame:
    """Links to pages on the page's own host."""
    return links.where(urls.same_domain(F.col("link"), F.col(page_url)) & urls.valid_page(F.col("link")))


def unseen(links: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    return links.join(seen.select(key).distinct(), key, "left_anti")


def requeued(links: DataFrame, seen: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Seen pages that a better path was found for, unless they are finished."""
    from pagemill.functions import rules

    again = links.where(rules.requeue(F.col("nav_path"))).join(seen.select(key).distinct(), key, "left_semi")
    return again.join(done.select(key).distinct(), key, "left_anti")


def levels(edges: DataFrame, start: DataFrame, most: int = 4, checkpoint: bool = True) -> DataFrame:
    """(node, level): breadth-first distance from ``start`` along (src, dst) edges, to ``most`` levels.

    Each level is one anti-join of the frontier's targets with what was reached; the lineage is cut
    per level unless ``checkpoint`` is false.
    """
    reached = start.select("node").distinct().withColumn("level", F.lit(0))
    frontier = reached.select("node")
    for level in range(1, most + 1):
        found = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        found = found.join(reached.select("node"), "node", "left_anti")
        if checkpoint:
            found = cut(found)
            if found.isEmpty():
                break
        reached = reached.unionByName(found.withColumn("level", F.lit(level)))
        frontier = found
    return reached


def crawl(seeds: DataFrame, pages: DataFrame, most: int = 4, per_page: int | None = None) -> DataFrame:
    """(key, url, level, nav_path) of the pages of a table of fetched pages that links lead to from ``seeds``.

    ``pages``: key, url, links (array of url, text). A page is reached first from the earliest
    level, of one level from the smallest parent and place; children inherit the parent's path.
    """
    reached = seeds.select("key", "url", F.lit(0).alias("level"), F.array().cast("array<string>").alias("nav_path"))
    frontier = reached
    for level in range(1, most + 1):
        out = pages.join(frontier.select("key", "nav_path"), "key").select(F.col("key").alias("parent"), "nav_path", F.posexplode("links").alias("pos", "l"))
        if per_page is not None:
            out = out.where(F.col("pos") < per_page)
        out = out.select("parent", "pos", F.col("nav_path"), urls.key_query(F.col("l.url")).alias("key"), F.col("l.text").alias("text"))
        out = first_seen(out, ["key"], ["parent", "pos"]).join(reached.select("key"), "key", "left_anti").join(pages.select("key", "url"), "key")
        frontier = cut(out.select("key", "url", F.lit(level).alias("level"), "nav_path"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def budgeted(seeds: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, budget: int, most: int = 4, per_page: int | None = None, per_site: int | None = None, queue: int | None = None) -> DataFrame:
    """(node, site, level, number): the first ``budget`` nodes that a breadth-first crawl takes, numbered in its order.

    ``seeds``: node, seq (long). ``edges``: src, pos (long, the place of the link on its page), dst.
    ``edges`` may also be a function that gives them for a frame of nodes, so that none are made but those of
    the nodes reached. ``nodes``: node, site; links to others lead nowhere. Of a level's nodes those of the parent with
    the smallest number come first, of one parent those of the smallest place. ``per_page`` takes the
    first links of a page, ``per_site`` the first nodes of a site, ``queue`` the first nodes of a level
    after the limit by site. Numbers come from histograms of the order and sums over their parts
    (``chunks.numbered``): no level is sorted in one task, and exactly ``budget`` nodes are taken
    where there are as many. Only counts come to the driver.
    """
    one = ["_all"]
    leads = edges if callable(edges) else lambda frontier: edges.join(frontier, edges["src"] == frontier["node"], "left_semi")
    reached, total = None, 0
    found = seeds.groupBy("node").agg(F.min(F.struct(F.col("seq").alias("parent"), F.lit(0).cast("long").alias("pos"))).alias("at"))
    for level in range(most + 1):
        if reached is not None:
            frontier = reached.where(F.col("level") == level - 1).select("node", F.col("number").alias("parent"))
            # The limit by page is the source's own, so it comes after the choice of sources.
            out = leads(frontier.select("node"))
            if per_page is not None:
                out = chunks.first(cut(out), ["src"], ["pos"], per_page)
            out = out.join(frontier, out["src"] == frontier["node"]).select(F.col("dst").alias("node"), F.struct("parent", "pos").alias("at"))
            found = cut(out.groupBy("node").agg(F.min("at").alias("at")).join(reached.select("node"), "node", "left_anti"))
        rows = nodes.select("node", "site").join(found, "node").distinct().select("node", "site", "at.parent", "at.pos", F.lit(0).alias("_all"))
        rows = cut(rows)
        # Never falls along (parent, pos), and splits even the links of one page.
        place = F.col("parent").cast("double") + F.greatest("pos", F.lit(0)) / (F.greatest("pos", F.lit(0)) + (1 << 20))
        if per_site is not None:
            rows = chunks.numbered(rows, ["site"], ["parent", "pos"], "_of_site", place)
            if reached is not None:
                had = reached.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("_had"))
                rows = rows.join(had, F.col("site").eqNullSafe(F.col("_site")), "left").withColumn("_of_site", F.col("_of_site") + F.coalesce("_had", F.lit(0)))
            rows = rows.where(F.col("_of_site") <= per_site)
        most_now = budget - total if queue is None else min(queue, budget - total)
        rows = chunks.numbered(rows, one, ["parent", "pos"], "number", place).where(F.col("number") <= most_now)
        rows = cut(rows.select("node", "site", F.lit(level).alias("level"), (F.col("number") + total).alias("number")))
        n = rows.count()
        reached, total = rows if reached is None else reached.unionByName(rows), total + n
        if n == 0 or total >= budget:
            break
    return reached
