"""A whole site run over a table of fetched pages: frontier, gates, extraction, categories, dedup, rows, verdict.

The order is that of a page's way: length and block gates first, as they are native and cheap; then one
parse of what passed; then rules over its fields; then dedup by content; then paths and rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import rules, urls
from pagemill.functions.pages import parse_pages
from pagemill.operators import categories, evaluate, links
from pagemill.operators.lineage import cut

# --- Fixed values: what pages of two-dimensional codes are about ---
QR_PAGE = r"(?i)(官方微信|官方微博|微群|易企秀|扫码|二维码|关注公众号|微信公众号)"

#: An optional model may replace the heuristic verdict or text; none is called unless given.
Hook = Callable[[DataFrame], DataFrame]


def gated(pages: DataFrame) -> DataFrame:
    """Pages with ``early``: failed for none, short or blocked html, skipped for error pages, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    early = F.when(F.char_length(html) < 100, "failed").when(rules.blocked(html), "failed").when(rules.looks_like_404(html), "skipped")
    return pages.withColumn("early", early)


def starts(keyed: DataFrame, parsed: DataFrame) -> DataFrame:
    """(key, url): the home pages, and the pages that no other page links to."""
    found = links.page_links(parsed.where("early is null"), ["key"]).select(F.col("key").alias("parent"), urls.key_query(F.col("link")).alias("key"))
    linked = found.where("parent <> key").select("key").distinct().withColumn("linked", F.lit(True))
    home = F.col("url").rlike(r"^\w+://[^/?#]+/?$")
    return keyed.where("key is not null").join(linked, "key", "left").where(home | F.col("linked").isNull()).select("key", "url")


def site(pages: DataFrame, seeds: DataFrame | None = None, most: int = 4, extractor: Hook | None = None) -> DataFrame:
    """One row per page reached from ``seeds`` (url): key, level, status, title, nav_levels, file_path, content_hash, images.

    Without seeds it is one row per row of ``pages``: the crawl begins at ``starts``, what it does not
    reach in ``most`` levels is a start of its own, further rows of one key are duplicates and rows
    without a URL are skipped, both without a level.
    """
    whole = seeds is None
    keyed = links.first_seen(pages.withColumn("key", urls.key_query(F.col("url"))), ["key"], ["page_id"])
    names = ["links", "heading", "text", "text_length", "hrefs", "title", "pager_class", "crumb_levels", "images", "structured", "publish_text", "paging", "body_length"]
    parsed = parse_pages(gated(keyed), [F.col(c) for c in ("key", "url", "page_id", "early")], names, F.col("url"), F.col("html"))
    parsed = parsed if extractor is None else extractor(parsed)
    listing = rules.list_page(F.col("text_length"), F.col("hrefs"), F.col("title"), F.col("pager_class"), F.col("text"))["is_list"]
    parsed = cut(parsed.withColumn("is_list", listing))  # used for the frontier and for the rows: pages are parsed once
    start = starts(keyed, parsed) if whole else keyed.join(seeds.select(urls.key_query(F.col("url")).alias("key")).distinct(), "key", "left_semi")
    # A page that looks like a list but has much text is none, so its links lead nowhere; pagers count as links.
    leads = F.col("early").isNull() & ~(F.col("is_list") & (F.col("body_length") > 5000))
    reached = links.crawl(start.select("key", "url"), parsed.select("key", "url", F.when(leads, F.concat("links", "paging")).alias("links")), most)
    if whole:
        rest = keyed.where("key is not null").join(reached.select("key"), "key", "left_anti")
        reached = reached.unionByName(rest.select("key", "url", F.lit(0).alias("level"), F.array().cast("array<string>").alias("nav_path")))
    rows = reached.select("key", "level", "nav_path").join(parsed, "key")
    rows = rows.withColumn("path", categories.merged_path(F.col("nav_path"), F.col("crumb_levels")))
    plain = F.regexp_replace(rules.without_tags(F.col("structured")), r"\s+", "")
    early = F.coalesce(F.col("early"), F.when(F.col("is_list") & (F.col("level") >= 4), "skipped"), F.when((F.char_length(plain) < 80) | ((F.col("heading").rlike(QR_PAGE) | plain.rlike(QR_PAGE)) & (F.char_length(plain) < 200)), "skipped"))
    rows = rows.withColumn("early", early).withColumn("content_hash", F.when(F.col("early").isNull(), rules.page_hash(F.col("structured"), F.col("heading"))))
    first = rows.where("early is null").groupBy(F.col("content_hash").alias("_hash")).agg(F.min_by("key", F.struct("level", "key")).alias("first_key"))
    # Skipped pages have no hash; they are dealt out by their keys, which equal no hash.
    rows = rows.join(first, F.coalesce("content_hash", F.concat(F.lit("-"), "key")) == F.col("_hash"), "left").drop("_hash")
    status = F.coalesce("early", F.when(F.col("key") != F.col("first_key"), "duplicate"), F.lit("saved"))
    rows = rows.withColumn("status", status).withColumn("nav_levels", categories.nav_levels(F.col("path"), F.lit("其他页面"), F.col("url"), F.col("heading")))
    rows = rows.withColumn("publish_time", rules.publish_time(F.col("publish_text"))).withColumn("n_images", F.size("images"))
    rows = categories.file_paths(rows, categories.folder_of(F.col("nav_levels")), rules.safe_name(F.col("heading")), ["level", "key"])
    out = rows.select("page_id", "key", "url", "level", "status", F.col("heading").alias("title"), "publish_time", "nav_levels", "file_path", "content_hash", "n_images", F.col("structured").alias("html"))
    if not whole:
        return out
    nth = F.row_number().over(Window.partitionBy("key").orderBy("page_id"))
    more = pages.withColumn("key", urls.key_query(F.col("url"))).withColumn("nth", nth).where("nth > 1 or key is null")
    return out.unionByName(more.select("page_id", "key", "url", F.when(F.col("key").isNull(), "skipped").otherwise("duplicate").alias("status")), allowMissingColumns=True)


def outcome(rows: DataFrame) -> DataFrame:
    """The verdict on a run: counts by status and the heuristic evaluation."""
    n = lambda s: F.count_if(F.col("status") == s)
    return evaluate.verdict(rows.agg(n("saved").alias("saved"), n("failed").alias("failed"), (n("skipped") + n("duplicate")).alias("skipped"), F.count_if(F.col("n_images") > 0).alias("with_images")))
