"""The keyed URL cache: reads, and writes folded by precedence, as operations on tables.

A cache row: url, base_url, status, title, html. Writes come with ``seq``, their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(cache: DataFrame) -> DataFrame:
    """Rows whose page can be used again."""
    return cache.where("status = 'success' and html is not null and html <> ''")


def visited(urls: DataFrame, cache: DataFrame) -> DataFrame:
    return urls.join(cache.select("url").distinct(), "url", "left_semi")


def uncached(links: DataFrame, cache: DataFrame) -> DataFrame:
    """Links without a usable page in the cache."""
    return links.join(usable(cache).select("url").distinct(), "url", "left_anti")


def lookup(urls: DataFrame, cache: DataFrame, least: int = 500) -> DataFrame:
    """urls with the cached page where it is long enough, and how it would be fetched."""
    hit = usable(cache).where(F.char_length("html") >= least).select("url", F.col("title").alias("cached_title"), F.col("html").alias("cached_html"))
    return urls.join(hit, "url", "left").withColumn("fetch_method", F.when(F.col("cached_html").isNotNull(), "cached").otherwise("fetch"))


def fold(writes: DataFrame) -> DataFrame:
    """The cache that a sequence of writes leaves: one row per url.

    The last successful write with a page wins whole; after it nothing changes the row. Without one,
    status and title are those of the last success, else of the last write; a page written once stays.
    """
    full = (F.col("status") == "success") & (F.coalesce("html", F.lit("")) != "")
    ok = F.col("status") == "success"
    told = F.struct("status", "title")
    return (
        writes.groupBy("url")
        .agg(
            F.max_by(F.when(full, F.struct("status", "title", "html")), F.when(full, F.col("seq"))).alias("whole"),
            F.max_by(F.when(ok, told), F.when(ok, F.col("seq"))).alias("ok"),
            F.max_by(told, "seq").alias("last"),
            F.max_by(F.when(F.coalesce("html", F.lit("")) != "", F.col("html")), F.when(F.coalesce("html", F.lit("")) != "", F.col("seq"))).alias("page"),
            F.max_by("base_url", F.when(F.coalesce("base_url", F.lit("")) != "", F.col("seq"))).alias("base_url"),
        )
        .select(
            "url", "base_url",
            F.coalesce(F.col("whole.status"), F.col("ok.status"), F.col("last.status")).alias("status"),
            F.coalesce(F.col("whole.title"), F.col("ok.title"), F.col("last.title")).alias("title"),
            F.coalesce(F.col("whole.html"), F.col("page")).alias("html"),
        )
    )


def upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """The cache after new writes."""
    return fold(cache.withColumn("seq", F.lit(-1).cast("long")).unionByName(writes.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True))


def without_site(cache: DataFrame, base_url: str) -> DataFrame:
    return cache.where(~F.col("base_url").eqNullSafe(F.lit(base_url)))


def site_count(cache: DataFrame, base_url: str | None = None) -> DataFrame:
    return (cache if base_url is None else cache.where(F.col("base_url") == base_url)).agg(F.count("*").alias("n"))


def sessions(saved: DataFrame) -> DataFrame:
    """The last snapshot of each session, its state as a variant (null where it is no JSON)."""
    last = saved.groupBy("session_id").agg(F.max_by(F.struct("target_url", "state_json"), "seq").alias("s"))
    return last.select("session_id", "s.target_url", F.try_parse_json("s.state_json").alias("state"))


def session(saved: DataFrame, session_id: str) -> DataFrame:
    """One session's last snapshot, or no row."""
    return sessions(saved.where(F.col("session_id") == session_id))


def without_session(saved: DataFrame, session_id: str) -> DataFrame:
    return saved.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))
