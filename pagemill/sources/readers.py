"""Sources: tables of fetched pages, URL lists, sitemaps, expected data, saved pages, and a page source.

Schemas are declared, never inferred. Pages are fetched elsewhere; ``PageSource`` is the place to
plug a fetcher in: one partition per group of URLs, a row per URL, whatever happened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = "page_id long, url string, html string"
FETCHED = "url string, html string, status int, fetch_method string, attempt int, error string"
GOLDEN = "test_cases array<struct<id: string, url: string, expected_data: struct<title: string, publish_time: string, breadcrumb: array<string>, min_images: int>, description: string>>"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(f"{sf_dir}/pages.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_list(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """(pos, url): http(s) lines of a text file, each once a slash at the end aside, the first ``most``."""
    from pagemill.operators.links import first_seen

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).select("pos", F.btrim("line").alias("url"))
    good = lines.where(F.col("url").rlike("^https?://")).withColumn("key", F.regexp_replace("url", "/+$", ""))
    return first_seen(good, ["key"], ["pos"]).orderBy("pos").limit(most).select("pos", "url")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(file, url) of sitemap files: the locations of XML, the http lines of text."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.select("file", F.explode(sitemap_urls(F.col("value"))).alias("url")).distinct()


def sitemap_urls(text):
    """array of the URLs in one sitemap's text."""
    located = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x)), lambda x: F.startswith(x, F.lit("http")))
    return F.when(F.contains(text, F.lit("<loc>")), located).otherwise(lines)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Expected data of evaluation cases from a JSON file."""
    cases = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("test_cases").alias("c"))
    want = "c.expected_data"
    return cases.select("c.id", "c.url", F.col(f"{want}.title").alias("expected_title"), F.col(f"{want}.publish_time").alias("expected_publish_time"), F.col(f"{want}.breadcrumb").alias("expected_breadcrumb"), F.col(f"{want}.min_images").alias("expected_images"))


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows rebuilt from saved HTML files: the title is the file's name, the levels are its folders; empty files give no row."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", ""), "^/*", "")
    root = folder.split(":", 1)[-1].strip("/")
    parts = F.split(F.substr(below, F.lit(len(root) + 2)), "/")
    return files.select(path.alias("file"), F.regexp_replace(F.element_at(parts, -1), r"\.html$", "").alias("title"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("nav_path"), F.col("value").alias("html"))


class _Some(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def page_source(name: str, urls: list[str], fetch: Callable[[str], tuple[str | None, int | None]], retries: int = 3, per_task: int = 100) -> type[DataSource]:
    """A data source that reads ``urls`` through ``fetch`` (url -> html, status).

    Statuses from 400 to 499 other than 429 are answers; others and exceptions are tried again,
    ``retries`` times in all; then the row says so. Register it with ``spark.dataSource.register``.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Some(urls[i : i + per_task]) for i in range(0, len(urls), per_task)]

        def read(self, partition) -> Iterator[tuple]:
            for url in partition.urls:
                html, status, error, attempt = None, None, None, 0
                while attempt < retries:
                    attempt += 1
                    try:
                        html, status = fetch(url)
                        error = None if status == 200 else f"status {status}"
                    except Exception as e:  # a row for every URL
                        html, status, error = None, None, f"{type(e).__name__}: {e}"
                    if status is not None and (status < 400 or 400 <= status < 500 and status != 429):
                        break
                yield (url, html, status, "httpx" if error is None else "failed", attempt, error)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return FETCHED

        def reader(self, schema):
            return Reader()

    return Source


def fetch_plan(urls: DataFrame, profile: DataFrame, cache: DataFrame) -> DataFrame:
    """urls with how each would be fetched: cached, rendered where its host's profile asks for it, plain."""
    from pagemill.functions.urls import authority
    from pagemill.operators.cache import lookup

    hosts = profile.select("host", "needs_js_render")
    rows = lookup(urls, cache).withColumn("host", F.lower(authority(F.col("url")))).join(hosts, "host", "left")
    return rows.withColumn("fetch_method", F.when(F.col("fetch_method") == "cached", "cached").when(F.coalesce("needs_js_render", F.lit(False)), "rendered").otherwise("plain"))
