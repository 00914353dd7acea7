"""Queries over whole runs: validation, image embedding, a site crawl and its verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.pages import parse_pages
from pagemill.operators import images, validate
from pagemill.plans import crawl
from pagemill.plans.page_queries import _with_images
from pagemill.plans.registry import register
from pagemill.sources.readers import pages, table


@register(
    "validate_articles",
    """SELECT doc_id, doc_id % 5 <> 0 AND trim(text) <> '' AND length(trim(text)) <= 500 AS is_valid,
    concat_ws('; ', CASE WHEN doc_id % 5 = 0 THEN 'url' END, CASE WHEN trim(text) = '' THEN 'title is empty' END, CASE WHEN length(trim(text)) > 500 THEN 'title is too long' END) AS error_reason FROM documents""",
)
def validate_articles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 5 == 0, "ftp://h/").otherwise("https://h/")
    rows = d.select("doc_id", url.alias("url"), F.col("text").alias("title"), F.lit(None).cast("array<string>").alias("breadcrumb"), F.lit(1).alias("images_count"), F.array("lang").alias("nav_levels"))
    return validate.checked(rows).select("doc_id", "is_valid", "error_reason")


@register("image_embedding", "SELECT page_id, (page_id % 5 = 1 AND page_id < 20)::INTEGER AS ok, (page_id % 5 = 3)::INTEGER AS failed FROM pages")
def image_embedding(spark, sf_dir):
    """Of five kinds of pages: an icon stays out, b.jpg is embedded its first four times, the source of lazy loading is a repeated picture, d.webp is missing."""
    rows = _with_images(spark, sf_dir)
    parsed = parse_pages(rows, [F.col("page_id")], ["images"], F.col("url"), F.col("html"))
    blob = lambda name, data, status: (f"https://h.example/p/{name}", bytearray(data), "image/jpeg", status)
    blobs = spark.createDataFrame([blob("b.jpg", b"JPEG", 200), blob("d.webp", b"", 404)], "url string, content binary, content_type string, status int")
    return images.embedded(rows, parsed.where("page_id % 5 <> 2"), blobs.where("status = 200")).select("page_id", "ok", "failed")


def _site(spark, sf_dir):
    return crawl.site(pages(spark, sf_dir))


@register("site_crawl")
def site_crawl(spark, sf_dir):
    return _site(spark, sf_dir)


@register("site_outcome")
def site_outcome(spark, sf_dir):
    return crawl.outcome(_site(spark, sf_dir))
