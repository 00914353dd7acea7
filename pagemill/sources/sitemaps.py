"""Sitemaps and their indexes as tables, expanded level by level.

``files`` is a table of fetched files (url, content as bytes), gzipped or not. A sitemap is read by
Spark's XML functions with a schema; one that is no XML gives its http lines. Each level joins the
locations of the indexes before it with the files; files seen are not read again, so indexes that name
each other end. Locations without a file are reported, not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.lineage import cut

_ENTRY = "array<struct<loc: string, lastmod: string, changefreq: string, priority: double>>"
XML = f"url {_ENTRY}, sitemap {_ENTRY}"
FOUND = "sitemap string, level int, pos int, kind string, url string, lastmod string, priority double"


def unpacked(content: DataFrame, column: str = "content") -> DataFrame:
    """``content`` with the bytes of gzipped rows unpacked; those that are broken are null."""
    packed = F.col(column).isNotNull() & (F.substring(F.hex(F.substring(column, 1, 2)), 1, 4) == "1F8B")
    at = content.columns.index(column)

    def unpack(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            out = []
            for data in b.column(at).to_pylist():
                if data is not None and data[:2] == b"\x1f\x8b":
                    try:
                        data = zlib.decompressobj(47).decompress(data)
                    except zlib.error:
                        data = None
                out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    plain = content.where(~F.coalesce(packed, F.lit(False)))
    return plain.unionByName(content.where(packed).mapInArrow(unpack, T.StructType([T.StructField(f.name, f.dataType) for f in content.schema.fields])))


def entries(text: Column) -> Column:
    """array of (kind, url, lastmod, priority) of one file's text: ``page`` or ``sitemap``."""
    # Prefixes and declarations of name spaces are left out, so that elements have their plain names.
    plain = F.regexp_replace(F.regexp_replace(text, r"(</?)[A-Za-z][\w.-]*:", "$1"), r"""\sxmlns(:\w+)?\s*=\s*("[^"]*"|'[^']*')|\s\w+:\w+\s*=\s*("[^"]*"|'[^']*')""", "")
    said = F.from_xml(plain, XML)
    made = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), F.btrim(e["loc"]).alias("url"), F.btrim(e["lastmod"]).alias("lastmod"), e["priority"].alias("priority"))
    none = F.array().cast("array<struct<kind: string, url: string, lastmod: string, priority: double>>")
    xml = F.concat(F.coalesce(F.transform(said["sitemap"], made("sitemap")), none), F.coalesce(F.transform(said["url"], made("page")), none))
    lines = F.transform(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.btrim(x)), lambda x: F.startswith(x, F.lit("http"))), lambda x: F.struct(F.lit("page").alias("kind"), x.alias("url"), F.lit(None).cast("string").alias("lastmod"), F.lit(None).cast("double").alias("priority")))
    found = F.when(F.contains(text, F.lit("<loc>")) | plain.rlike("<loc>"), xml).otherwise(lines)
    return F.filter(F.coalesce(found, none), lambda e: F.coalesce(e["url"], F.lit("")) != "")


def expanded(files: DataFrame, roots: DataFrame, most: int = 5) -> DataFrame:
    """``FOUND``: every location in the sitemaps that ``roots`` (url) lead to, with the sitemap that names it, its level and place.

    ``kind``: page, sitemap, or missing where a sitemap's file is not there.
    """
    texts = unpacked(files.select("url", "content")).select("url", F.decode("content", "UTF-8").alias("text")).groupBy("url").agg(F.min("text").alias("text"))
    frontier, seen, parts = roots.select("url").where("url is not null").distinct(), None, []
    for level in range(most + 1):
        here = frontier.join(texts, "url").select(F.col("url").alias("sitemap"), F.lit(level).alias("level"), F.posexplode(entries(F.col("text"))).alias("pos", "e")).select("sitemap", "level", "pos", "e.*")
        here = cut(here)
        parts.append(here)
        seen = frontier if seen is None else seen.unionByName(frontier)
        frontier = cut(here.where("kind = 'sitemap'").select("url").distinct().join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = files.select(F.col("url").alias("_file")).distinct().withColumn("_there", F.lit(True))
    told = out.join(known, F.col("url") == F.col("_file"), "left")
    return told.withColumn("kind", F.when((F.col("kind") == "sitemap") & F.col("_there").isNull(), "missing").otherwise(F.col("kind"))).select("sitemap", "level", "pos", "kind", "url", "lastmod", "priority")


def files_of(spark, path: str, address: Column) -> DataFrame:
    """(url, content) of the files below a folder; ``address`` makes the URL from ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(address.alias("url"), "content")
