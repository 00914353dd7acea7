"""Sinks: two CSV layouts, HTML documents, partitioned text, JDBC. ``file_sink`` writes a file a row.

Missing values are empty strings in CSV. Ids are derived from the row's URL, so a retried task
writes the same row; nothing depends on the clock unless a time is passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import values as V

BOM = "﻿"


def csv_a(rows: DataFrame, company: Column, time: Column) -> DataFrame:
    """The 18-column layout from url, title, html, publish_time, nav_levels (4), image_url, image_title."""
    level = lambda i: F.coalesce(F.get("nav_levels", F.lit(i)), F.lit(""))
    made = {
        "id": F.left(F.conv(F.left(F.md5("url"), F.lit(15)), 16, 10), F.lit(19)), "uuid": F.md5("url"), "bstudio_create_time": time, "timestamp": time, "gsmc": company, "url": F.col("url"), "riqi": F.col("publish_time"),
        "title": F.col("title"), "html": F.col("html"), "img_url": F.col("image_url"), "img_title": F.col("image_title"), **{f"ywlx{i + 1}": level(i) for i in range(4)},
    }
    return rows.select(*[F.coalesce(made.get(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in V.CSV_A])


def csv_b(rows: DataFrame, site: Column, time: Column) -> DataFrame:
    """The 12-column layout."""
    level = lambda i: F.coalesce(F.get("nav_levels", F.lit(i)), F.lit(""))
    made = {
        "sys_platfuuid": F.md5("url"), "brwidcl_cpmc": site, "ywlx": F.array_join(F.filter("nav_levels", lambda x: x != ""), "/"), "tianextimejsj": time, "title": F.col("title"), "html": F.col("html"),
        "download_img_url": F.col("image_url"), "img_title": F.col("image_title"), **{f"ywlx{i + 1}": level(i) for i in range(4)},
    }
    return rows.select(*[F.coalesce(made.get(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in V.CSV_B])


def skipped_html(reason: Column, detail: Column) -> Column:
    return F.concat(F.lit("<!-- "), reason, F.lit(": "), F.coalesce(detail, F.lit("")), F.lit(" -->"))


def write_csv(rows: DataFrame, path: str, quote_all: bool = True, mode: str = "append") -> None:
    """CSV with header; ``read_csv`` reads it back, line ends inside values included.

    A byte order mark is put before the first column's name, which is what makes spreadsheets read UTF-8.
    """
    first = rows.columns[0]
    rows.na.fill("").withColumnRenamed(first, BOM + first).write.mode(mode).csv(path, header=True, quoteAll=quote_all, escape='"', lineSep="\n", emptyValue="")


def read_csv(spark, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, enforceSchema=True, escape='"', multiLine=True, emptyValue="", nullValue="\0").na.fill("")


def html_document(body: Column, title: Column) -> Column:
    """A whole document as it is; a fragment wrapped."""
    whole = F.lower(F.ltrim(body)).rlike(r"^\s*(<!doctype|<html)")
    return F.when(whole, body).otherwise(F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head>\n<body>\n"), body, F.lit("\n</body></html>")))


def write_partitioned(rows: DataFrame, folder: str, levels: list[str]) -> None:
    """Rows as text files partitioned by levels, on any file system Spark writes to."""
    rows.select("html", *levels).write.mode("append").partitionBy(*levels).text(folder, lineSep="\0")


def for_database(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows not yet stored, with the placeholders and dates of the database table; one per URL."""
    text = ["gsmc", "ywlx1", "ywlx2", "ywlx3", "ywlx4", "title"]
    fresh = rows.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti")
    read = F.coalesce(*[F.try_to_timestamp("riqi", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")])
    return fresh.withColumns({c: F.coalesce(F.col(c), F.lit("无")) for c in text if c in rows.columns}).withColumn("riqi", read)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict) -> None:
    rows.write.jdbc(url, table, mode="append", properties=properties)
