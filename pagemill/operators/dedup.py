"""Exact dedup of pages and results by content hash, and the status of each row at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.operators import chunks


def by_hash(rows: DataFrame, value: Column, order: list) -> DataFrame:
    """Rows with ``content_hash`` and ``copy`` (1 for the first of its content); rows without content are each first.

    Rows without content (empty or null hash) are dealt out by their order columns, as they are never compared.
    """
    rows = rows.withColumn("content_hash", value)
    none = F.coalesce(F.col("content_hash"), F.lit("")) == ""
    spread = F.when(none, F.xxhash64(*order)).otherwise(F.lit(0))
    nth = F.row_number().over(Window.partitionBy("content_hash", spread).orderBy(*order))
    return rows.withColumn("copy", F.when(none, 1).otherwise(nth))


def routed(rows: DataFrame, text: str, is_list: str, order: list) -> DataFrame:
    """Rows with ``status``: skipped_empty under 50 characters, skipped_list, skipped_duplicate, success."""
    plain = F.coalesce(F.col(text), F.lit(""))
    early = F.when(F.char_length(plain) < 50, "skipped_empty").when(F.coalesce(F.col(is_list), F.lit(False)), "skipped_list")
    marked = by_hash(rows.withColumn("_early", early), F.when(early.isNull(), rules.body_hash(plain)).otherwise(F.lit("")), order)
    return marked.withColumn("status", F.coalesce("_early", F.when(F.col("copy") > 1, "skipped_duplicate").otherwise("success"))).drop("_early", "copy")


def thrice(rows: DataFrame, html: str, key: str, path: str, order: list) -> DataFrame:
    """First of each whole page, then of each URL key, then of each path, in this order."""
    from pagemill.operators.links import first_seen

    rows = first_seen(rows.withColumn("_h", F.md5(F.coalesce(html, F.lit("")))), ["_h"], order).drop("_h")
    return first_seen(first_seen(rows, [key], order), [path], order)


def running_image_count(images: DataFrame, order: list, threshold: int = 5) -> DataFrame:
    """Images with the running count of their content; from the threshold on they are decoration. The first of ``order`` is a number or a time."""
    return chunks.numbered(images, ["md5"], order, "seen").withColumn("repeated", F.col("seen") >= threshold)
