"""Categories: joins of pages with navigation by path prefix, paths and names of output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import rules, urls
from pagemill.functions import values as V
from pagemill.operators import chunks


def _prefixes(path: Column) -> Column:
    """A path and all its parents, '' for the root."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.when(n > 0, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def by_navigation(pages: DataFrame, nav: DataFrame, key: str = "page_id", longest: bool = False) -> DataFrame:
    """Pages with ``category``: home, the entry equal to the path, else one that begins it, else other.

    ``nav``: name, prefix, ord. An equi-join on the page's own prefixes replaces the theta join, so
    it scales with the pages whatever the size of the navigation. Of several entries an equal one
    comes first, then the smallest ord, or with ``longest`` the longest prefix.
    """
    path = F.regexp_replace(urls.path(F.col("url")), "/+$", "")
    each = pages.select(key, path.alias("path"), F.explode(_prefixes(path)).alias("prefix"))
    entry = nav.select("name", F.regexp_replace("prefix", "/+$", "").alias("prefix"), "ord").where("prefix <> ''")
    found = each.join(entry, "prefix").select(key, "name", "ord", (F.col("prefix") == F.col("path")).alias("exact"), F.length("prefix").alias("n"))
    rank = F.struct((~F.col("exact")).alias("a"), (-F.col("n") if longest else F.lit(0)).alias("b"), F.col("ord").alias("c"))
    best = found.groupBy(key).agg(F.min_by("name", rank).alias("name"))
    home = F.when(path == "", F.lit(V.HOME_CATEGORY))
    return pages.join(best, key, "left").withColumn("category", F.coalesce(home, F.col("name"), F.lit(V.OTHER_CATEGORY))).drop("name")


def nav_levels(crumbs: Column, category: Column, url: Column, title: Column) -> Column:
    """Four levels: the breadcrumb, else category, path and the head of the title."""
    own = F.transform(F.slice(F.coalesce(crumbs, F.array().cast("array<string>")), 1, 4), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    named = F.when(category != V.OTHER_CATEGORY, F.array(category)).otherwise(F.array().cast("array<string>"))
    by_path, head = urls.path_levels(url), F.array(F.left(F.coalesce(title, F.lit("")), F.lit(20)))
    found = F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).when(F.size(by_path) > 0, by_path).otherwise(head)
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), 4)), 1, 4)


def merged_path(path: Column, crumbs: Column) -> Column:
    """A page's path after its breadcrumb is known: the breadcrumb, then what it lacks of the path."""
    none = F.array().cast("array<string>")
    path, crumbs = F.coalesce(path, none), F.coalesce(crumbs, none)
    better = F.when(F.size(path) == 0, (F.size(crumbs) >= 2) | ((F.size(crumbs) == 1) & ~rules.like_title(F.get(crumbs, F.lit(0))))).otherwise(F.size(crumbs) > F.size(path))
    return F.when(F.coalesce(better, F.lit(False)), F.array_distinct(F.concat(crumbs, path))).otherwise(path)


def file_paths(rows: DataFrame, folder: Column, name: Column, order: list) -> DataFrame:
    """Rows with ``file_path``: folder/name.html, later ones of one path with _1, _2 and so on.

    ``order`` begins with a number or a time. A path may hold all rows: they are numbered in chunks.
    """
    rows = chunks.numbered(rows.withColumn("_dir", folder).withColumn("_name", name), ["_dir", "_name"], order, "_nth")
    rows = rows.withColumn("_nth", F.col("_nth") - 1)
    mark = F.when(F.col("_nth") > 0, F.concat(F.lit("_"), F.col("_nth"))).otherwise(F.lit(""))
    return rows.withColumn("file_path", F.concat_ws("/", F.when(F.col("_dir") != "", F.col("_dir")), F.concat("_name", mark, F.lit(".html")))).drop("_dir", "_name", "_nth")


def folder_of(levels: Column, most: int = 40) -> Column:
    return F.array_join(F.transform(F.filter(levels, lambda x: x != ""), lambda x: rules.safe_name(x, most, "")), "/")
