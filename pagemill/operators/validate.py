"""Validation of extracted articles: valid rows on, invalid ones aside with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLE = "url string, title string, publish_time string, breadcrumb array<string>, html_content string, images_count int, nav_levels array<string>"
_LIST = f"array<struct<{', '.join(p.replace(' ', ': ', 1) for p in ARTICLE.split(', '))}>>"
#: Longest HTML that a tool answer carries.
ANSWER_HTML = 50_000


def faults() -> Column:
    """array of what is wrong with an article row."""
    title = F.btrim(F.coalesce("title", F.lit("")))
    checks = [
        F.when(~F.coalesce(F.col("url"), F.lit("")).rlike("^https?://"), "url"),
        F.when(title == "", "title is empty"),
        F.when(F.char_length(title) > 500, "title is too long"),
        F.when(F.coalesce("images_count", F.lit(0)) < 0, "images_count"),
        F.when(F.size("nav_levels") != 4, "nav_levels"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def checked(articles: DataFrame) -> DataFrame:
    """Articles with is_valid and error_reason; titles lose blanks at their ends, missing levels become empty."""
    none = F.array().cast("array<string>")
    levels = F.slice(F.concat(F.coalesce("nav_levels", none), F.array_repeat(F.lit(""), 4)), 1, F.greatest(F.size(F.coalesce("nav_levels", none)), F.lit(4)))
    rows = articles.withColumn("title", F.btrim("title")).withColumn("breadcrumb", F.coalesce("breadcrumb", none)).withColumn("nav_levels", levels)
    reason = F.array_join(faults(), "; ")
    return rows.withColumn("error_reason", reason).withColumn("is_valid", F.col("error_reason") == "")


def split(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows."""
    rows = checked(articles)
    return rows.where("is_valid").drop("is_valid", "error_reason"), rows.where("not is_valid")


def from_json(answers: DataFrame, column: str = "articles_json", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the articles of JSON lists, a fence of back-quotes around them allowed; what cannot be read gives none."""
    bare = F.regexp_replace(F.coalesce(column, F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return answers.select(*(keep or []), F.explode(F.from_json(bare, _LIST)).alias("a")).select(*(keep or []), "a.*")


def to_json(articles: DataFrame) -> DataFrame:
    """One JSON answer a row, the HTML cut to what an answer carries."""
    return articles.withColumn("html_content", F.left("html_content", F.lit(ANSWER_HTML))).select("url", F.to_json(F.struct("*")).alias("answer"))
