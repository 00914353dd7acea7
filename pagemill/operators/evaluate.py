"""Evaluation: counters, failure runs, heuristic verdicts, comparison with expected data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from pagemill.functions import matching
from pagemill.operators import chunks


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def verdict(counts: DataFrame) -> DataFrame:
    """passed, score and issue from one row of saved, failed, skipped, with_images."""
    total = F.col("saved") + F.col("failed") + F.col("skipped")
    rate = F.col("failed") / F.greatest(total, F.lit(1))
    none, bad = F.col("saved") == 0, rate > 0.5
    return counts.select(
        "saved", "failed", "skipped", F.round(rate, 6).alias("failure_rate"), (~none & ~bad).alias("passed"),
        F.when(none, 0.1).when(bad, 0.4).otherwise(0.9).alias("score"),
        F.when(none, "content_quality").when(bad, "anti_crawl").otherwise("").alias("issue"),
        ((F.col("saved") > 0) & (F.col("with_images") == 0)).alias("image_missing"), (none | bad).alias("needs_js_render"),
    )


def failure_runs(log: DataFrame, by: str, order: str, failed: Column) -> DataFrame:
    """Rows with ``run``: how many failures in a row end at each, 0 after a success; ``order`` is a number or a time, and a key may hold all rows."""
    return chunks.runs(log, [by], [order], failed)


def trailing_run(log: DataFrame, by: str, order: str, failed: Column, ignored: Column) -> DataFrame:
    """(by, trailing): failures since each group's last success, ignored rows left out; as two aggregates."""
    rows = log.where(~ignored).select(F.col(by).alias("_by"), F.col(order).alias("_at"), failed.alias("_failed"))
    last = rows.groupBy("_by").agg(F.max(F.when(~F.col("_failed"), F.col("_at"))).alias("_ok")).withColumnRenamed("_by", "_of")
    after = F.col("_failed") & (F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))
    got = rows.join(last, rows["_by"].eqNullSafe(last["_of"])).groupBy("_by").agg(F.count_if(after).alias("trailing"))
    return got.withColumnRenamed("_by", by)


def retries(log: DataFrame, key: str, failed: Column, most: int = 3) -> DataFrame:
    """(key, attempts, exhausted) of keys that failed."""
    return log.where(failed).groupBy(key).agg(F.count("*").alias("attempts")).withColumn("exhausted", F.col("attempts") >= most)


@pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts in lower case; 1 if both are empty."""
    return pd.Series([matching.ratio(x, y) for x, y in zip(a.fillna("").str.lower(), b.fillna("").str.lower())], dtype="float64")


def golden(cases: DataFrame, least: float = 0.6) -> DataFrame:
    """Cases with the outcome of each check; an empty expectation passes.

    ``cases``: id, title, publish_time, breadcrumb, images and expected_* of each.
    """
    crumb = cases.select("id", F.explode("expected_breadcrumb").alias("e"), "breadcrumb").select("id", "e", F.explode_outer("breadcrumb").alias("a"))
    best = crumb.withColumn("s", F.when(F.col("a").isNull(), 0.0).otherwise(similarity("e", "a"))).groupBy("id", "e").agg(F.max("s").alias("s")).groupBy("id").agg(F.min("s").alias("crumb_score"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = cases.join(best, "id", "left").withColumn("title_ok", empty("expected_title") | (similarity("title", "expected_title") >= least))
    rows = rows.withColumn("time_ok", empty("expected_publish_time") | F.coalesce(F.startswith("publish_time", "expected_publish_time"), F.lit(False)))
    rows = rows.withColumn("crumb_ok", F.coalesce(F.col("crumb_score") >= least, F.lit(True))).withColumn("images_ok", F.coalesce(F.col("images") >= F.col("expected_images"), F.col("expected_images").isNull()))
    return rows.withColumn("passed", F.col("title_ok") & F.col("time_ok") & F.col("crumb_ok") & F.col("images_ok"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    n = F.count("*")
    return outcomes.agg(n.alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.round(100 * F.avg(F.col("passed").cast("double")), 6), F.lit(0.0)).alias("accuracy"))


def failed_samples(rows: DataFrame, text: str, order: list, most: int = 5, others: int = 3) -> DataFrame:
    """The sample report: all short rows and some others in order, ``most`` at most."""
    short = F.char_length(F.coalesce(F.col(text), F.lit(""))) < 200
    mixed = rows.withColumn("_short", short).where("_short").orderBy(*order).limit(most).unionByName(rows.withColumn("_short", short).where("not _short").orderBy(*order).limit(others))
    return mixed.orderBy(*order).limit(most).drop("_short")


def blocked_report(rows: DataFrame, url: str, reason: str, most: int = 10) -> DataFrame:
    """(reason, n, urls): how many URLs each reason blocked, the ``most`` first URLs of each; a URL counts once per reason.

    The list is the report's own limit; ``n`` counts all. First URLs are found by partial top-k of (reason, url) groups.
    """
    each = rows.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(F.col(reason).alias("reason"), F.col(url).alias("url")).agg(F.lit(1))
    counts = each.groupBy("reason").agg(F.count("*").alias("n"))
    first = each.withColumn("_nth", F.row_number().over(Window.partitionBy("reason").orderBy("url"))).where(F.col("_nth") <= most)
    listed = first.groupBy("reason").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return counts.join(listed, "reason", "left")


def usage(calls: DataFrame, by: list[str], tokens: list[str]) -> DataFrame:
    """The sums of token counts per group; missing counts are none."""
    return calls.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in tokens], F.count("*").alias("calls"))


def matched_length(text: Column, pattern: str) -> Column:
    """The characters of a text that matches of a pattern cover."""
    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), F.lit(0), lambda a, m: a + F.char_length(m))
