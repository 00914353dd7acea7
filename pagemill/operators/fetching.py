"""Fetch logs: which errors are tried again, and what becomes of each URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Errors without a status that are worth another try: time-outs and lost connections.
TRANSIENT = r"(?i)timeout|timed out|connection"


def retryable(status: Column, error: Column) -> Column:
    """Whether a failed attempt may be repeated: a server's error, or no answer in time."""
    return F.when(status.isNotNull(), status >= 500).otherwise(F.coalesce(error.rlike(TRANSIENT), F.lit(False)))


def fatal(status: Column) -> Column:
    """Whether a status settles that there is no page: 400 to 499 but for 429."""
    return F.coalesce(status.between(400, 499) & (status != 429), F.lit(False))


def outcomes(log: DataFrame, key: str = "url", order: str = "seq", most: int = 3) -> DataFrame:
    """(key, attempts, outcome, status): what the first ``most`` attempts at each key came to.

    ``log``: key, order, status (null without an answer). ``fetched`` and ``fatal`` end a key's
    attempts; else it is ``exhausted`` after ``most`` and ``pending`` before. Later attempts don't count.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    tried = log.select(key, F.col("status"), nth.alias("nth")).where(F.col("nth") <= most)
    kind = F.when(F.col("status") == 200, "fetched").when(fatal(F.col("status")), "fatal")
    ended = F.min(F.when(kind.isNotNull(), F.struct("nth", kind.alias("kind"), "status"))).alias("end")
    got = tried.groupBy(key).agg(ended, F.max("nth").alias("n"), F.max_by("status", "nth").alias("last"))
    waiting = F.when(F.col("n") >= most, "exhausted").otherwise("pending")
    return got.select(key, F.coalesce("end.nth", "n").alias("attempts"), F.coalesce("end.kind", waiting).alias("outcome"), F.when(F.col("end").isNull(), F.col("last")).otherwise(F.col("end.status")).alias("status"))


def again(outcome: DataFrame) -> DataFrame:
    """The keys to be fetched again in the next round."""
    return outcome.where("outcome = 'pending'")


def due(log: DataFrame, most: int = 3, backoff: float = 30.0, key: str = "url") -> DataFrame:
    """(key, attempt, not_before): what must be fetched again, and when at the earliest.

    ``log``: key, attempt, status, error, started (seconds). A key's last attempt decides; one that may
    be repeated is due ``backoff`` seconds after it began, twice as long after each further one.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct("attempt", "status", "error", "started"), "attempt").alias("l"))
    again_ = (F.col("l.attempt") < most) & (F.coalesce(F.col("l.status"), F.lit(0)) != 200) & (retryable(F.col("l.status"), F.col("l.error")) | F.col("l.status").eqNullSafe(F.lit(429)))
    return last.where(again_).select(key, (F.col("l.attempt") + 1).alias("attempt"), (F.col("l.started") + backoff * F.pow(F.lit(2.0), F.col("l.attempt") - 1)).alias("not_before"))
