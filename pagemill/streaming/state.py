"""Streaming: dedup of keys, keyed retry state, windows over events.

The same functions take a streaming or a batch frame where that is possible. State is bounded by
watermarks: keys older than the delay are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.streaming import keyed

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Event files as a stream, ``per_batch`` files a micro-batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_batch).parquet(folder)


def distinct_keys(rows: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts(rows: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def retry_state(rows: DataFrame, most: int = 3, backoff: float = 60.0, delay: str = "1 hour") -> DataFrame:
    """(user_id, failures, exhausted) after each batch: failures counted per key, a success clears them.

    On batch frames it is two aggregates; a stream keeps keyed state (``keyed.retries``).
    """
    failed = F.col("event_type") == "error"
    if rows.isStreaming:
        told = keyed.retries(rows, "user_id", "event_id", failed, most, backoff, delay=delay).where("kind = 'counted'")
        return told.select(F.col("key").alias("user_id"), "failures", "exhausted")
    at = F.struct("ts", "event_id")
    last = rows.groupBy(F.col("user_id").alias("_user")).agg(F.max(F.when(~failed, at)).alias("_ok"))
    after = failed & (F.col("_ok").isNull() | (at > F.col("_ok")))
    got = rows.join(last, F.col("user_id").eqNullSafe(F.col("_user"))).groupBy("user_id").agg(F.count_if(after).alias("failures"))
    return got.withColumn("exhausted", F.col("failures") >= most)


def drain(stream: DataFrame, checkpoint: str, mode: str = "append", key: list[str] | None = None, progress: Callable[[int, dict], None] | None = None, stop: Callable[[], bool] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote; with ``key`` only the last row of each.

    ``progress`` gets the number and the report of each batch that ended. ``stop`` is asked every
    quarter of a second; once it says yes the query ends, and a later run goes on where it stopped.
    """
    spark, target, told = stream.sparkSession, f"{checkpoint}/out", set()

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/b={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/log").foreachBatch(put).trigger(availableNow=True).start()

    def report() -> None:
        for p in query.recentProgress if progress is not None else ():
            if p["batchId"] not in told:
                told.add(p["batchId"])
                progress(p["batchId"], p)

    while not query.awaitTermination(0.25 if progress or stop else None):
        report()
        if stop is not None and stop():
            query.stop()
            break
        if not (progress or stop):
            break
    report()
    out = spark.read.option("recursiveFileLookup", True).parquet(target)
    if key is None:
        return out.drop("_batch")
    rest = [c for c in out.columns if c not in (*key, "_batch")]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")
