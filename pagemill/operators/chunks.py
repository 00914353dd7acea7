"""Windows over keys that may hold most of a table: numbering and runs, cut into chunks of rows.

A window gives a key's rows to one task. Here the keys with more than a fair share of rows (few, by
the share) are cut at quantiles of their order; windows run inside chunks, and what a chunk must know
of those before it (a count, or a run that may go on) comes from a table with a row a chunk, which has
``CHUNKS`` rows for each of these keys at most and is broadcast. Other keys are one chunk each.

``place`` is a number that never falls along the order, the first order column by default: chunks are
cut by it, rows of one place stay together. Null keys are one key; null places come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which a key can count as large, parts of a fair share that it must hold, chunks it is cut into at most.
LEAST, SHARE, CHUNKS = 4096, 4, 256


def chunked(rows: DataFrame, by: list[str], place: Column, least: int = LEAST) -> DataFrame:
    """``rows`` with ``_chunk``, which rises along the order of a key: 0 for all rows of a key that is not large."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_chunks = max(2, min(CHUNKS, tasks * 2))
    rows = rows.withColumn("_place", place.cast("double"))
    counts = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"), F.percentile_approx("_place", [i / n_chunks for i in range(1, n_chunks)], 10_000).alias("_cuts"))
    total = rows.count()
    if total <= least:
        return rows.withColumn("_chunk", F.lit(0).alias("_chunk", metadata={"one": True})).drop("_place")
    large = counts.where(F.col("_n") > max(least, SHARE * total // tasks if tasks > SHARE else least))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    # At most tasks / SHARE keys are large, or total / least where that is fewer tasks than a fair share.
    joined = rows.join(F.broadcast(large.drop("_n")), same, "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_place")))
    return joined.withColumn("_chunk", F.when(F.col("_cuts").isNull() | F.col("_place").isNull(), 0).otherwise(below)).drop("_place", "_cuts", *[f"_k{i}" for i in range(len(by))])


def beside(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """``rows`` with the columns of a small table with a row a (key, chunk)."""
    same = F.col("_chunk") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    small = table.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_chunk").alias("_c"), *[c for c in table.columns if c not in (*by, "_chunk")])
    return rows.join(F.broadcast(small), same, "left").drop("_c", *[f"_b{i}" for i in range(len(by))])


def numbered(rows: DataFrame, by: list[str], order: list, name: str = "n", place: Column | None = None, least: int = LEAST) -> DataFrame:
    """``rows`` with ``name``: their number from 1 inside their key, along the order."""
    cut = chunked(rows, by, _place(order, place), least)
    inside = F.row_number().over(Window.partitionBy(*by, "_chunk").orderBy(*order)).cast("long")
    if cut.schema["_chunk"].metadata.get("one"):
        return cut.withColumn(name, inside).drop("_chunk")
    sizes = cut.groupBy(*by, "_chunk").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0").drop("_size")
    return beside(cut.withColumn(name, inside), by, before).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_chunk")


def first(rows: DataFrame, by: list[str], order: list, most: int, place: Column | None = None, least: int = LEAST) -> DataFrame:
    """The first ``most`` rows of every key along the order, all keys being one where ``by`` is empty."""
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    name = "_nth"
    return numbered(rows, keys, order, name, place, least).where(F.col(name) <= most).drop(name, "_all")


def runs(rows: DataFrame, by: list[str], order: list, failed: Column, name: str = "run", place: Column | None = None, least: int = LEAST) -> DataFrame:
    """``rows`` with ``name``: how many failed rows in a row end at each, 0 after one that did not fail.

    A chunk is summed up by its length, whether all of it failed, and the run at its end. Summaries
    of one key are put together in order; a chunk's first run is then lengthened by the run before it.
    """
    cut = chunked(rows.withColumn("_failed", F.coalesce(failed, F.lit(False))), by, _place(order, place), least)
    along = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Failures since the last row that did not fail: the failures so far less those up to that row.
    so_far = F.sum(F.col("_failed").cast("long")).over(along)
    reset = F.coalesce(F.max(F.when(~F.col("_failed"), F.col("_so_far"))).over(along), F.lit(0))
    held = F.max(F.when(~F.col("_failed"), 1).otherwise(0)).over(along)
    inside = cut.withColumn("_so_far", so_far).withColumn(name, F.col("_so_far") - reset).withColumn("_broken", held == 1)
    ends = inside.groupBy(*by, "_chunk").agg(F.count("*").alias("_size"), F.bool_and("_failed").alias("_whole"), F.max("_so_far").alias("_sum"), F.max(F.when(~F.col("_failed"), F.col("_so_far"))).alias("_last"))
    ends = ends.withColumn("_tail", F.col("_sum") - F.coalesce("_last", F.lit(0)))
    # The run before a chunk: the tails of the chunks back to the last one that did not fail throughout.
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = ends.withColumn("_total", F.sum(F.when(F.col("_whole"), F.col("_size")).otherwise(0)).over(Window.partitionBy(*by).orderBy("_chunk")))
    broken = tails.withColumn("_at", F.max(F.when(~F.col("_whole"), F.struct("_chunk", "_tail", "_total"))).over(before)).withColumn("_all", F.lag("_total", 1, 0).over(Window.partitionBy(*by).orderBy("_chunk")))
    carried = broken.withColumn("_carry", F.coalesce(F.col("_at._tail"), F.lit(0)) + F.col("_all") - F.coalesce(F.col("_at._total"), F.lit(0))).where("_carry > 0").select(*by, "_chunk", "_carry")
    out = beside(inside, by, carried)
    return out.withColumn(name, F.col(name) + F.when(F.col("_broken"), 0).otherwise(F.coalesce("_carry", F.lit(0)))).drop("_failed", "_so_far", "_broken", "_carry", "_chunk")


def _place(order: list, place: Column | None) -> Column:
    if place is not None:
        return place
    return F.col(order[0]) if isinstance(order[0], str) else order[0]
