"""Intervals within intervals, by one sweep: nothing is compared with everything.

In the order of their starts (of equals the longest first) an interval lies within another exactly if
some earlier one ends no sooner, so the largest end so far decides. A key may hold most rows: chunks
of its order are swept at once, each with the largest end of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import chunks


def swept(rows: DataFrame, by: list[str], start: str, end: str, ties: list[str], least: int = chunks.LEAST) -> DataFrame:
    """``rows`` with ``contained``: whether another interval of the key holds all of theirs.

    Of equal intervals the first by ``ties`` is not held by the others. ``start`` is a number or a
    time. Rows with a null start or end are held by none and hold none.
    """
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    order = [F.col(start).asc(), F.col(end).desc(), *ties]
    cut = chunks.chunked(rows, by, F.col(start), least)
    before = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_far", F.max(F.when(whole, F.col(end))).over(before))
    ends = cut.groupBy(*by, "_chunk").agg(F.max(F.when(whole, F.col(end))).alias("_end"))
    carried = ends.withColumn("_carry", F.max("_end").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).where("_carry is not null").select(*by, "_chunk", "_carry")
    far = F.greatest("_far", "_carry")
    out = chunks.beside(inside, by, carried)
    return out.withColumn("contained", F.coalesce(whole & (far >= F.col(end)), F.lit(False))).drop("_far", "_carry", "_chunk")


def outermost(rows: DataFrame, by: list[str], start: str, end: str, ties: list[str], least: int = chunks.LEAST) -> DataFrame:
    return swept(rows, by, start, end, ties, least).where(~F.col("contained")).drop("contained")
