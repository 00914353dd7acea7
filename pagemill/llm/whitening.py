"""Whitening of vectors by a covariance that Spark sums in one aggregation.

Entries are taken as integers (``floor(SCALE * c) + SHIFT``), so all sums are exact and do not depend
on how rows are spread. A first aggregation has each dimension's sum and extremes; a second one has a
generated SQL expression for every pair of the upper triangle, the sum of products of entries that are
centred by the integer next to their mean. What is left of the mean is taken off exactly on the driver,
which holds d * d numbers and never a row. Longs are summed where the extremes prove that they are wide
enough, else decimals. LAPACK decomposes the covariance; rows are projected in arrow batches.

The projected rows are written once, and their own covariance, by the same expressions, gives
``identity_error``.

Rows whose vector is null or holds null or non-finite entries take no part, nor do rows whose vector
has another length than most have (the longest of equally frequent ones), nor empty vectors. Entries
beyond 2^53 / SCALE count as that bound. Components without variance (constant or dependent
dimensions, a single row) give 0 and explain 0; ``identity_error`` leaves them out. Repeated rows count
as often as they occur. Empty tables give empty results. Columns to keep travel in a struct, so their
names cannot clash with those used here, save the added ones.

Past ``PAIRS`` pairs (256 dimensions) the triangle is summed in several aggregations of so many
expressions, as one plan of all would outgrow the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import Work, bounded_batches, free_names

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Expressions in one aggregation.
PAIRS = 33_000
#: Variance, against the largest, from which a component counts as one.
RANK = 1e-13
_MOST = 1 << 53


@dataclass
class Fit:
    """What whitening needs of a table; ``centre`` + ``rest`` / n is the mean of the integers, exactly."""

    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray
    axes: np.ndarray  # a column a component

    @property
    def explained(self) -> np.ndarray:
        total = float(np.sum(self.values))
        return np.maximum(self.values, 0) / total if total > 0 else np.zeros(len(self.values))


def integers(df: DataFrame, vector: str | Column) -> DataFrame:
    """``df`` with ``x``, the vector's entries as integers; only rows that take part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(float(-_MOST))), F.lit(float(_MOST)))).cast("long") + SHIFT
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    found = df.where(F.coalesce(fine, F.lit(False))).withColumn("x", F.transform(v, entry))
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("x") == (sizes["d"] if sizes else 0))


def upper_triangle(entries: list[str], kind: str) -> list[str]:
    """SQL sums of the products of every pair of entries, by rows of the upper triangle."""
    return [f"sum(cast({a} as {kind}) * {b})" for i, a in enumerate(entries) for b in entries[i:]]


def _summed(df: DataFrame, sums: list[str]) -> list:
    """The values of SQL aggregates over the whole table."""
    out: list = []
    for at in range(0, len(sums), PAIRS):
        row = df.agg(F.array(*[F.expr(s) for s in sums[at : at + PAIRS]]).alias("s")).first()
        out += row["s"]
    return out


def _square(values: list, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = values
    return m + np.triu(m, 1).T


def fit(rows: DataFrame) -> Fit | None:
    """The covariance of column ``x`` of long arrays of one length, decomposed; None without rows."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    entries = [f"x[{i}]" for i in range(d)]
    got = _summed(rows, [f"{f}(cast({e} as decimal(20, 0)))" for f in ("sum", "min", "max") for e in entries] + ["sum(cast(1 as decimal(20, 0)))"])
    got = [int(g) for g in got]
    total, low, high, n = got[:d], got[d : 2 * d], got[2 * d : 3 * d], got[3 * d]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    far = max(max(h - c, c - a) for h, a, c in zip(high, low, centre))
    kind = "bigint" if n * far * far < 1 << 62 else "decimal(19, 0)"
    centred = rows.select(F.array(*[F.expr(f"{e} - {c}L" if kind == "bigint" else f"cast({e} - {c}L as {kind})") for e, c in zip(entries, centre)]).alias("y"))
    products = _summed(centred, upper_triangle([f"y[{i}]" for i in range(d)], kind))
    i, j = np.triu_indices(d)
    exact = [(n * int(p) - rest[a] * rest[b]) / (n * n) for p, a, b in zip(products, i.tolist(), j.tolist())]
    values, axes = np.linalg.eigh(_square(exact, d))
    return Fit(n, centre, rest, values[::-1].copy(), axes[:, ::-1].copy())


def project(rows: DataFrame, model: Fit, kept: T.StructType, components: int = COMPONENTS) -> DataFrame:
    """Rows of (kept struct, x) as (kept, deviation decimal, white array<double>)."""
    m = min(components, len(model.values))
    some = model.values[:m] > RANK * max(model.values[0], 0)
    weight = np.where(some, model.axes[:, :m] / np.sqrt(np.where(some, model.values[:m], 1)), 0)
    sent = rows.sparkSession.sparkContext.broadcast((model.n, np.array(model.centre), model.rest, weight))

    def each(batches):
        from decimal import Decimal

        import pyarrow as pa

        n, centre, rest, weight = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - centre
            white = (y - np.array([r / n for r in rest])) @ weight
            if (n * (int(np.abs(y).max()) + 1)) ** 2 * y.shape[1] < 1 << 62:
                deviation = pa.array(((n * y - np.array(rest)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in y]
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            cuts = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.ListArray.from_arrays(cuts, pa.array(white.ravel()))], ["kept", "deviation", "white"])

    schema = T.StructType([T.StructField("kept", kept), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("white", T.ArrayType(T.DoubleType()))])
    return rows.select("kept", "x").mapInArrow(each, schema)


def identity_error(white: DataFrame, n: int, live: list[int]) -> float:
    """The largest absolute entry of the covariance of ``white`` minus the identity, over the components ``live``."""
    if not live:
        return 0.0
    entries = [f"white[{i}]" for i in live]
    means = _summed(white, [f"avg({e})" for e in entries])
    products = _summed(white, upper_triangle([f"({e} - ({m!r}D))" for e, m in zip(entries, means)], "double"))
    return float(np.abs(_square([p / n for p in products], len(live)) - np.eye(len(live))).max())


def whiten(df: DataFrame, vector: str, keep: list[Column], components: int = COMPONENTS) -> DataFrame:
    """``keep`` for each row that takes part and each component, with the columns of ``ADDED``; deviation is null beyond 38 digits."""
    spark = df.sparkSession
    bounded_batches(spark, rows=10_000)
    free_names(df.select(*keep), *(name for name, _ in ADDED))
    kept = df.select(*keep).schema
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in kept.fields])
    rows = integers(df.select(F.struct(*keep).alias("kept"), F.col(vector).alias("v")), "v").select("kept", "x")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], T.StructType([*kept.fields, *[T.StructField(name, kind) for name, kind in ADDED]]))
    white = Work(spark, "whitening").table(project(rows, model, kept, components), "white")
    m = min(components, len(model.values))
    error = identity_error(white, model.n, [i for i in range(m) if model.values[i] > RANK * max(model.values[0], 0)])
    explained = F.array(*[F.lit(float(e)) for e in model.explained[:m]])
    each = white.select("kept", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        *[F.col("kept").getField(f.name).alias(f.name) for f in kept.fields],
        (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


ADDED = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
