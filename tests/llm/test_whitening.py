"""Whitening against numpy, and exact sums against Python's integers."""

import math

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from pagemill.llm import queries, whitening


def brute(vectors):
    """(n, V, exact sums of squares) of the integers of vectors."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = (d.T @ d) / n**3
    return n, v.astype(float), [int(t) for t in (d * d).sum(axis=1)], (d / n).astype(float)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x long, white string")


def columns(got):
    """{vec_id: {component: row}}"""
    out = {}
    for r in got:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_op13(spark):
    df = queries.QUERIES["op13_whitening"](spark, SF)
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = columns(df.collect())
    source = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(source)
    n, v, deviation, centred = brute([source[i] for i in ids])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert sorted(got) == ids and all(sorted(c) == list(range(1, 33)) for c in got.values())
    white = np.array([[got[i][k]["whitened"] for k in range(1, 33)] for i in ids])
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * sign, atol=1e-7)
    assert [got[i][1]["deviation"] for i in ids] == deviation and {r["n"] for c in got.values() for r in c.values()} == {n}
    assert np.allclose([got[ids[0]][k]["explained"] for k in range(1, 33)], values[:32] / np.trace(v), rtol=1e-9)
    error = {r["identity_error"] for c in got.values() for r in c.values()}
    assert len(error) == 1 and error.pop() <= 1e-8


def test_covariance_is_exact_for_wide_and_large_entries(spark):
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e9):
        vectors = (rng.normal(size=(40, 5)) * scale + scale).astype(np.float32).tolist()
        rows = whitening.integers(table(spark, [(i, v, 0, 0, "") for i, v in enumerate(vectors)]), "embedding")
        model = whitening.fit(rows)
        n, v, deviation, _ = brute(vectors)
        assert model.n == n and np.allclose(model.axes @ np.diag(model.values) @ model.axes.T, v, rtol=1e-9, atol=1e-9 * abs(v).max())
        got = whitening.whiten(table(spark, [(i, w, 0, 0, "") for i, w in enumerate(vectors)]), "embedding", [F.col("vec_id")]).where("component = 1").collect()
        assert [int(r["deviation"]) for r in sorted(got, key=lambda r: r["vec_id"])] == deviation


def test_odd_vectors(spark):
    ok = [[1.0, 2.0, 0.5], [0.0, -1.0, 0.5], [3.0, 0.25, 0.5], [0.0, -1.0, 0.5]]
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0]]
    df = table(spark, [(None if i == 2 else i, v, None, 7, "clash") for i, v in enumerate([*ok, *bad])])
    got = whitening.whiten(df, "embedding", [F.struct("*").alias("row")]).collect()
    assert len(got) == 4 * 3 and {r["n"] for r in got} == {4}
    n, v, deviation, _ = brute(ok)
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation)
    assert {r["whitened"] for r in got if r["component"] == 3} == {0.0}  # a constant dimension has no variance
    assert all(r["identity_error"] < 1e-9 for r in got)
    single = whitening.whiten(df.where("vec_id = 0"), "embedding", [F.col("vec_id")]).collect()
    assert [(r["n"], r["whitened"], r["explained"], r["identity_error"]) for r in single] == [(1, 0.0, 0.0, 0.0)] * 3
    for none in (df.limit(0), df.where("vec_id = 4")):
        empty = whitening.whiten(none, "embedding", [F.col("vec_id")])
        assert empty.collect() == [] and empty.columns == ["vec_id", *(c for c, _ in whitening.ADDED)]
    with pytest.raises(ValueError, match="columns to keep"):
        whitening.whiten(df.withColumn("n", F.lit(1)), "embedding", [F.col("n")])


def test_huge_entries_count_as_the_bound(spark):
    df = table(spark, [(0, [3e38, 0.0], 0, 0, ""), (1, [-3e38, 1.0], 0, 0, ""), (2, [0.0, 2.0], 0, 0, "")])
    got = whitening.whiten(df, "embedding", [F.col("vec_id")]).collect()
    assert len(got) == 6 and all(math.isfinite(r["whitened"]) for r in got)


def test_triangle_in_several_aggregations(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.integers(df, "embedding")
    whole = whitening.fit(rows)
    monkeypatch.setattr(whitening, "PAIRS", 500)
    parts = whitening.fit(rows)
    assert np.array_equal(whole.values, parts.values) and (whole.n, whole.rest) == (parts.n, parts.rest)
