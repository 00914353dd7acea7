"""Windows over large keys: equal to plain windows, and dealt over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import chunks


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    keys = ["hot"] * 3000 + [None] * 900 + [f"k{i % 40}" for i in range(400)]
    rows = [(k, i, rng.random() < (0.999 if i % 1000 < 600 else 0.5), rng.randint(0, 50)) for i, k in enumerate(rng.sample(keys, len(keys)))]
    return spark.createDataFrame(rows, "k string, at long, bad boolean, tie long").cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("least", [50, 10**9])
def test_numbers(log, least):
    want = log.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at")).cast("long"))
    assert rows_of(chunks.numbered(log, ["k"], ["at"], least=least), "at", "n") == rows_of(want, "at", "n")
    tied = log.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("tie", "at")).cast("long"))
    assert rows_of(chunks.numbered(log, ["k"], ["tie", "at"], least=least), "at", "n") == rows_of(tied, "at", "n")
    down = log.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("at"))).cast("long"))
    assert rows_of(chunks.numbered(log, ["k"], [F.desc("at")], place=-F.col("at"), least=least), "at", "n") == rows_of(down, "at", "n")


def plain_runs(rows):
    out, run = [], {}
    for k, at, bad, _ in sorted(rows, key=lambda r: r[1]):
        run[k] = run.get(k, 0) + 1 if bad else 0
        out.append((at, run[k]))
    return sorted(out)


@pytest.mark.parametrize("least", [50, 10**9])
def test_runs(log, least):
    want = plain_runs([tuple(r) for r in log.collect()])
    assert max(n for _, n in want) > 300  # runs go on over chunks
    assert rows_of(chunks.runs(log, ["k"], ["at"], F.col("bad"), least=least), "at", "run") == want
    bad = log.withColumn("bad", F.lit(True))
    assert rows_of(chunks.runs(bad, ["k"], ["at"], F.col("bad"), least=least), "at", "run") == plain_runs([tuple(r) for r in bad.collect()])


def test_first_rows(log):
    got = chunks.first(log, [], ["tie", "at"], 700, least=50)
    assert rows_of(got, "tie", "at") == sorted((r["tie"], r["at"]) for r in log.collect())[:700]
    assert chunks.first(log, ["k"], ["at"], 3, least=50).groupBy("k").count().where("count > 3").count() == 0
    assert chunks.first(log.limit(0), [], ["at"], 3).count() == 0


def test_large_keys_are_dealt(log):
    sizes = chunks.chunked(log, ["k"], F.col("at"), least=50).groupBy("k", "_chunk").count()
    hot = sizes.where("k = 'hot'")
    assert hot.agg(F.max("count")).first()[0] < 400 and hot.count() >= 8
    assert sizes.where("k like 'k%'").count() == 40
    text = chunks.numbered(log, ["k"], ["at"], least=50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "SinglePartition" not in text
