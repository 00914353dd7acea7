"""Keyed state with timers: any order and any cut into batches end in the same table."""

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.streaming import keyed
from pagemill.streaming.state import drain

START = datetime(2024, 1, 1)
ROW = "key long, ts timestamp, seq long, parent string, path array<string>, done boolean, failed boolean"


def write(folder, number, rows):
    """A file of rows (key, second, seq, parent, path, done, failed), younger than those before."""
    os.makedirs(folder, exist_ok=True)
    cols = list(zip(*rows))
    kinds = [pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
    data = [pa.array([START + timedelta(seconds=v) for v in c] if i == 1 else c, k) for i, (c, k) in enumerate(zip(cols, kinds))]
    path = os.path.join(folder, f"{number:03d}.parquet")
    pq.write_table(pa.table(data, names=["key", "ts", "seq", "parent", "path", "done", "failed"]), path)
    os.utime(path, (1_700_000_000 + number * 10,) * 2)


def stream(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(folder))


def some(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        path = None if rng.random() < 0.2 else [rng.choice("xyz") for _ in range(rng.randint(0, 4))]
        out.append((rng.randint(1, 5), rng.randint(0, 400), i, rng.choice(["p", "q", None, "r"]), path, rng.random() < 0.02, rng.random() < 0.75))
    return out


def best(rows):
    out = {}
    for key in {r[0] for r in rows}:
        ends = [r[1] for r in rows if r[0] == key and r[5]]
        last = {}
        for r in sorted((r for r in rows if r[0] == key and not r[5]), key=lambda r: (r[1], r[2])):
            if not ends or r[1] <= min(ends):
                last[r[3] or ""] = r[4]
        offers = sorted((-len(p), p, who) for who, p in last.items() if p)
        out[key] = (*(offers[0][1:] if offers else (None, None)), bool(ends))
    return out


def failures(rows):
    out = {}
    for key in {r[0] for r in rows}:
        n = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            n = n + 1 if r[6] else 0
        out[key] = n
    return out


@pytest.mark.parametrize("order", ["forth", "back", "mixed"])
def test_orders_end_in_one_table(spark, tmp_path, order):
    rows = some(7)
    given = {"forth": sorted(rows, key=lambda r: r[1]), "back": sorted(rows, key=lambda r: -r[1]), "mixed": random.Random(1).sample(rows, len(rows))}[order]
    for k in range(3):
        write(str(tmp_path / "in"), k, given[k::3] if order == "mixed" else given[80 * k : 80 * (k + 1)])
    got = drain(keyed.paths(stream(spark, tmp_path / "in"), "key", delay="1 day"), str(tmp_path / "p"), "update", ["key"])
    assert {r["key"]: (r["path"], r["parent"], r["final"]) for r in got.collect()} == best(rows)
    counted = keyed.retries(stream(spark, tmp_path / "in"), "key", "seq", F.col("failed"), delay="1 day").where("kind = 'counted'")
    got = drain(counted, str(tmp_path / "r"), "update", ["key"])
    assert {r["key"]: (r["failures"], r["exhausted"]) for r in got.collect()} == {k: (n, n >= 3) for k, n in failures(rows).items()}


def test_settled_failures_are_counted_and_late_rows_ignored(spark, tmp_path):
    bad = lambda second, seq: (1, second, seq, None, None, False, True)
    good = lambda second, seq: (1, second, seq, None, None, False, False)
    write(str(tmp_path / "in"), 0, [good(0, 0), bad(10, 1), bad(20, 2)])
    write(str(tmp_path / "in"), 1, [(2, 1000, 3, None, None, False, True)])  # the watermark gets past the first failures
    write(str(tmp_path / "in"), 2, [bad(2000, 4)])
    write(str(tmp_path / "in"), 3, [bad(3000, 5), good(15, 6)])  # a success that comes too late
    write(str(tmp_path / "in"), 4, [good(4000, 7), bad(4001, 8)])
    out = drain(keyed.retries(stream(spark, tmp_path / "in"), "key", "seq", F.col("failed"), 3, 60.0, delay="10 seconds"), str(tmp_path / "c"), "update")
    assert sorted((r["key"], r["failures"]) for r in out.where("kind = 'counted'").collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    due = {(r["key"], r["failures"], r["due"].replace(tzinfo=None)) for r in out.where("kind = 'due'").collect()}
    assert due == {(1, 2, START + timedelta(seconds=20 + 120)), (2, 1, START + timedelta(seconds=1060))}


def test_a_page_that_has_ended_is_closed(spark, tmp_path):
    offer = lambda second, seq, who, path: (1, second, seq, who, path, False, False)
    write(str(tmp_path / "in"), 0, [offer(10, 0, "p", ["a", "b"]), offer(12, 1, "q", ["a"]), offer(14, 2, "p", None)])
    write(str(tmp_path / "in"), 1, [(1, 20, 3, None, None, True, False), offer(30, 4, "q", ["too", "late", "by", "time"])])
    write(str(tmp_path / "in"), 2, [(2, 500, 5, "p", ["x"], False, False)])  # the watermark passes the end
    write(str(tmp_path / "in"), 3, [offer(600, 6, "q", ["c", "c", "c"]), (1, 600, 7, None, None, True, False)])
    out = drain(keyed.paths(stream(spark, tmp_path / "in"), "key", delay="10 seconds"), str(tmp_path / "c"), "update", ["key"])
    assert {r["key"]: (r["path"], r["parent"], r["final"]) for r in out.collect()} == {1: (["a"], "q", True), 2: (["x"], "p", False)}


def test_offers_that_cannot_count_are_dropped():
    offers = [[5, 0, ["a"]], [9, 1, ["b"]], [20, 2, None], [30, 3, ["c"]]]
    assert keyed._Paths._open(offers, 10, None) == offers[1:]
    assert keyed._Paths._open(offers, 10, 25) == offers[1:3]
    assert keyed._Paths._open(offers, 0, None) == offers and keyed._Paths._open([], 10, None) == []
