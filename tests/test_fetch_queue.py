"""Fetch queues: the pace of calls, restarts, retries after a back-off, and the crawl's budget."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.operators import fetching, links
from pagemill.sources import fetch_queue
from pagemill.streaming.state import drain


def urls(spark, n, hosts=3):
    """Two thirds of all URLs are of one host."""
    rows = [(f"http://h{0 if i % 3 else i // 3 % hosts}/p{i}", i) for i in range(n)] + [(None, 0), ("no host", 1)]
    return spark.createDataFrame(rows, "url string, pos long")


def answering():
    def ok(url):
        return f"<p>{url}", 200

    return ok  # a function of a function, as workers cannot import this module


ok = answering()


def gaps(log):
    by = defaultdict(list)
    for r in log.collect():
        by[r["host"]].append(r["started"])
    return [b - a for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:])]


def test_plan_keeps_the_interval(spark):
    rows = fetch_queue.plan(urls(spark, 60), interval=2.0, round_seconds=10.0, lanes=4).collect()
    assert len(rows) == 61 and {r["host"] for r in rows} == {"h0", "h1", "h2", ""}
    by = defaultdict(list)
    for r in rows:
        by[r["host"]].append(r)
        assert r["round"] == int(r["at"] // 10)
    for v in by.values():
        assert sorted(r["at"] for r in v) == [2.0 * i for i in range(len(v))] and len({r["lane"] for r in v}) == 1
    later = fetch_queue.plan(urls(spark, 3).withColumn("not_before", F.lit(25.0)).withColumn("attempt", F.lit(2)), 2.0, 10.0).collect()
    assert {(r["at"], r["round"], r["attempt"]) for r in later} == {(25.0, 2, 2)}


def test_calls_keep_the_pace_whatever_is_late():
    rows = [(0.0, f"h{i % 2}", f"u{i}", 1, 0) for i in range(12)]
    got = list(fetch_queue.paced(iter(rows), ok, time.time() - 100, 0.05, 4))
    assert sorted(r[0] for r in got) == sorted(r[2] for r in rows)
    for h in ("h0", "h1"):
        at = sorted(r[7] for r in got if r[1] == h)
        assert all(b - a >= 0.0499 for a, b in zip(at, at[1:]))
    slow = list(fetch_queue.paced(iter([(0.0, "h", "bad", 1, 0), (0.0, "h", "u", 1, 0)]), lambda u: 1 / 0 if u == "bad" else ok(u), time.time(), 0.01, 1, ahead=1))
    assert {(r[0], r[4], r[6] is None) for r in slow} == {("bad", None, False), ("u", 200, True)}
    assert list(fetch_queue.paced(iter([]), ok, 0.0, 1.0, 2)) == []


def test_a_restart_neither_skips_nor_repeats(spark, tmp_path):
    folder = f"file://{tmp_path}/q"
    rounds = fetch_queue.write_queue(fetch_queue.plan(urls(spark, 60), 0.3, 6.0, 4), folder, 0.3, 6.0)
    assert rounds >= 2
    spark.dataSource.register(fetch_queue.queue_source("restart_queue", ok, 4))
    start, seen = time.time(), []
    while not seen or not fetch_queue._drained(f"{folder}/stream", rounds):
        stream = spark.readStream.format("restart_queue").option("folder", folder).option("start", str(start)).load()
        out = drain(stream, f"{folder}/stream")  # a new query each time, from the checkpoint
        seen.append(out.count())
    got = [r["url"] for r in out.collect()]
    assert len(seen) >= 2 and seen[0] < 61 and len(got) == 61 and len(set(got)) == 61
    assert min(gaps(out)) >= 0.299


def test_failed_attempts_are_repeated_after_a_back_off(spark, tmp_path):
    def fetch(url):
        n = int(url.rsplit("p", 1)[1]) if "/p" in url else -1
        if n % 4 == 1:
            raise TimeoutError("timed out")
        return (None, 404) if n % 4 == 2 else (url, 200)

    log = fetch_queue.fetch_all(spark, urls(spark, 16), fetch, f"file://{tmp_path}/all", 0.01, 5.0, 4, backoff=0.5)
    by = defaultdict(list)
    for r in log.collect():
        by[r["url"]].append(r)
    assert len(by) == 17
    for url, v in by.items():
        v.sort(key=lambda r: r["attempt"])
        failing = "/p" in url and int(url.rsplit("p", 1)[1]) % 4 == 1
        assert [r["attempt"] for r in v] == ([1, 2, 3] if failing else [1])
        assert all(b["started"] - a["started"] >= 0.5 * 2**i for i, (a, b) in enumerate(zip(v, v[1:])))
    again = fetch_queue.fetch_all(spark, urls(spark, 16), fetch, f"file://{tmp_path}/all", 0.01, 5.0, 4, backoff=0.5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, log.collect()))  # no call is made twice
    outcome = {r["url"]: r["outcome"] for r in fetching.outcomes(log.withColumn("seq", F.col("attempt"))).collect()}
    assert sorted(outcome.values()).count("exhausted") == 4 and sorted(outcome.values()).count("fatal") == 4
    assert fetch_queue.fetch_all(spark, urls(spark, 0).where("url is null"), fetch, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("limits", [{}, {"per_page": 2}, {"per_site": 5}, {"queue": 7}, {"per_page": 3, "per_site": 9, "queue": 20}])
def test_budgeted_crawl_takes_exactly_the_first_pages(spark, limits):
    import random

    rng = random.Random(3)
    nodes = [(i, f"s{i % 7}") for i in range(300)]
    edges = sorted({(s, p): (s, p, d) for s, p, d in ((rng.randrange(300) if rng.random() < 0.6 else 0, rng.randrange(5000), rng.randrange(330)) for _ in range(1500))}.values())
    seen, queue, reached = set(), [], []
    per_page, per_site, most = limits.get("per_page", 10**9), limits.get("per_site", 10**9), limits.get("queue", 10**9)
    level, found = 0, [3, 0, 5]
    while found and len(reached) < 90 and level <= 4:
        took = []
        for n in found:
            site = f"s{n % 7}"
            if sum(r[1] == site for r in reached + took) < per_site:
                took.append((n, site, level))
        took = took[: min(most, 90 - len(reached))]
        reached += took
        seen = {r[0] for r in reached}
        found = []
        for n, _, _ in took:
            for _, _, d in sorted(((p, s, d) for s, p, d in edges if s == n), key=lambda e: e[0])[:per_page]:
                if d < 300 and d not in seen and d not in found:
                    found.append(d)
        level += 1
    got = links.budgeted(spark.createDataFrame([(3, 0), (0, 1), (5, 2)], "node long, seq long"), spark.createDataFrame(edges, "src long, pos long, dst long"), spark.createDataFrame(nodes, "node long, site string"), 90, **limits)
    assert [(r["node"], r["site"], r["level"]) for r in got.orderBy("number").collect()] == reached
    assert [r["number"] for r in got.orderBy("number").collect()] == list(range(1, len(reached) + 1))


def test_budgeted_crawl_makes_edges_of_reached_nodes_only(spark):
    rows = [(s, p, (7 * s + p) % 60) for s in range(60) for p in range(4)]
    edges = spark.createDataFrame(rows, "src long, pos long, dst long")
    nodes = spark.createDataFrame([(i, f"s{i % 3}") for i in range(60)], "node long, site string")
    seeds = spark.createDataFrame([(1, 0), (2, 1)], "node long, seq long")
    asked = []

    def leads(some):
        asked.append({r["node"] for r in some.collect()})
        return edges.join(some, edges["src"] == some["node"], "left_semi")

    want = sorted(map(tuple, links.budgeted(seeds, edges, nodes, 15, 3, 2).collect()))
    got = sorted(map(tuple, links.budgeted(seeds, leads, nodes, 15, 3, 2).collect()))
    assert got == want and len(got) == 15
    levels = [{r[0] for r in got if r[2] == level} for level in range(4)]
    assert asked == levels[: len(asked)]
