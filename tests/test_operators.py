from pyspark.sql import functions as F

from pagemill.operators import cache, categories, dedup, evaluate, links
from pagemill.sources import file_sink, readers, sinks
from pagemill.streaming import state


def test_cache_precedence(spark):
    writes = spark.createDataFrame(
        [("a", "b", "success", "t1", "<p>", 1), ("a", None, "failed", "t2", None, 2), ("a", "c", "success", "t3", None, 3), ("x", "b", "failed", "t", None, 1), ("x", "b", "success", "u", None, 2), ("x", "b", "failed", "v", None, 3), ("y", "b", "visited_short", "w", "", 1)],
        "url string, base_url string, status string, title string, html string, seq long",
    )
    got = {r["url"]: (r["base_url"], r["status"], r["title"], r["html"]) for r in cache.fold(writes).collect()}
    assert got == {"a": ("c", "success", "t1", "<p>"), "x": ("b", "success", "u", None), "y": ("b", "visited_short", "w", None)}
    assert cache.without_site(cache.fold(writes), "b").count() == 1
    assert cache.upsert(cache.fold(writes), writes.limit(0)).count() == 3
    saved = spark.createDataFrame([("s", "u", '{"a": 1}', 1), ("s", "u", "broken", 2)], "session_id string, target_url string, state_json string, seq long")
    assert cache.sessions(saved).select(F.col("state").isNull()).first()[0] is True


def test_crawl_levels(spark):
    pages = spark.createDataFrame(
        [("h/a", "http://h/a", [("http://h/b", "B"), ("http://h/c", "C")]), ("h/b", "http://h/b", [("http://h/a", "A"), ("http://h/d", "D")]), ("h/c", "http://h/c", []), ("h/d", "http://h/d", [])],
        "key string, url string, links array<struct<url: string, text: string>>",
    )
    got = {r["key"]: r["level"] for r in links.crawl(pages.where("key = 'h/a'").select("key", "url"), pages, 3).collect()}
    assert got == {"h/a": 0, "h/b": 1, "h/c": 1, "h/d": 2}


def test_requeue(spark):
    rows = spark.createDataFrame([("k", ["News", "Today"]), ("k2", ["x"]), ("k3", ["News", "Old"])], "key string, nav_path array<string>")
    seen = rows.select("key")
    assert [r["key"] for r in links.requeued(rows, seen, seen.where("key = 'k3'")).collect()] == ["k"]


def test_categories(spark):
    pages = spark.createDataFrame([(1, "http://h/"), (2, "http://h/news/x"), (3, "http://h/newsletter"), (4, "http://h/news/today/1")], "page_id long, url string")
    nav = spark.createDataFrame([("News", "/news/", 0), ("Today", "/news/today", 1)], "name string, prefix string, ord int")
    assert [r["category"] for r in categories.by_navigation(pages, nav).orderBy("page_id").collect()] == ["首页", "News", "其他页面", "News"]
    assert categories.by_navigation(pages, nav, longest=True).where("page_id = 4").first()["category"] == "Today"
    row = spark.createDataFrame([(["a"], ["b", "a"])], "p array<string>, c array<string>")
    assert row.select(categories.merged_path(F.col("p"), F.col("c")).alias("m")).first()["m"] == ["b", "a"]


def test_paths_and_dedup(spark):
    rows = spark.createDataFrame([(1, "d", "n"), (2, "d", "n"), (3, "", "n")], "i int, d string, n string")
    assert [r["file_path"] for r in categories.file_paths(rows, F.col("d"), F.col("n"), ["i"]).orderBy("i").collect()] == ["d/n.html", "d/n_1.html", "n.html"]
    pages = spark.createDataFrame([(1, "<p>", "k1", "p1"), (2, "<p>", "k2", "p2"), (3, "<q>", "k1", "p3"), (4, "<r>", "k4", "p1")], "i int, html string, key string, path string")
    assert [r["i"] for r in dedup.thrice(pages, "html", "key", "path", ["i"]).collect()] == [1]


def test_golden(spark):
    cases = spark.createDataFrame(
        [("1", "A title", "2025-01-02", ["News"], 1, "a title", "2025-", ["News"], 1), ("2", "x", None, [], 0, "long title", None, None, None), ("3", "t", "", [], 0, "", "", ["News"], None)],
        "id string, title string, publish_time string, breadcrumb array<string>, images int, expected_title string, expected_publish_time string, expected_breadcrumb array<string>, expected_images int",
    )
    out = evaluate.golden(cases)
    assert [r["passed"] for r in out.orderBy("id").collect()] == [True, False, False]
    assert evaluate.accuracy(out).first()["failed"] == 2
    assert evaluate.accuracy(out.limit(0)).first()["accuracy"] == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# c\nhttp://a/\n\nhttp://a\nftp://b\nhttps://c\n")
    assert [r["url"] for r in readers.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["http://a/", "https://c"]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://a/?x=1&amp;y=2 </loc></url></urlset>")
    assert readers.sitemap(spark, str(tmp_path / "s.xml")).first()["url"] == "http://a/?x=1&y=2"
    (tmp_path / "g.json").write_text('{"test_cases": [{"id": "1", "url": "u", "expected_data": {"title": "t", "min_images": 2}}]}')
    assert readers.golden(spark, str(tmp_path / "g.json")).first()["expected_images"] == 2
    rows = spark.createDataFrame([("a/b.html", 'x "q"\nz', "t"), ("c.html", "y", None)], "file_path string, html string, title string")
    assert file_sink.write_files(rows, str(tmp_path / "out"), "job").count() == 2
    back = {r["title"]: (r["nav_path"], r["html"]) for r in readers.saved_pages(spark, str(tmp_path / "out")).collect()}
    assert back["b"] == (["a"], 'x "q"\nz') and back["c"][0] == []
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "csv"), rows.columns).collect()) == [("a/b.html", 'x "q"\nz', "t"), ("c.html", "y", "")]
    asked = []

    def fetch(url):
        asked.append(url)
        if url == "bad":
            raise OSError("no")
        return ("<p>", 200) if url == "ok" else (None, 404)

    spark.dataSource.register(readers.page_source("test_pages", ["ok", "bad", "gone"], fetch))
    got = {r["url"]: (r["status"], r["attempt"], r["fetch_method"]) for r in spark.read.format("test_pages").load().collect()}
    assert got == {"ok": (200, 1, "httpx"), "bad": (None, 3, "failed"), "gone": (404, 1, "failed")}


def test_database_rows(spark):
    rows = spark.createDataFrame([("u", None, "2024-01-02"), ("v", "t", "x"), ("u", None, "2024-01-02")], "url string, title string, riqi string")
    got = {r["url"]: (r["title"], r["riqi"]) for r in sinks.for_database(rows, spark.createDataFrame([("v",)], "url string")).collect()}
    assert list(got) == ["u"] and got["u"][0] == "无" and got["u"][1].year == 2024


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = state.drain(state.retry_state(state.events(spark, str(tmp_path / "in"), 10)), str(tmp_path / "c"), "update", ["user_id"])
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, state.retry_state(e).collect()))
