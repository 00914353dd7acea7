from pyspark.sql import functions as F

from pagemill.operators import validate
from pagemill.plans import crawl, site_queries
from pagemill.sources.readers import pages

LONG = "Some words about this page that make it long enough to be stored as content of its own. " * 3


def page(body, links=""):
    return f"<html><head><title>T</title></head><body>{links}<article><h1>Head {body}</h1><p>{LONG}{body}</p></article></body></html>"


def test_site(spark):
    rows = [
        (1, "http://h/", page("home", '<a href="/a">A</a><a href="/b?utm_source=x">B</a><a href="/err">E</a><a href="http://other/">O</a>')),
        (2, "http://h/a", page("a", '<a href="/c">C</a>')),
        (3, "http://h/b", page("a")),  # the same content as a: title and body
        (4, "http://h/c", page("c")),
        (5, "http://h/err", "<title>404 Not Found</title><h1>Not Found</h1>" + " " * 100),
        (6, "http://h/alone", page("alone")),
        (7, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = crawl.site(pages, pages.where("page_id = 1").select("url"))
    got = {r["page_id"]: (r["level"], r["status"]) for r in out.collect()}
    assert got == {1: (0, "saved"), 2: (1, "saved"), 3: (1, "duplicate"), 4: (2, "saved"), 5: (1, "skipped")}
    assert out.where("page_id = 2").first()["file_path"] == "a/Head a.html"
    assert crawl.outcome(out).first()["passed"] is True
    assert crawl.site(pages.limit(0), pages.select("url").limit(0)).count() == 0


def test_site_without_seeds_reports_every_row(spark):
    rows = [
        (1, "http://h/", page("home", '<a href="/a">A</a>')),
        (2, "http://h/a", page("a")),
        (3, "http://h/x", page("x", '<a href="/y">Y</a>')),  # two that only lead to one another
        (4, "http://h/y", page("y", '<a href="/x">X</a>')),
        (5, "http://g/top", page("top", '<a href="/under">U</a>')),  # no home page
        (6, "http://g/under", page("under")),
        (7, "http://h/a", page("again")),
        (8, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = crawl.site(pages).collect()
    assert len(out) == 8
    got = {r["page_id"]: (r["level"], r["status"]) for r in out}
    saved = {1: (0, "saved"), 2: (1, "saved"), 3: (0, "saved"), 4: (0, "saved"), 5: (0, "saved"), 6: (1, "saved")}
    assert got == saved | {7: (None, "duplicate"), 8: (None, "skipped")}


def test_site_queries_cover_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    table = pages(spark, sf_dir)
    crawled = site_queries.site_crawl(spark, sf_dir)
    assert sorted(r["page_id"] for r in crawled.select("page_id").collect()) == sorted(r["page_id"] for r in table.select("page_id").collect())
    told = site_queries.site_outcome(spark, sf_dir).first()
    assert told["saved"] + told["failed"] + told["skipped"] == table.count()


def test_validation(spark):
    rows = [("http://h", " t ", None, None, "x", 0, ["a"]), ("h", "", None, ["c"], None, -1, None), (None, None, None, None, None, None, ["1", "2", "3", "4", "5"])]
    df = spark.createDataFrame(rows, validate.ARTICLE)
    good, bad = validate.split(df)
    assert good.first()["title"] == "t" and good.first()["nav_levels"] == ["a", "", "", ""]
    assert sorted(r["error_reason"] for r in bad.collect()) == ["url; title is empty; images_count", "url; title is empty; nav_levels"]
    told = validate.to_json(good)
    fenced = told.select(F.concat(F.lit("```json\n["), "answer", F.lit("]\n```")).alias("articles_json"))
    assert validate.from_json(fenced).first()["title"] == "t"
    assert validate.from_json(spark.createDataFrame([("broken",), (None,)], "articles_json string")).count() == 0
