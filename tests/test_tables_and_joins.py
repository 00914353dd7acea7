"""The merged table, interval sweeps, dictionary joins, sitemaps and table functions."""

import gzip
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import tables
from pagemill.operators import cache, dictionary, intervals, store
from pagemill.sources import sitemaps

CACHE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "base_url", "status", "title", "html")])


def writes(spark, urls, seq, size=10, status="success"):
    """Pages of text that does not compress."""
    rng = random.Random(seq)
    rows = [(u, "b", status, f"t{seq}", "".join(map(chr, rng.choices(range(33, 126), k=size))) if status == "success" else None, seq) for u in urls]
    return spark.createDataFrame(rows, T.StructType([*CACHE.fields, T.StructField("seq", T.LongType())]))


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    kept = store.KeyedTable(spark, f"file://{tmp_path}/t", CACHE, "url", cache.fold, 16)
    assert kept.read().count() == 0 and kept.merge(writes(spark, [], 0)) == {"version": 0, "touched": 0, "bytes": 0}
    all_urls = [f"u{i}" for i in range(800)] + [None]
    base = kept.merge(writes(spark, all_urls, 1, 2000))
    assert base["version"] == 1 and base["touched"] == 16 and kept.read().count() == 801
    one = kept.merge(writes(spark, ["u5"], 2, 2000))
    assert one["touched"] == 1 and one["bytes"] < base["bytes"] / 8
    kept.merge(writes(spark, ["u5", "new"], 3, status="failed"))
    rows = {r["url"]: (r["status"], r["title"]) for r in kept.read().collect()}
    assert len(rows) == 802 and rows["u5"] == ("success", "t2") and rows["new"] == ("failed", "t3") and rows["u6"] == ("success", "t1")
    assert kept.read(1).where("url = 'u5'").first()["title"] == "t1"  # an old version
    assert kept.vacuum() > 0 and kept.versions() == [3] and kept.read().count() == 802


def test_of_two_merges_at_once_the_later_is_refused(spark, tmp_path, monkeypatch):
    kept = store.KeyedTable(spark, f"file://{tmp_path}/t", CACHE, "url", cache.fold, 4)
    kept.merge(writes(spark, ["a", "b"], 1))
    before = kept.manifest()
    kept.merge(writes(spark, ["a"], 2))
    monkeypatch.setattr(kept, "manifest", lambda version=None: before)  # as one that had begun before
    with pytest.raises(store.Conflict):
        kept.merge(writes(spark, ["a"], 3))
    monkeypatch.undo()
    assert kept.read().where("url = 'a'").first()["title"] == "t2" and kept.versions() == [1, 2]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2


@pytest.mark.parametrize("least", [20, 10**9])
def test_intervals(spark, least):
    rng = random.Random(4)
    rows = [("hot" if i % 4 else f"k{i % 12}", i, rng.randint(0, 300), None if i % 50 == 7 else rng.randint(0, 60)) for i in range(900)]
    rows = [(k, i, None if i % 70 == 3 else a, None if n is None else a + n) for k, i, a, n in rows]

    def held(k, i, a, b):
        other = [(c, d, j) for kk, j, c, d in rows if kk == k and j != i and c is not None and d is not None]
        return a is not None and b is not None and any(c <= a and d >= b and ((c, d) != (a, b) or j < i) for c, d, j in other)

    df = spark.createDataFrame(rows, "k string, i long, a long, b long")
    got = intervals.swept(df, ["k"], "a", "b", ["i"], least)
    assert {r["i"]: r["contained"] for r in got.collect()} == {r[1]: held(*r) for r in rows}
    assert intervals.outermost(df, ["k"], "a", "b", ["i"], least).count() == sum(not held(*r) for r in rows)


def test_dictionary(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "zz"]
    patterns = [("".join(rng.choice("abé ") for _ in range(rng.randint(1, 6))), rng.randint(0, 30)) for _ in range(120)] + [(None, 0), ("", 0)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i long, t string, match_ string").repartition(4)
    known = spark.createDataFrame(patterns, "p string, o long")

    def want(text):
        first = {}
        for p, o in patterns:
            if p:
                first[p] = min(o, first.get(p, o))
        return min(((o, p.encode(), p) for p, o in first.items() if text and p in text), default=(None, None, None))[2]

    for part in (dictionary.PART, 60):
        got = dictionary.first_match(df, F.col("t"), known, "p", "o", part)
        assert {r["i"]: r["match"] for r in got.collect()} == {i: want(t) for i, t in enumerate(texts)}
    assert dictionary.first_match(df, F.col("t"), known.limit(0), "p", "o").where("match is not null").count() == 0


def test_many_patterns(spark):
    known = spark.range(100_000).select(F.concat(F.lit("key"), F.col("id").cast("string"), F.lit(";")).alias("p"), (-F.col("id")).alias("o"))
    df = spark.createDataFrame([(f"x key{i}; key{i + 1}; y",) for i in range(0, 3000, 7)], "t string")
    got = dictionary.first_match(df, F.col("t"), known, "p", "o")
    assert all(r["match"] == r["t"].split()[2] for r in got.collect())


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i"'
    files = [
        ("http://h/index.xml", f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc>http://h/a.xml.gz</loc></sitemap><sitemap><loc> http://h/b.txt </loc></sitemap><sitemap><loc>http://h/gone.xml</loc></sitemap><sitemap><loc>http://h/deep.xml</loc></sitemap></sitemapindex>".encode()),
        ("http://h/a.xml.gz", gzip.compress(f"<urlset {ns}><url><loc>http://h/1?x=1&amp;y=2</loc><lastmod>2024-05-06</lastmod><priority>0.5</priority><image:image><image:loc>http://h/i.png</image:loc></image:image></url><url><loc></loc></url></urlset>".encode())),
        ("http://h/b.txt", b"http://h/2\r\nno link\n http://h/3 \n"),
        ("http://h/deep.xml", b"<sitemapindex><sitemap><loc>http://h/index.xml</loc></sitemap><sitemap><loc>http://h/leaf.xml</loc></sitemap></sitemapindex>"),
        ("http://h/leaf.xml", b"<urlset><url><loc>http://h/4</loc></url></urlset>"),
        ("http://h/broken.gz", b"\x1f\x8bnothing"),
        ("http://h/null", None),
    ]
    table = spark.createDataFrame(files, "url string, content binary")
    roots = spark.createDataFrame([("http://h/index.xml",), ("http://h/broken.gz",), ("http://h/null",), (None,), ("http://h/absent",)], "url string")
    got = {(r["sitemap"][9:], r["level"], r["kind"], r["url"], r["lastmod"]) for r in sitemaps.expanded(table, roots).collect()}
    assert got == {
        ("index.xml", 0, "sitemap", "http://h/a.xml.gz", None), ("index.xml", 0, "sitemap", "http://h/b.txt", None), ("index.xml", 0, "missing", "http://h/gone.xml", None), ("index.xml", 0, "sitemap", "http://h/deep.xml", None),
        ("a.xml.gz", 1, "page", "http://h/1?x=1&y=2", "2024-05-06"), ("b.txt", 1, "page", "http://h/2", None), ("b.txt", 1, "page", "http://h/3", None),
        ("deep.xml", 1, "sitemap", "http://h/index.xml", None), ("deep.xml", 1, "sitemap", "http://h/leaf.xml", None), ("leaf.xml", 2, "page", "http://h/4", None),
    }
    assert sitemaps.expanded(table, roots.limit(0)).count() == 0


def test_table_functions(spark):
    names = tables.register(spark)
    assert "page_links" in names
    page = "<html><head><title>T</title></head><body><h1>H</h1><a href='/a'>A</a><a href='/b'>B</a><img src='/i.png'></body></html>"
    spark.createDataFrame([(1, page, "http://h/"), (2, None, None)], "id long, html string, url string").createOrReplaceTempView("given_pages")
    got = spark.sql("SELECT id, pos, l.url, text FROM given_pages g, LATERAL page_links(g.html, g.url) l ORDER BY pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "http://h/a", "A"), (1, 1, "http://h/b", "B")]
    record = {r["id"]: r for r in spark.sql("SELECT id, r.* FROM given_pages g, LATERAL page_record(g.html, g.url) r").collect()}
    assert (record[1]["title"], record[1]["heading"]) == ("T", "H") and len(record) == 2
    for name in names:
        spark.sql(f"SELECT id, r.* FROM given_pages g, LATERAL {name}(g.html, g.url) r").collect()
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM page_links(1, 'x')").collect()
