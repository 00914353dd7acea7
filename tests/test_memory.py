import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import pages
from pagemill.operators import images
from pagemill.plans import crawl, site_queries


def captured(monkeypatch, df, method):
    """What ``df``'s class is given to run over batches."""
    got = []
    monkeypatch.setattr(type(df), method, lambda self, each, schema: got.append(each) or self)
    return got


@pytest.mark.parametrize("names", [["clean"], ["text", "links", "structured", "images"], ["heading", "clean", "publish_text"]])
def test_parsed_pages_leave_in_small_parts(spark, monkeypatch, names):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    each = captured(monkeypatch, df, "mapInArrow")
    pages.parse_pages(df, [F.col("page_id")], names, F.col("url"), F.col("html"))
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "__url": ["http://h/"] * 1000, "__html": [None, *(f"<p>Page {i}</p>" for i in range(1, 1000))]})
    taken = []
    parts = list(each[0](taken.append(1) or b for b in [batch, batch.slice(0, 3), batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= pages.TOGETHER
    assert [i for p in parts for i in p.column("page_id").to_pylist()] == [*range(1000), 0, 1, 2]


@pytest.mark.parametrize("names", [["clean"], ["heading", "text", "clean"], ["links", "text", "structured", "images", "paging"]])
def test_long_pages_leave_in_parts_of_few_bytes(spark, monkeypatch, names):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    each = captured(monkeypatch, df, "mapInArrow")
    pages.parse_pages(df, [F.col("page_id")], names, F.col("url"), F.col("html"))
    html = ["<p>short</p>", f"<p>{'long ' * 60_000}</p>", None, f"<p>{'one ' * 600_000}</p>"] * 4
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(16)), "__url": ["http://h/"] * 16, "__html": html})
    parts = list(each[0](iter([batch])))
    assert [i for p in parts for i in p.column("page_id").to_pylist()] == list(range(16))
    assert all(sum(len(html[i] or "") for i in p.column("page_id").to_pylist()) <= 1 << 20 for p in parts if p.num_rows > 1)


def test_pages_with_images_leave_in_small_parts(spark, monkeypatch):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    each = captured(monkeypatch, df, "mapInArrow")
    blobs = spark.createDataFrame([], "url string, content binary, content_type string, status int")
    images.embedded(df, spark.createDataFrame([], "page_id long, images array<struct<url: string, alt: string>>"), blobs)
    given = [None, [{"url": "http://h/a.png", "data_uri": "data:x"}, {"url": "http://h/b.png", "data_uri": None}]]
    html = [None, "<p><img src='a.png'><figure><img src='b.png'></figure></p>"]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": ["http://h/"] * 1000, "html": html * 500, "given": given * 500})
    parts = list(each[0](iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= pages.TOGETHER
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(1000))
    assert rows[998] == {"page_id": 998, "html": "", "ok": 0, "failed": 0}
    assert rows[999] == {"page_id": 999, "html": '<p><img src="data:x"></p>', "ok": 1, "failed": 1}


def test_a_site_is_parsed_in_small_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(crawl, "parse_pages", lambda *given: parsed.append(given) or pages.parse_pages(*given))
    parsed, rows = [], [(i, f"http://h/{i}", f"<p>Page {i}</p>" * 20) for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert site_queries.site_outcome(spark, str(tmp_path)).count() == 1 and len(parsed) == 1
    given = parsed[0]
    each = captured(monkeypatch, given[0], "mapInArrow")
    pages.parse_pages(*given)
    batch = pa.RecordBatch.from_pydict({"key": ["k"] * 200, "url": ["u"] * 200, "page_id": list(range(200)), "early": pa.array([None] * 200, pa.string()), "__url": ["http://h/"] * 200, "__html": ["<p>x</p>"] * 200})
    parts = list(each[0](iter([batch])))
    assert max(p.num_rows for p in parts) <= 64 and [i for p in parts for i in p.column("page_id").to_pylist()] == list(range(200))


def test_what_is_held_does_not_grow_with_the_batches(spark, monkeypatch):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    each = captured(monkeypatch, df, "mapInArrow")
    pages.parse_pages(df, [F.col("page_id")], ["clean"], F.col("url"), F.col("html"))
    row = ["<p>" + "word " * 1000 + "</p>"]
    batches = (pa.RecordBatch.from_pydict({"page_id": list(range(200)), "__url": ["http://h/"] * 200, "__html": row * 200}) for _ in range(12))
    before, held = pa.total_allocated_bytes(), []
    for part in each[0](batches):
        held.append(pa.total_allocated_bytes() - before)
    assert len(held) == 12 * 4 and max(held[8:]) < 6 << 20  # a batch has a good 1 MB, all have 12 MB
