import pytest
from compare import duck, spark_rows

from pagemill.plans import log_queries, page_queries, registry, scale_queries, site_queries, state_queries, url_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck(SF, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["page_titles", "visible_text", "list_page_rules"])
def test_references_that_are_cut_off_stay_as_in_sql(spark, tmp_path, name):
    page = lambda title: f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>a &lt; b &copy 2024 &middot; c&amp;lt;</p></body></html>"
    rows = [(1, "http://h/1", page("Cut&amp;&amp")), (2, "http://h/2", page("&quot;Q&quot; &am")), (3, "http://h/3", page("x & y &quot"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert spark_rows(registry.QUERIES[name](spark, str(tmp_path))) == duck(str(tmp_path), registry.ORACLE_SQL[name])
