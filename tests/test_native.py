import struct

import pytest
from pyspark.sql import functions as F

from pagemill.functions import rules, urls


def one(spark, expression, **columns):
    kinds = {str: "string", int: "long", bytes: "binary", list: "array<string>", type(None): "string"}
    row = spark.createDataFrame([tuple(columns.values()) or (0,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()) or "x long")
    return row.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://H.com/A/b/?utm_source=x&B=2&a=1&c=", "h.com/a/b?b=2&a=1&c="),
        ("http://h.com:8080/", "h.com:8080"),
        ("http://h.com/a?t=1", "h.com/a"),
        ("http://h.com/a b?q=x%20y+z", "h.com/a b?q=x+y+z"),
        ("", ""),
    ],
)
def test_key_query(spark, url, key):
    assert one(spark, urls.key_query(F.col("u")), u=url) == key


def test_url_rules(spark):
    assert one(spark, urls.normalized(F.col("u")), u="HTTP://H.com:80/a//#f") == "http://h.com/a"
    assert one(spark, urls.normalized(F.col("u")), u="https://h.com:8080") == "https://h.com:8080/"
    assert one(spark, urls.valid_page(F.col("u")), u="http://h.com/#top") is False
    assert one(spark, urls.valid_page(F.col("u")), u="http://h.com/#/page/about/us/long") is True
    assert one(spark, urls.valid_page(F.col("u")), u="http://h.com/search?q=1") is False
    assert one(spark, urls.is_detail(F.col("u"), F.lit("x")), u="http://h.com/news?a=show&catid=3&id=9") is True
    assert one(spark, urls.is_detail(F.col("u"), F.lit("x")), u="http://h.com/page/3") is False
    assert one(spark, urls.is_detail(F.col("u"), F.lit("Read more")), u="http://h.com/x") is False
    assert one(spark, urls.same_site(F.lit("www.a.b"), F.lit("x.a.b"))) is True
    assert urls.join("http://h.com/a/b", "../c") == "http://h.com/c" and urls.join("http://h.com", "http://[bad") == ""


def test_text_rules(spark):
    assert one(spark, rules.blocked(F.col("h")), h="x" * 100 + " Just a Moment") is True
    assert one(spark, rules.blocked(F.col("h")), h="x" * 2000 + " just a moment") is False
    assert one(spark, rules.blocked(F.col("h")), h=None) is False
    assert one(spark, rules.looks_like_404(F.col("h")), h="<title>404 Not Found</title>") is True
    assert one(spark, rules.datetime_text(F.col("s")), s="2024年3月5日 1:02") == "2024-03-05 01:02:00"
    assert one(spark, rules.datetime_text(F.col("s")), s="soon") == "soon"
    assert one(spark, rules.publish_time(F.col("s")), s="on 2024/3/5 we") == "2024/3/5"
    assert one(spark, rules.safe_name(F.col("s")), s=' a/b:c  d ') == "a_b_c d"
    assert one(spark, rules.safe_name(F.col("s")), s=None) == "未命名"
    assert one(spark, rules.requeue(F.col("p")), p=["News", "Today"]) is True
    assert one(spark, rules.error_message(F.col("s")), s="HTTP 503") == "高级反爬爬不了"
    assert one(spark, rules.clean_label(F.col("s")), s=" > a  b » ") == "a b"
    assert one(spark, rules.body_hash(F.col("s")), s=" \n") == ""


def test_image_rules(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 33)
    assert one(spark, rules.png_size(F.col("b")), b=png) == (30, 33)
    assert one(spark, rules.png_size(F.col("b")), b=b"GIF") is None
    assert one(spark, rules.squarish(F.lit(30), F.lit(33))) is True
    assert one(spark, rules.data_uri(F.col("b"), F.lit("image/png")), b=b"x" * 100).count("\n") == 0
    assert one(spark, rules.looks_like_html(F.col("b")), b=b"  <HTML>") is True
    assert one(spark, rules.embeds(F.col("s"), F.lit("x")), s="/a/logo.png") is False
    assert one(spark, rules.mime(F.lit("image/png; q"), F.col("s")), s="a.jpg") == "image/png"
    assert one(spark, rules.meta_refresh(F.col("s")), s='<meta content="0; URL=/x.html">') == "/x.html"


def test_lists_and_gates(spark):
    flag = rules.list_page(F.lit(200), F.lit(20), F.lit("Archive"), F.lit(True), F.lit("共 3 页"))
    got = one(spark, flag)
    assert got["is_list"] and got["confidence"] == 1.0
    assert one(spark, rules.pre_check(F.lit("http://a.gov/"), F.lit(200), F.lit("x"), F.lit(9), F.lit("t")))["pass"] is False
    assert one(spark, rules.pre_check(F.lit("http://a.com/"), F.lit(200), F.lit('<div id="app"></div><script src="a.js">'), F.lit(0), F.lit("")))["pass"] is True
