import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import content
from pagemill.functions.pages import extract_by_rules
from pagemill.functions.tree import Node, parse
from pagemill.operators import dedup, evaluate, fetching, images, models


def test_outcomes_of_a_fetch_log(spark):
    log = [("a", 1, 503), ("a", 2, None), ("a", 3, 200), ("b", 1, 404), ("b", 2, 200), ("c", 1, 429), ("c", 2, 500), ("c", 3, 500), ("c", 4, 200), ("d", 1, None), (None, 1, 200)]
    got = {r["url"]: (r["attempts"], r["outcome"], r["status"]) for r in fetching.outcomes(spark.createDataFrame(log, "url string, seq long, status int")).collect()}
    assert got == {"a": (3, "fetched", 200), "b": (1, "fatal", 404), "c": (3, "exhausted", 500), "d": (1, "pending", None), None: (1, "fetched", 200)}
    assert fetching.outcomes(spark.createDataFrame([], "url string, seq long, status int")).count() == 0
    kinds = spark.createDataFrame([(500, None), (404, None), (None, "ReadTimeout"), (None, "ValueError"), (None, None)], "status int, error string")
    assert [r[0] for r in kinds.select(fetching.retryable(F.col("status"), F.col("error"))).collect()] == [True, False, True, False, False]


def test_a_model_is_asked_once_a_row(spark):
    def client():
        seen = []

        def call(prompt):
            seen.append(prompt)
            if "fail" in prompt:
                raise ValueError("no")
            if "twice" in prompt and seen.count(prompt) == 1:
                raise TimeoutError("late")
            return prompt.upper(), len(prompt), 1

        return call

    df = spark.createDataFrame([(1, "x"), (2, "fail"), (3, "twice")], "id long, p string")
    got = {r["id"]: (r["answer"], r["prompt_tokens"], r["error"]) for r in models.ask(df, "p", client, ["id"]).collect()}
    assert got == {1: ("X", 1, None), 2: (None, 0, "ValueError: no"), 3: ("TWICE", 5, None)}


def test_decisions(spark):
    said = [None, "", "{", '{"action": "scrape"}', '[{"action": "scrape"}]', 'x {"action": "DONE"} y', '```json\n{"action": "begin", "priority_url": "u"}\n```', "深入"]
    got = [r["d"]["action"] for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(models.decision(F.col("t")).alias("d")).collect()]
    assert got == ["finish", "finish", "finish", "scrape", "scrape", "finish", "scrape", "scrape"]


def test_messages_get_placeholders(spark):
    kind = "conv_id long, pos long, role string, content string, calls array<string>, result_of string"
    df = spark.createDataFrame([(1, 0, "ai", "", ["a", "b", ""], None), (1, 1, "tool", "r", [], "a"), (1, 2, "ai", "", ["c"], None), (2, 0, "tool", "r", [], "c"), (None, 0, "ai", "", ["d"], None)], kind)
    more = sorted((r["conv_id"] or -1, r["pos"], r["part"], r["result_of"]) for r in models.sanitised(df).where("part > 0").collect())
    assert more == [(-1, 0, 1, "d"), (1, 0, 2, "b"), (1, 2, 1, "c")]
    assert models.sanitised(df).count() == 8


def test_overriding_and_missing_rows(spark):
    fetched = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, html string")
    media = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, html string")
    assert sorted(map(tuple, images.overridden(fetched, media).collect())) == [("a", "1", False), ("b", "3", True), ("c", "4", True)]
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "page_id long, url string")
    assert [tuple(r) for r in images.missing(rows, rows.where("url = 'x'")).collect()] == [(1, "y")]


def test_reports(spark):
    rows = spark.createDataFrame([(f"u{i}", "slow" if i % 2 else None) for i in range(30)] + [("u1", "slow"), ("u0", "")], "url string, reason string")
    got = evaluate.blocked_report(rows, "url", "reason", 3).collect()
    assert [(r["reason"], r["n"], r["urls"]) for r in got] == [("slow", 15, ["u1", "u11", "u13"])]
    log = spark.createDataFrame([("k", 1, "e"), ("k", 2, "ok"), ("k", 3, "e"), ("k", 4, "skip"), ("k", 5, "e"), (None, 1, "e"), ("o", 1, "ok")], "by string, at long, kind string")
    assert {r["by"]: r["trailing"] for r in evaluate.trailing_run(log, "by", "at", F.col("kind") == "e", F.col("kind") == "skip").collect()} == {"k": 2, None: 1, "o": 0}


def test_rows_without_content_do_not_meet(spark):
    rows = spark.createDataFrame([(i, "" if i < 50 else None if i < 60 else "h") for i in range(65)], "id long, h string")
    got = dedup.by_hash(rows, F.col("h"), ["id"])
    assert got.where("copy = 1").count() == 61 and got.where("id = 64").first()["copy"] == 5


def test_extraction_by_rules(spark):
    html = "<html><body><h1>Name</h1><div class='ad'>buy</div><article>" + "long text " * 8 + "<img src='/a.png'><p class=ad>x</p></article></body></html>"
    df = spark.createDataFrame([(1, "https://h.example/p", html), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract_by_rules(df, [(".ad", "remove"), ("article", "content"), ("h1", "title")]).collect()}
    assert got[1]["title"] == "Name" and got[1]["images"] == 1 and "buy" not in got[1]["html"] and "https://h.example/a.png" in got[1]["html"] and got[2]["title"] == ""
    for bad in ([], [("body", "remove")], [("a", "else")], [("a{b}", "content")], [("", "title")]):
        with pytest.raises(ValueError):
            extract_by_rules(df, bad)


def test_kept_lengths_follow_every_change():
    rng = random.Random(1)
    tags = ["div", "p", "a", "img", "span", "script", "ul", "li"]
    for _ in range(40):
        root = parse("".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", " word ", "x", " ", "<!-- c -->"]) for _ in range(60)))
        for _ in range(12):
            nodes = [root, *root.elements()]
            assert all(e.length() == len(e.text()) and e.count("a", "img") == sum(x.tag in ("a", "img") for x in e.elements()) for e in nodes)
            e = rng.choice(nodes)
            what = rng.randrange(4)
            if what == 0:
                e.remove()
            elif what == 1:
                e.add(rng.choice(["new", Node("img"), Node("p")]), 0)
            elif what == 2 and e is not root:
                e.rename(rng.choice(tags))
            else:
                root.add(Node("div"))
    deep = parse("<b>x" * 3000)
    assert deep.length() == 5999 and content.by_score(deep) is not None


def test_streams_report_and_stop(spark, tmp_path):
    from pagemill.streaming import state

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id event_id", "timestamp'2024-01-01 00:00:00' ts", "id user_id", "'x' event_type", "0.0 value", "'' props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    got = state.drain(state.events(spark, str(tmp_path / "in")).select("event_id"), str(tmp_path / "a"), progress=lambda n, p: seen.append(p["numInputRows"]))
    assert got.count() == 30 and sum(seen) == 30 and len([n for n in seen if n]) == 3


def test_containers_fonts_and_neighbours():
    root = parse("<body><div id=out><div id=mid><p id=in>" + "word " * 40 + "</p></div><img src=a></div><div id=far>" + "x" * 300 + "</div><p>s</p><p>t</p></body>")
    by = {e.get("id"): e for e in root.elements() if e.get("id")}
    assert content.widened(by["in"]) is by["out"] and content.widened(by["far"]) is by["far"]
    assert content.isolated(root.all("p")[-1]) and not content.isolated(root.all("p")[-2]) and not content.isolated(by["far"])
    big = parse("<div><b style='font-size:18px'>small one</b><span style='font-size: 22px'>First</span><b style='FONT-SIZE:22px'>Second</b></div>")
    assert content.loudest(big) == "First" and content.loudest(parse("<b>none</b>")) == ""


def test_one_session(spark):
    from pagemill.operators import cache

    saved = spark.createDataFrame([("a", "u", '{"n": 1}', 1), ("a", "v", '{"n": 2}', 2), ("b", "w", "{", 3), (None, "x", "{}", 4)], "session_id string, target_url string, state_json string, seq long")
    assert [(r["target_url"], r["n"]) for r in cache.session(saved, "a").select("target_url", F.variant_get("state", "$.n", "int").alias("n")).collect()] == [("v", 2)]
    assert cache.session(saved, "b").where("state is null").count() == 1 and cache.session(saved, "c").count() == 0
    assert sorted(r["seq"] for r in cache.without_session(saved, "a").collect()) == [3, 4]
