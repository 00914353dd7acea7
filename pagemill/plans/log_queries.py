"""Queries over fetch logs, reports, model answers and overriding rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.functions import values as V
from pagemill.functions.pages import extract_by_rules
from pagemill.operators import cache, categories, evaluate, fetching, images, links, models, validate
from pagemill.plans.registry import register
from pagemill.plans.state_queries import _FOLD, _writes
from pagemill.sources import readers
from pagemill.sources.readers import pages, table

_LOG = """l AS (SELECT user_id AS url, event_id AS seq, CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 429 END ELSE CASE WHEN event_id % 3 = 0 THEN 200 ELSE 503 END END AS status FROM events)"""


@register(
    "fetch_outcomes",
    f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS nth FROM l), t AS (SELECT *, CASE WHEN status = 200 THEN 'fetched' WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'fatal' END AS kind FROM n WHERE nth <= 3),
    g AS (SELECT url, min(nth) FILTER (kind IS NOT NULL) AS ended, max(nth) AS n FROM t GROUP BY url)
    SELECT g.url, coalesce(ended, n)::INTEGER AS attempts, coalesce(kind, CASE WHEN n >= 3 THEN 'exhausted' ELSE 'pending' END) AS outcome, status FROM g JOIN t ON t.url = g.url AND t.nth = coalesce(ended, n)""",
)
def fetch_outcomes(spark, sf_dir):
    k, error = F.col("event_id"), F.col("event_type") == "error"
    status = F.when(error, F.when(k % 4 == 0, 500).when(k % 4 == 1, 404).when(k % 4 == 2, 429)).otherwise(F.when(k % 3 == 0, 200).otherwise(503))
    return fetching.outcomes(table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), k.alias("seq"), status.alias("status")))


@register(
    "page_override_join",
    """WITH m AS (SELECT page_id, 'embedded ' || page_id AS html FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id + 10000000, 'new' FROM pages WHERE page_id % 10 = 0)
    SELECT coalesce(m.page_id, p.page_id) AS page_id, md5(coalesce(m.html, p.html)) AS html_md5, m.page_id IS NOT NULL AS replaced FROM pages p FULL JOIN m ON m.page_id = p.page_id""",
)
def page_override_join(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "html")
    new = p.where("page_id % 10 = 0").select((F.col("page_id") + 10000000).alias("page_id"), F.lit("new").alias("html"))
    media = p.where("page_id % 4 = 0").select("page_id", F.concat(F.lit("embedded "), "page_id").alias("html")).unionByName(new)
    return images.overridden(p, media, "page_id").select("page_id", F.md5("html").alias("html_md5"), "replaced")


@register("images_missing", "SELECT DISTINCT user_id AS page_id, event_type AS url FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = e.event_type AND c.value > 50)")
def images_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("url"), "value")
    return images.missing(e.select("page_id", "url").distinct(), e.where("value > 50"))


@register(
    "blocked_report",
    """WITH u AS (SELECT DISTINCT event_type AS reason, user_id::VARCHAR AS url FROM events WHERE event_type <> 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY url) AS nth FROM u)
    SELECT reason, count(*) AS n, list_sort(list(url) FILTER (nth <= 10)) AS urls FROM r GROUP BY reason""",
)
def blocked_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason"))
    return evaluate.blocked_report(rows, "url", "reason")


@register("token_usage", "SELECT role, sum(length(coalesce(text, '')))::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS answer_tokens, count(*) AS calls FROM conversations GROUP BY role")
def token_usage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", F.char_length("text").alias("prompt_tokens"), F.col("turn").alias("answer_tokens"))
    return evaluate.usage(c, ["role"], ["prompt_tokens", "answer_tokens"])


@register("matched_length", "SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda m: length(m))), 0)::INTEGER AS digits FROM documents")
def matched_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.matched_length(F.col("text"), "[0-9]+").alias("digits"))


_ANSWERS = ('{"action": "scrape", "reasoning": "r", "priority_url": "u"}', 'text\n```json\n{"action": "STOP", "reasoning": "b"}\n```', 'so {"action": "go", "x": {"y": 1}} then', "we should 继续", "all done", "{not json} scrape it", '{"a": 1}')
_WANT = (("scrape", "r", "u"), ("finish", "b", ""), ("scrape", "", ""), ("scrape", "", ""), ("finish", "", ""), ("scrape", "", ""), ("finish", "", ""))


@register("decision_parse", "SELECT event_id, " + ", ".join(f"CASE event_id % {len(_WANT)} {' '.join(f'''WHEN {i} THEN '{w[k]}' ''' for i, w in enumerate(_WANT))} END AS {name}" for k, name in enumerate(("action", "reasoning", "priority_url"))) + " FROM events")
def decision_parse(spark, sf_dir):
    answer = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", models.decision(answer).alias("d")).select("event_id", "d.*")


@register(
    "messages_sanitised",
    """WITH m AS (SELECT conv_id, turn AS pos, role, text AS content, 0 AS part FROM conversations), c AS (SELECT conv_id, turn, 'c' || turn AS call FROM conversations WHERE role = 'assistant'),
    r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call FROM conversations WHERE role = 'user' AND turn % 4 = 0)
    SELECT conv_id, pos, role, md5(content) AS content, part FROM m UNION ALL SELECT conv_id, turn, 'tool', md5('工具执行失败，无返回结果'), 1 FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call = c.call AND r.turn > c.turn)""",
)
def messages_sanitised(spark, sf_dir):
    none = F.array().cast("array<string>")
    calls = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("c"), "turn"), F.lit(""))).otherwise(none)
    answered = F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.concat(F.lit("c"), F.col("turn") - 1))
    m = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"), calls.alias("calls"), answered.alias("result_of"))
    return models.sanitised(m).select("conv_id", "pos", "role", F.md5("content").alias("content"), "part")


@register("rule_extraction")
def rule_extraction(spark, sf_dir):
    """Pages through user rules: advertisements out, the article as content, its heading as title."""
    return extract_by_rules(pages(spark, sf_dir), [(".ad", "remove"), ("article, main", "content"), ("h1", "title")])


@register("image_sizes", "SELECT page_id, (page_id % 500 + 1)::BIGINT AS width, (page_id % 300 + 1)::BIGINT AS height, abs((page_id % 500 + 1) / (page_id % 300 + 1) - 1.0) <= 0.2000000001 AS square FROM pages")
def image_sizes(spark, sf_dir):
    """Headers of pictures made from page numbers, PNG and JPEG in turns."""
    w, h = F.col("page_id") % 500 + 1, F.col("page_id") % 300 + 1
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed(w, 8), hexed(h, 8))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0004AAAAFFC2001108"), hexed(h, 4), hexed(w, 4), F.lit("0301"))
    size = rules.image_size(F.unhex(F.when(F.col("page_id") % 2 == 0, png).otherwise(jpeg)))
    return pages(spark, sf_dir).select("page_id", size.alias("s")).select("page_id", "s.width", "s.height", rules.squarish(F.col("s.width"), F.col("s.height")).alias("square"))


@register("requeue_links", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0 AND user_id % 5 <> 0")
def requeue_links(spark, sf_dir):
    """Links with a path of two labels, one label, or a headline first; even users' pages are seen, every fifth is finished."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "event_type")
    head = F.when(F.col("event_id") % 3 == 2, "a headline that is no label").otherwise("news")
    path = F.when(F.col("event_id") % 3 == 1, F.array(head)).otherwise(F.array(head, "event_type"))
    return links.requeued(e.withColumn("nav_path", path), e.where("key % 2 = 0"), e.where("key % 5 = 0")).select("event_id")


@register("cache_visited", f"WITH {_FOLD}, o AS (SELECT DISTINCT 'https://h.example/' || (user_id + event_id % 3 * 40) AS url FROM events) SELECT url FROM o WHERE url IN (SELECT url FROM c)")
def cache_visited(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h.example/"), F.col("user_id") + F.col("event_id") % 3 * 40).alias("url")).distinct()
    return cache.visited(asked, cache.fold(_writes(spark, sf_dir)))


@register("cache_without_site", f"WITH {_FOLD} SELECT url, status FROM c WHERE right(url, 1) <> '3'")
def cache_without_site(spark, sf_dir):
    """The cache once one site's rows are cleared; the site of a page is told by the last digit of its URL."""
    rows = cache.fold(_writes(spark, sf_dir)).withColumn("base_url", F.right("url", F.lit(1)))
    return cache.without_site(rows, "3").select("url", "status")


@register("cache_upsert", f"""WITH {_FOLD} SELECT url, status, title FROM c""")
def cache_upsert(spark, sf_dir):
    """The first writes folded into a cache, the later ones written into it: as if all were folded at once."""
    w = _writes(spark, sf_dir)
    return cache.upsert(cache.fold(w.where("seq < 600")), w.where("seq >= 600")).select("url", "status", "title")


@register("session_snapshots", "SELECT user_id::VARCHAR AS session_id, arg_max(event_type, event_id) AS target_url, json_valid(arg_max(props, event_id)) AS has_state FROM events GROUP BY user_id")
def session_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("target_url"), F.col("props").alias("state_json"), F.col("event_id").alias("seq"))
    return cache.sessions(e).select("session_id", "target_url", F.col("state").isNotNull().alias("has_state"))


@register("sitemap_urls", "SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'http://h.example/?a=1&b=2' FROM pages WHERE page_id % 2 = 0")
def sitemap_urls(spark, sf_dir):
    """Sitemaps of one page each, XML and plain text in turns."""
    xml = F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>\n<url><loc>http://h.example/?a=1&amp;b=2</loc></url></urlset>"))
    text = F.concat(F.lit("# list\r\n  "), "url", F.lit("\n\n"))
    return pages(spark, sf_dir).select("page_id", F.explode(readers.sitemap_urls(F.when(F.col("page_id") % 2 == 0, xml).otherwise(text))).alias("url"))


@register(
    "fetch_plan",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cached' WHEN page_id % 2 = 0 THEN 'rendered' ELSE 'plain' END AS fetch_method FROM pages""",
)
def fetch_plan(spark, sf_dir):
    """Pages on a host for each, every third in the cache, every second host needing a browser."""
    p = pages(spark, sf_dir).select("page_id", F.concat(F.lit("https://H"), "page_id", F.lit(".example/x")).alias("url"))
    stored = p.select("url", F.lit("t").alias("title"), F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(600))).otherwise("short").alias("html"), F.lit("success").alias("status"))
    hosts = p.select(F.concat(F.lit("h"), "page_id", F.lit(".example")).alias("host"), (F.col("page_id") % 2 == 0).alias("needs_js_render")).where("page_id % 5 <> 1 or page_id % 2 = 0")
    return readers.fetch_plan(p, hosts, stored).select("page_id", "fetch_method")


@register("articles_from_json", "SELECT event_id, 'https://h/' || event_id AS url, event_type AS title, (event_id % 4)::INTEGER AS images_count FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 'b', NULL, NULL FROM events WHERE event_id % 5 = 1")
def articles_from_json(spark, sf_dir):
    """Answers with a list of articles: bare, fenced, with a second article, or unreadable."""
    one = F.to_json(F.struct(F.concat(F.lit("https://h/"), "event_id").alias("url"), F.col("event_type").alias("title"), (F.col("event_id") % 4).alias("images_count"), F.array(F.col("event_id").cast("string")).alias("breadcrumb")))
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.lit("[{broken")).when(k == 1, F.concat(F.lit("```json\n["), one, F.lit(', {"url": "b"}]\n```'))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    got = validate.from_json(table(spark, sf_dir, "events").select(text.alias("articles_json"), "event_id"), "articles_json", ["event_id"])
    return got.select("event_id", "url", "title", "images_count")


@register(
    "nav_levels",
    rf"""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ['A b', 'C'] WHEN 1 THEN ['news'] WHEN 2 THEN ['x', 'y'] ELSE ['title of page ' || left(page_id::VARCHAR, 6)] END AS v FROM pages)
    SELECT page_id, v[1] AS l1, coalesce(v[2], '') AS l2, '' AS l3, '' AS l4, array_to_string(v, '/') AS folder FROM l""",
)
def nav_levels(spark, sf_dir):
    """A page's four levels from its breadcrumb, its category, its path or its title."""
    k = F.col("page_id") % 4
    crumbs = F.when(k == 0, F.array(F.lit(" A \n b"), F.lit("C")))
    category = F.when(k == 1, "news").otherwise(V.OTHER_CATEGORY)
    url = F.when(k == 2, "https://h.example/x/y/2024/index.html").otherwise("https://h.example/")
    levels = categories.nav_levels(crumbs, category, url, F.concat(F.lit("title of page "), F.left(F.col("page_id").cast("string"), F.lit(6))))
    return pages(spark, sf_dir).select("page_id", levels.alias("v")).select("page_id", *[F.col("v")[i].alias(f"l{i + 1}") for i in range(4)], categories.folder_of(F.col("v")).alias("folder"))
