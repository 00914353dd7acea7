"""Queries over logs, caches, graphs and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.functions import values as V
from pagemill.operators import cache, dedup, evaluate, links
from pagemill.plans.registry import register
from pagemill.sources.places import shared
from pagemill.sources.readers import table
from pagemill.streaming import state


def _failed():
    return F.col("event_type") == "error"


@register("status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return evaluate.status_counts(table(spark, sf_dir, "events"), "event_type")


_COUNTS = "SELECT count_if(event_type NOT IN ('error', 'signup')) AS saved, count_if(event_type = 'error') AS failed, count_if(event_type = 'signup') AS skipped, count_if(value > 90) AS with_images FROM events"


@register(
    "failure_rate_eval",
    f"""WITH c AS ({_COUNTS}), r AS (SELECT *, failed / greatest(saved + failed + skipped, 1) AS rate FROM c) SELECT saved, failed, skipped, round(rate, 6) AS failure_rate, saved > 0 AND rate <= 0.5 AS passed,
    CASE WHEN saved = 0 THEN 0.1 WHEN rate > 0.5 THEN 0.4 ELSE 0.9 END::DOUBLE AS score, CASE WHEN saved = 0 THEN 'content_quality' WHEN rate > 0.5 THEN 'anti_crawl' ELSE '' END AS issue, saved > 0 AND with_images = 0 AS image_missing, saved = 0 OR rate > 0.5 AS needs_js_render FROM r""",
)
def failure_rate_eval(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return evaluate.verdict(e.agg(F.count_if(~kind.isin("error", "signup")).alias("saved"), F.count_if(kind == "error").alias("failed"), F.count_if(kind == "signup").alias("skipped"), F.count_if(F.col("value") > 90).alias("with_images")))


@register("accuracy_eval", "SELECT count(*) AS total, count_if(quality = 1) AS passed, count_if(quality <> 1) AS failed, coalesce(round(100 * avg((quality = 1)::INT), 6), 0)::DOUBLE AS accuracy FROM labels")
def accuracy_eval(spark, sf_dir):
    return evaluate.accuracy(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed")))


@register(
    "consecutive_failures",
    """WITH g AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events)
    SELECT event_id, user_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY event_id))::BIGINT AS run FROM g""",
)
def consecutive_failures(spark, sf_dir):
    return evaluate.failure_runs(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", _failed()).select("event_id", "user_id", "run")


@register(
    "trailing_error_run",
    """WITH e AS (SELECT * FROM events WHERE event_type <> 'view'), m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_id END) AS ok FROM e GROUP BY user_id)
    SELECT user_id, count_if(event_type = 'error' AND (ok IS NULL OR event_id > ok)) AS trailing FROM e JOIN m USING (user_id) GROUP BY user_id""",
)
def trailing_error_run(spark, sf_dir):
    return evaluate.trailing_run(table(spark, sf_dir, "events"), "user_id", "event_id", _failed(), F.col("event_type") == "view")


@register("retry_limit", "SELECT user_id, count(*) AS attempts, count(*) >= 3 AS exhausted FROM events WHERE event_type = 'error' GROUP BY user_id")
def retry_limit(spark, sf_dir):
    return evaluate.retries(table(spark, sf_dir, "events"), "user_id", _failed())


@register("image_running_count_ge5", "SELECT event_id, count(*) OVER w AS seen, count(*) OVER w >= 5 AS repeated FROM events WINDOW w AS (PARTITION BY md5(user_id::VARCHAR) ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def image_running_count_ge5(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.md5(F.col("user_id").cast("string")).alias("md5"))
    return dedup.running_image_count(rows, ["event_id"]).select("event_id", "seen", "repeated")


def _writes(spark, sf_dir):
    """Cache writes made from events: a key per user, errors without a page, some successes without one."""
    e = table(spark, sf_dir, "events")
    ok = ~F.col("event_type").isin("error", "view")
    return e.select(
        F.concat(F.lit("https://h.example/"), F.col("user_id")).alias("url"), F.lit("https://h.example/").alias("base_url"), F.when(ok, "success").otherwise("failed").alias("status"),
        F.concat(F.lit("t"), F.col("event_id")).alias("title"), F.when(ok & (F.col("event_id") % 2 == 0), F.concat(F.lit("<p>"), F.col("event_id"))).alias("html"), F.col("event_id").alias("seq"),
    )


_WRITES = """w AS (SELECT 'https://h.example/' || user_id AS url, 'https://h.example/' AS base_url, CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'success' END AS status, 't' || event_id AS title,
  CASE WHEN event_type NOT IN ('error', 'view') AND event_id % 2 = 0 THEN '<p>' || event_id END AS html, event_id AS seq FROM events)"""
_FOLD = f"""{_WRITES}, f AS (SELECT url, 'https://h.example/' AS base_url, max(CASE WHEN html IS NOT NULL THEN seq END) AS whole, max(CASE WHEN status = 'success' THEN seq END) AS ok, max(seq) AS last FROM w GROUP BY url),
c AS (SELECT f.url, f.base_url, w.status, w.title, p.html FROM f JOIN w ON w.url = f.url AND w.seq = coalesce(whole, ok, last) LEFT JOIN w p ON p.url = f.url AND p.seq = whole)"""


@register("cache_upsert_fold", f"WITH {_FOLD} SELECT * FROM c")
def cache_upsert_fold(spark, sf_dir):
    return cache.fold(_writes(spark, sf_dir))


@register("cache_left_join", f"WITH {_FOLD}, u AS (SELECT DISTINCT url FROM w) SELECT u.url, c.title AS cached_title, CASE WHEN c.html IS NOT NULL THEN 'cached' ELSE 'fetch' END AS fetch_method FROM u LEFT JOIN c ON c.url = u.url AND c.status = 'success' AND c.html <> ''")
def cache_left_join(spark, sf_dir):
    writes = _writes(spark, sf_dir)
    return cache.lookup(writes.select("url").distinct(), cache.fold(writes), least=1).select("url", "cached_title", "fetch_method")


@register("frontier_anti_join", f"WITH {_FOLD}, o AS (SELECT DISTINCT 'https://h.example/' || (user_id + event_id % 3 * 40) AS url FROM events) SELECT url FROM o WHERE url NOT IN (SELECT url FROM c WHERE status = 'success' AND html <> '')")
def frontier_anti_join(spark, sf_dir):
    """Links to the pages of users and of numbers beyond, some of which are no user's."""
    links_ = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h.example/"), F.col("user_id") + F.col("event_id") % 3 * 40).alias("url")).distinct()
    return cache.uncached(links_, cache.fold(_writes(spark, sf_dir)))


@register("cache_site_counts", f"WITH {_FOLD} SELECT count(*) AS n FROM c WHERE base_url = 'https://h.example/'")
def cache_site_counts(spark, sf_dir):
    return cache.site_count(cache.fold(_writes(spark, sf_dir)), "https://h.example/")


# A toy graph: each nation leads to two others by arithmetic on its key.
_EDGES = "SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation"


@register(
    "frontier_bfs_levels",
    f"WITH RECURSIVE e AS ({_EDGES}), b(node, level) AS (SELECT 0, 0 UNION SELECT dst, level + 1 FROM b JOIN e ON e.src = b.node WHERE level < 4) SELECT node::INTEGER AS node, min(level)::INTEGER AS level FROM b GROUP BY node",
)
def frontier_bfs_levels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    edges = n.select("src", ((F.col("src") * 2 + 1) % 25).alias("dst")).unionByName(n.select("src", ((F.col("src") + 7) % 25).alias("dst")))
    return links.levels(edges, spark.range(1).select(F.col("id").cast("int").alias("node")), 4)


@register("tool_result_anti_join", "SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')")
def tool_result_anti_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left_anti")


@register("error_message_lookup", f"WITH k AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'Read timeout' WHEN 2 THEN 'cloudflare' WHEN 3 THEN '503' WHEN 4 THEN 'SSLError' ELSE event_type END AS reason FROM events) SELECT event_id, CASE WHEN contains(reason, 'cloudflare') OR reason = '503' THEN '{V.BLOCKED_MESSAGE}' WHEN contains(reason, '404') THEN '{V.ERROR_MESSAGES['404']}' WHEN contains(reason, 'timeout') THEN '{V.ERROR_MESSAGES['timeout']}' WHEN reason = 'SSLError' THEN '{V.ERROR_MESSAGES['ssl']}' ELSE '⚠️ ' || reason END AS message FROM k")
def error_message_lookup(spark, sf_dir):
    k = F.col("event_id") % 7
    reason = F.when(k == 0, "HTTP 404").when(k == 1, "Read timeout").when(k == 2, "cloudflare").when(k == 3, "503").when(k == 4, "SSLError").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", rules.error_message(reason).alias("message"))


@register("json_tolerant_parse", "SELECT event_id, json_valid(props) AS valid, len(json_keys(props))::INTEGER AS n_keys FROM events")
def json_tolerant_parse(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", v.isNotNull().alias("valid"), F.size(F.json_object_keys("props")).alias("n_keys"))


@register(
    "golden_forall_exists",
    """WITH g AS (SELECT l.doc_id, l.doc_id % 3 <> 0 AS crumb_ok, l.doc_id % 4 <> 0 AS title_ok, coalesce(l.quality, 0) >= 1 OR l.doc_id % 7 = 0 AS images_ok FROM labels l JOIN documents d USING (doc_id))
    SELECT doc_id AS id, title_ok, crumb_ok, images_ok, title_ok AND crumb_ok AND images_ok AS passed FROM g""",
)
def golden_forall_exists(spark, sf_dir):
    """Each labelled document as a case: texts that are equal, or share no letter, so that the ratio is 1 or 0."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    k, none = F.col("doc_id"), F.lit(None).cast("string")
    cases = d.select(
        k.alias("id"), F.lit("abc").alias("title"), F.when(k % 4 == 0, "xyz").when(k % 4 == 1, none).otherwise("ABC").alias("expected_title"), F.lit("2025-01-02").alias("publish_time"), F.when(k % 2 == 0, "2025-").otherwise("").alias("expected_publish_time"),
        F.array(F.lit("home"), F.when(k % 3 != 0, "news").otherwise("zzzz")).alias("breadcrumb"), F.array(F.lit("Home"), F.lit("news")).alias("expected_breadcrumb"),
        F.coalesce("quality", F.lit(0)).alias("images"), F.when(k % 7 != 0, F.lit(1)).alias("expected_images"),
    )
    return evaluate.golden(cases).select("id", "title_ok", "crumb_ok", "images_ok", "passed")


@register("golden_accuracy", "SELECT count(*) AS total, count_if(doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND (coalesce(quality, 0) >= 1 OR doc_id % 7 = 0)) AS passed, count_if(NOT (doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND (coalesce(quality, 0) >= 1 OR doc_id % 7 = 0))) AS failed, coalesce(round(100 * avg((doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND (coalesce(quality, 0) >= 1 OR doc_id % 7 = 0))::INT), 6), 0)::DOUBLE AS accuracy FROM labels JOIN documents USING (doc_id)")
def golden_accuracy(spark, sf_dir):
    return evaluate.accuracy(golden_forall_exists(spark, sf_dir))


@register("string_similarity")
def string_similarity(spark, sf_dir):
    """Neighbouring documents' whole texts compared by matching blocks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("before")), "doc_id").select("doc_id", F.round(evaluate.similarity("text", "before"), 6).alias("ratio"))


def _stream(spark, sf_dir):
    """The events table as a stream of one file."""
    return spark.readStream.schema(state.EVENT).option("pathGlobFilter", "events*.parquet").parquet(f"{sf_dir}/events*.parquet")


@register("stream_dedup", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_dedup(spark, sf_dir):
    rows = state.distinct_keys(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], delay="3650 days")
    return state.drain(rows, shared(spark, "dedup")).groupBy("event_type").agg(F.count("*").alias("users"))


@register(
    "stream_retry_state",
    """WITH m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (epoch_us(ts), event_id) END) AS ok FROM events GROUP BY user_id) SELECT e.user_id, count_if(event_type = 'error' AND (ok IS NULL OR (epoch_us(ts), event_id) > ok)) AS failures,
    count_if(event_type = 'error' AND (ok IS NULL OR (epoch_us(ts), event_id) > ok)) >= 3 AS exhausted FROM events e JOIN m USING (user_id) GROUP BY e.user_id""",
)
def stream_retry_state(spark, sf_dir):
    return state.drain(state.retry_state(_stream(spark, sf_dir)), shared(spark, "retry"), "update", ["user_id"])


@register("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    out = state.drain(state.counts(_stream(spark, sf_dir)), shared(spark, "windows"), "update", ["window_start", "event_type"])
    return out.withColumn("total", F.round("total", 4))
