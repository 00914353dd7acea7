"""Queries over keys that hold whole tables, budgeted frontiers, fetch queues, committed files and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import tables, urls
from pagemill.operators import cache, categories, dedup, dictionary, evaluate, intervals, links, store
from pagemill.operators.lineage import cut
from pagemill.plans.page_queries import _LINKS
from pagemill.plans.registry import register
from pagemill.plans.state_queries import _FOLD, _writes
from pagemill.sources import fetch_queue, file_sink, readers, sitemaps
from pagemill.sources.places import shared
from pagemill.sources.readers import pages, table
from pagemill.streaming import keyed, state


def _local_micros(column: str):
    """A time's microseconds as its clock shows them, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast({column} AS timestamp_ntz))")


@register(
    "failure_runs_one_key",
    """WITH g AS (SELECT *, sum((event_type <> 'error')::INT) OVER (ORDER BY event_id) AS island FROM events)
    SELECT event_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY island ORDER BY event_id))::BIGINT AS run FROM g""",
)
def failure_runs_one_key(spark, sf_dir):
    """The whole log as one key."""
    log = table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("key"), "event_type")
    return evaluate.failure_runs(log, "key", "event_id", F.col("event_type") == "error").select("event_id", "run")


@register("file_names_one_path", "SELECT o_orderkey, 'orders/' || o_orderstatus || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.html' AS file_path FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS nth FROM orders)")
def file_names_one_path(spark, sf_dir):
    """All orders of a status share one path."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return categories.file_paths(rows, F.lit("orders"), F.col("o_orderstatus"), ["o_orderkey"]).select("o_orderkey", "file_path")


@register("image_count_one_hash", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seen, row_number() OVER (PARTITION BY event_type ORDER BY event_id) >= 5 AS repeated FROM events")
def image_count_one_hash(spark, sf_dir):
    """A few pictures, each on a large part of all pages."""
    rows = table(spark, sf_dir, "events").select("event_id", F.md5("event_type").alias("md5"))
    return dedup.running_image_count(rows, ["event_id"]).select("event_id", "seen", "repeated")


def _crawl_sql(budget: int, most: int, per_page: int, per_site: int, seeds: str) -> str:
    """The crawl level by level, a common table expression each."""
    parts = [
        "e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_orderkey) * 1048576 + b.l_partkey AS pos FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)",
        f"f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pos) AS nth FROM e) WHERE nth <= {per_page})",
    ]
    for k in range(most + 1):
        found = f"SELECT p_partkey AS node, min((p_partkey, 0)) AS o FROM part WHERE {seeds} GROUP BY 1" if k == 0 else f"SELECT dst AS node, min((number, pos)) AS o FROM f JOIN r{k - 1} ON src = node AND level = {k - 1} WHERE dst NOT IN (SELECT node FROM r{k - 1}) GROUP BY 1"
        had = "0" if k == 0 else f"(SELECT count(*) FROM r{k - 1} h WHERE h.site = p_brand)"
        before = "0" if k == 0 else f"(SELECT count(*) FROM r{k - 1})"
        old = "" if k == 0 else f"SELECT * FROM r{k - 1} UNION ALL "
        parts.append(f"c{k} AS ({found}), s{k} AS (SELECT node, p_brand AS site, o, row_number() OVER (PARTITION BY p_brand ORDER BY o) + {had} AS of_site FROM c{k} JOIN part ON p_partkey = node)")
        parts.append(f"r{k} AS ({old}SELECT node, site, {k} AS level, number FROM (SELECT *, row_number() OVER (ORDER BY o) + {before} AS number FROM s{k} WHERE of_site <= {per_site}) WHERE number <= {budget})")
    return f"WITH {', '.join(parts)} SELECT node, site, level::INTEGER AS level, number::BIGINT AS number FROM r{most}"


@register("budgeted_crawl", _crawl_sql(600, 4, 6, 30, "p_partkey <= 20"))
def budgeted_crawl(spark, sf_dir):
    """Parts lead to the parts of the orders that have them, those of the first order first; a brand is a site."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"))

    def edges(nodes):
        # The reached parts' own lines as a table of known size: where it is small, all lines meet it without a shuffle.
        own = cut(lines.join(nodes, lines["src"] == nodes["node"], "left_semi"))
        pairs = lines.withColumnRenamed("src", "dst").join(own, "l_orderkey").where("src <> dst")
        return pairs.groupBy("src", "dst").agg((F.min("l_orderkey") * 1048576 + F.col("dst")).alias("pos"))

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("site"))
    return links.budgeted(part.where("node <= 20").select("node", F.col("node").alias("seq")), edges, part, 600, 4, 6, 30)


def _urls(spark, sf_dir):
    return pages(spark, sf_dir).groupBy("url").agg(F.min("page_id").alias("pos"))


_HOST = "lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1))"


@register(
    "fetch_schedule",
    f"""WITH u AS (SELECT url, min(page_id) AS pos FROM pages WHERE url IS NOT NULL GROUP BY url), n AS (SELECT url, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY pos, url) AS n FROM u)
    SELECT url, host, 1 AS attempt, n, (n - 1) * 2.5::DOUBLE AS at, floor((n - 1) * 2.5 / 10)::BIGINT AS round FROM n""",
)
def fetch_schedule(spark, sf_dir):
    return fetch_queue.plan(_urls(spark, sf_dir), interval=2.5, round_seconds=10.0).drop("lane")


@register(
    "fetch_by_host",
    """WITH u AS (SELECT DISTINCT url, length(url) % 5 AS k FROM pages WHERE url IS NOT NULL)
    SELECT url, unnest(range(1, CASE k WHEN 0 THEN 4 ELSE 2 END))::INTEGER AS attempt, CASE k WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 200 END AS status, CASE WHEN k > 1 THEN length(url) + 7 END::INTEGER AS size FROM u""",
)
def fetch_by_host(spark, sf_dir):
    """All attempts at the pages' URLs by a server that is overloaded for some and lacks others."""

    def fetch(url):
        k = len(url) % 5
        return (None, 503) if k == 0 else (None, 404) if k == 1 else (f"<p>{url}</p>", 200)

    log = fetch_queue.fetch_all(spark, _urls(spark, sf_dir), fetch, shared(spark, "fetch"), interval=0.001, round_seconds=30.0, lanes=16, backoff=0.05)
    return log.select("url", "attempt", "status", F.char_length("html").alias("size"))


@register("files_written_once", "SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256, md5(html) AS md5_read FROM pages WHERE html <> ''")
def files_written_once(spark, sf_dir):
    """Every page as a file, the job run twice, the files read back."""
    folder = shared(spark, "files")
    rows = pages(spark, sf_dir).where("html <> ''").select(F.concat_ws("/", (F.col("page_id") % 10).cast("string"), F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("file_path"), "html")
    file_sink.write_files(rows, folder, "pages")
    said = file_sink.write_files(rows, folder, "pages").select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "bytes", "sha256")
    read = readers.saved_pages(spark, folder).select(F.col("title").cast("long").alias("page_id"), F.md5("html").alias("md5_read"))
    return said.join(read, "page_id")


def _events(spark, sf_dir):
    """The events table as a stream of one file."""
    return spark.readStream.schema(state.EVENT).option("pathGlobFilter", "events*.parquet").parquet(f"{sf_dir}/events*.parquet")


@register(
    "stream_retry_due",
    """WITH m AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN (epoch_us(ts), event_id) END) AS ok FROM events GROUP BY user_id),
    f AS (SELECT e.user_id, count(*) AS failures, max(ts) AS last FROM events e JOIN m USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR (epoch_us(ts), event_id) > ok) GROUP BY e.user_id),
    d AS (SELECT user_id, failures, last + INTERVAL 1 HOUR * (1 << (failures - 1)) AS due FROM f WHERE failures < 3)
    SELECT user_id, failures, epoch_us(due) AS due FROM d WHERE due <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_retry_due(spark, sf_dir):
    """Retries that are due an hour before the last event, an hour after a first and two after a second failure."""
    told = keyed.retries(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error", 3, 3600.0).where("kind = 'due'")
    out = state.drain(told, shared(spark, "due"), "update")
    return out.select(F.col("key").alias("user_id"), "failures", _local_micros("due").alias("due"))


@register(
    "stream_best_path",
    """WITH e AS (SELECT user_id, ts, event_id, event_type AS parent, event_id % 97 = 0 AS done, list_transform(range(floor(value)::BIGINT % 4), lambda i: event_type || i) AS path FROM events),
    t AS (SELECT user_id, min(ts) AS t FROM e WHERE done GROUP BY user_id),
    l AS (SELECT user_id, parent, arg_max(path, (ts, event_id)) AS path FROM e LEFT JOIN t USING (user_id) WHERE NOT done AND (t IS NULL OR ts <= t) GROUP BY user_id, parent),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len(path) DESC, path, parent) AS nth FROM l WHERE len(path) > 0)
    SELECT user_id, array_to_string(path, '/') AS path, parent, t IS NOT NULL AS final FROM (SELECT * FROM b WHERE nth = 1) FULL JOIN t USING (user_id)""",
)
def stream_best_path(spark, sf_dir):
    """What event types offer as paths of users, up to the first event whose number 97 divides."""
    e = _events(spark, sf_dir)
    path = F.when(F.floor("value") % 4 > 0, F.transform(F.sequence(F.lit(0), (F.floor("value") % 4 - 1).cast("int")), lambda i: F.concat("event_type", i.cast("string"))))
    rows = e.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("parent"), path.alias("path"), (F.col("event_id") % 97 == 0).alias("done"))
    out = state.drain(keyed.paths(rows, "user_id"), shared(spark, "paths"), "update", ["key"])
    return out.where("path is not null or final").select(F.col("key").alias("user_id"), F.array_join("path", "/").alias("path"), "parent", "final")


def _steps(spark, sf_dir):
    """The cache after a base load and three merges of later writes, each into the buckets that it touches."""
    writes = _writes(spark, sf_dir)
    stored = writes.drop("seq").schema
    kept = store.KeyedTable(spark, shared(spark, "cache"), stored, "url", cache.fold, 32)
    most = writes.agg(F.max("seq")).first()[0]
    said = [kept.merge(writes.where(F.col("seq") < most // 2))]
    for i in range(3):
        low, high = most // 2 + i * (most // 6), most // 2 + (i + 1) * (most // 6) if i < 2 else most + 1
        said.append(kept.merge(writes.where(F.col("seq").between(low, high - 1))))
    return kept, said


@register("cache_incremental_merge", f"WITH {_FOLD} SELECT * FROM c")
def cache_incremental_merge(spark, sf_dir):
    return _steps(spark, sf_dir)[0].read()


_SPANS = "SELECT event_id, event_type, epoch_us(ts) AS t, epoch_us(ts) + floor(value * 60000000)::BIGINT AS u FROM events"


@register("interval_containment", f"WITH i AS ({_SPANS}) SELECT event_id, coalesce(max(u) OVER (PARTITION BY event_type ORDER BY t, u DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= u, false) AS contained FROM i")
def interval_containment(spark, sf_dir):
    """Events as stretches of as many minutes as their value; a few kinds have all rows."""
    t = _local_micros("ts")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", t.alias("t"), (t + F.floor(F.col("value") * 60_000_000)).alias("u"))
    return intervals.swept(rows, ["event_type"], "t", "u", ["event_id"]).select("event_id", "contained")


_WORDS = "SELECT w AS pattern, min(item_id) AS ord FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) > 3 GROUP BY w"


@register("dictionary_first_match", f"WITH p AS ({_WORDS}), m AS (SELECT doc_id, min({{'o': ord, 'p': pattern}}) AS b FROM documents JOIN p ON contains(text, pattern) GROUP BY doc_id) SELECT doc_id, b.p AS match FROM documents LEFT JOIN m USING (doc_id)")
def dictionary_first_match(spark, sf_dir):
    """The first of all words of the benchmark that stands anywhere in a document."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.explode(F.split("text", " ")).alias("pattern")).where(F.char_length("pattern") > 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dictionary.first_match(rows, F.col("text"), words, "pattern", "ord").select("doc_id", "match")


_SITES = f"SELECT url, page_id, {_HOST} AS host FROM pages WHERE url IS NOT NULL AND page_id = (SELECT min(p.page_id) FROM pages p WHERE p.url = pages.url)"


@register(
    "sitemap_index",
    f"""WITH s AS ({_SITES}), h AS (SELECT host, min(page_id) AS first FROM s GROUP BY host),
    r AS (SELECT 'sitemap://index' AS sitemap, 0 AS level, row_number() OVER (ORDER BY host) - 1 AS pos, CASE WHEN first % 5 = 0 THEN 'missing' ELSE 'sitemap' END AS kind, 'sitemap://' || host AS url, NULL AS lastmod FROM h
    UNION ALL SELECT 'sitemap://' || host, 1, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1, 'page', url, CASE WHEN first % 2 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END FROM s JOIN h USING (host) WHERE first % 5 <> 0)
    SELECT sitemap, level::INTEGER AS level, pos::INTEGER AS pos, kind, url, lastmod FROM r""",
)
def sitemap_index(spark, sf_dir):
    """An index of a sitemap a host: half are XML in gzip, half lines of text, some are missing."""
    p = _urls(spark, sf_dir).where("url is not null").select("url", F.col("pos").alias("page_id"), F.lower(urls.authority(F.col("url"))).alias("host"))
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-"), day, F.lit("</lastmod></url>"))
    hosts = p.groupBy("host").agg(F.min("page_id").alias("first"), F.array_sort(F.collect_list(F.struct("page_id", entry.alias("entry"), "url"))).alias("all"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("all.entry", ""), F.lit("</urlset>"))
    files = hosts.where("first % 5 <> 0").select(F.concat(F.lit("sitemap://"), "host").alias("url"), F.when(F.col("first") % 2 == 0, xml).otherwise(F.array_join("all.url", "\n")).cast("binary").alias("content"))

    def packed(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gzip.compress(d) if d.startswith(b"<") else d for d in b.column(1).to_pylist()], pa.binary())], ["url", "content"])

    listed = hosts.groupBy().agg(F.array_sort(F.collect_list("host")).alias("hosts")).select(
        F.lit("sitemap://index").alias("url"),
        F.concat(F.lit("<sm:sitemapindex xmlns:sm='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.transform("hosts", lambda h: F.concat(F.lit("<sm:sitemap><sm:loc> sitemap://"), h, F.lit(" </sm:loc></sm:sitemap>"))), ""), F.lit("</sm:sitemapindex>")).cast("binary").alias("content"),
    )
    roots = spark.range(1).select(F.lit("sitemap://index").alias("url"))
    return sitemaps.expanded(files.mapInArrow(packed, "url string, content binary").unionByName(listed), roots).drop("priority")


@register("links_by_sql", f"{_LINKS} SELECT page_id, pos, link, text FROM l")
def links_by_sql(spark, sf_dir):
    """Pages to links by one statement over table functions."""
    tables.register(spark)
    return spark.sql("SELECT p.page_id, l.pos, l.url AS link, l.text FROM parquet.`{}` p, LATERAL page_links(p.html, p.url) l".format(f"{sf_dir}/pages.parquet"))
