"""Queries over page URLs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions import values as V
from pagemill.operators import categories, links
from pagemill.plans.registry import register
from pagemill.sources.readers import pages

def listed(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def part(n: int, url: str = "url") -> str:
    """SQL for the n-th part of a URL."""
    return f"regexp_extract({url}, '{urls.RFC3986}', {n})"


def any_sql(text: str, words, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({text}, '{w}')" for w in words) + ")"


PARTS = f"p AS (SELECT *, lower({part(1)}) AS scheme, {part(2)} AS host, {part(3)} AS path, {part(4)} AS query, {part(5)} AS fragment FROM pages)"
_TRIM = "regexp_replace({}, '/+$', '')"
KEY_PATH = f"lower({_TRIM.format('host || lower(' + _TRIM.format('path') + ')')})"
#: Query pairs without tracking parameters, sorted by name and value.
KEY_QUERY = f"""lower(regexp_replace(host || lower(regexp_replace(path, '/+$', '')) || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_transform(pairs, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') ELSE '' END, '/+$', ''))"""
KEYED = f"""{PARTS}, q AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
  lambda x: {{'k': url_decode(replace(string_split(x, '=')[1], '+', ' ')), 'v': CASE WHEN contains(x, '=') THEN url_decode(replace(regexp_replace(x, '^[^=]*=', ''), '+', ' ')) ELSE '' END}}),
  lambda p: lower(p.k) NOT IN ({listed(V.TRACKING_PARAMETERS)}))) AS pairs FROM p),
k AS (SELECT *, {KEY_QUERY} AS key, {KEY_PATH} AS key_path FROM q)"""


@register("url_parts", f"WITH {PARTS} SELECT page_id, scheme, host, path, query, fragment FROM p")
def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.scheme(F.col("url")).alias("scheme"), urls.authority(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), urls.query(F.col("url")).alias("query"), urls.fragment(F.col("url")).alias("fragment"))


@register("url_key_query", f"WITH {KEYED} SELECT page_id, key FROM k")
def url_key_query(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.key_query(F.col("url")).alias("key"))


@register("url_key_path", f"WITH {KEYED} SELECT page_id, key_path FROM k")
def url_key_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.key_path(F.col("url")).alias("key_path"))


@register(
    "url_normalize",
    f"""WITH {PARTS} SELECT page_id, CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END || CASE WHEN host <> '' THEN '//' || CASE scheme WHEN 'http' THEN regexp_replace(lower(host), ':80$', '') WHEN 'https' THEN regexp_replace(lower(host), ':443$', '') ELSE lower(host) END ELSE '' END
    || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized,
    scheme || '://' || lower(host) || regexp_replace(path, '/+$', '') AS link_form FROM p""",
)
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalized(F.col("url")).alias("normalized"), urls.link_form(F.col("url")).alias("link_form"))


@register(
    "url_valid_page",
    f"""WITH {PARTS} SELECT page_id, NOT ({any_sql('lower(url)', V.SKIP_SCHEMES, 'starts_with')} OR {any_sql('lower(url)', V.PAGE_SKIP_EXTENSIONS, 'suffix')}
    OR (regexp_replace(path, '/+$', '') IN ({listed(V.SEARCH_PATHS + V.REDIRECT_PATHS)}) AND query <> '') OR (fragment <> '' AND path IN ('', '/') AND query = '' AND length(fragment) <= 15)) AS valid,
    scheme IN ('http', 'https') AND NOT {any_sql('lower(path)', V.LINK_SKIP_EXTENSIONS, 'suffix')} AS crawlable,
    regexp_replace(path, '/+$', '') = '' OR {any_sql("lower(regexp_replace(path, '/+$', ''))", V.HOME_ENDINGS, 'suffix')} AS is_home FROM p""",
)
def url_valid_page(spark, sf_dir):
    base = F.concat(F.lit("https://"), urls.authority(F.col("url")), F.lit("/"))
    return pages(spark, sf_dir).select("page_id", urls.valid_page(F.col("url")).alias("valid"), urls.crawlable(F.col("url")).alias("crawlable"), urls.is_home(F.col("url"), base).alias("is_home"))


def _word(w: str) -> str:
    if w == "page":
        return "regexp_matches(lower(url), 'page[/-]\\d+')"
    if w == "category":
        return "(contains(lower(url), '/category/') OR contains(lower(url), 'category_id'))"
    return f"contains(lower(url), '{w}')"


@register(
    "url_classify_detail",
    f"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '[?&]a=show\\b') AND regexp_matches(lower(url), '[?&]id=\\d+') THEN NULL
    {' '.join(f"WHEN {_word(w)} THEN '{w}'" for w in V.LIST_URL_WORDS)} ELSE NULL END AS list_word FROM pages""",
)
def url_classify_detail(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.list_reason(F.col("url"), F.lit("")).alias("list_word"))


@register(
    "url_path_nav",
    f"""WITH {PARTS}, l AS (SELECT page_id, list_distinct_ordered FROM (SELECT page_id, list_filter(list_transform(string_split(lower(path), '/'), lambda x: regexp_replace(x, '\\.(html?|shtml|php|aspx?|jsp)$', '')),
    lambda x: x <> '' AND x NOT IN ('index', 'default', 'home', 'main') AND NOT regexp_matches(x, '^[\\d_-]+$')) AS f FROM p), LATERAL (SELECT list_slice(list_filter(f, lambda x, i: list_position(f, x) = i), 1, 4) AS list_distinct_ordered))
    SELECT page_id, array_to_string(list_distinct_ordered, '/') AS joined, coalesce(list_distinct_ordered[1], '') AS l1, coalesce(list_distinct_ordered[2], '') AS l2, coalesce(list_distinct_ordered[3], '') AS l3, coalesce(list_distinct_ordered[4], '') AS l4 FROM l""",
)
def url_path_nav(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.split_levels(urls.path_levels(F.col("url"))).alias("s")).select("page_id", "s.*")


@register(
    "url_same_site_pairs",
    f"""WITH {PARTS}, h AS (SELECT DISTINCT unnest(['', 'www.', 'shop.']) || lower(host) AS host FROM p), r AS (SELECT host, replace(host, 'www.', '') AS bare, array_to_string(list_slice(string_split(replace(host, 'www.', ''), '.'), -2, -1), '.') AS root FROM h)
    SELECT a.host AS a, b.host AS b FROM r a JOIN r b ON a.root = b.root AND a.host < b.host WHERE a.bare = b.bare OR suffix(a.bare, '.' || b.bare) OR suffix(b.bare, '.' || a.bare)""",
)
def url_same_site_pairs(spark, sf_dir):
    """Hosts of one site, each with two subdomains of it: an equi-join on the last two labels, then the exact rule."""
    host = pages(spark, sf_dir).select(F.lower(urls.authority(F.col("url"))).alias("host"))
    host = host.select(F.explode(F.array(*[F.concat(F.lit(p), "host") for p in ("", "www.", "shop.")])).alias("host")).distinct()
    host = host.withColumn("root", F.substring_index(F.replace("host", F.lit("www."), F.lit("")), ".", -2))
    a, b = host.select(F.col("host").alias("a"), "root"), host.select(F.col("host").alias("b"), "root")
    return a.join(b, "root").where("a < b").where(urls.same_site(F.col("a"), F.col("b"))).select("a", "b")


@register("page_first_seen_dedup", f"WITH {KEYED} SELECT page_id, key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1")
def page_first_seen_dedup(spark, sf_dir):
    return links.first_seen(pages(spark, sf_dir).select("page_id", urls.key_query(F.col("url")).alias("key")), ["key"], ["page_id"])


@register("page_last_wins", f"WITH {KEYED} SELECT key_path, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM k GROUP BY key_path")
def page_last_wins(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.key_path(F.col("url")).alias("key_path"), "page_id", "url")
    return links.last_seen(rows.withColumn("seq", F.col("page_id")), ["key_path"], "seq").select("key_path", "page_id", "url")


# Menu entries by language sections of the test pages' paths.
_NAV = [("news", "/news", 0), ("blog", "/blog", 1), ("docs", "/docs", 2), ("shop", "/shop", 3), ("about", "/about", 4), ("a", "/a", 5), ("products", "/products", 6)]


def _nav(spark):
    return spark.createDataFrame(_NAV, "name string, prefix string, ord int")


def _nav_sql(order: str) -> str:
    rows = ", ".join(f"('{n}', '{p}', {o})" for n, p, o in _NAV)
    return f"""WITH {PARTS}, nav(name, prefix, ord) AS (VALUES {rows}), c AS (SELECT page_id, regexp_replace(path, '/+$', '') AS path FROM p),
    m AS (SELECT page_id, name FROM c JOIN nav ON c.path = nav.prefix OR starts_with(c.path, nav.prefix || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {order}) = 1)
    SELECT page_id, CASE WHEN path = '' THEN '{V.HOME_CATEGORY}' ELSE coalesce(name, '{V.OTHER_CATEGORY}') END AS category FROM c LEFT JOIN m USING (page_id)"""


@register("nav_exact_then_prefix", _nav_sql("c.path <> nav.prefix, ord"))
def nav_exact_then_prefix(spark, sf_dir):
    return categories.by_navigation(pages(spark, sf_dir), _nav(spark)).select("page_id", "category")


@register("nav_prefix_longest_match", _nav_sql("c.path <> nav.prefix, length(nav.prefix) DESC, ord"))
def nav_prefix_longest_match(spark, sf_dir):
    return categories.by_navigation(pages(spark, sf_dir), _nav(spark), longest=True).select("page_id", "category")


_SEEN = "SELECT key FROM k WHERE page_id % 3 = 0"


@register("set_except_visited", f"WITH {KEYED}, s AS (SELECT DISTINCT key FROM k WHERE page_id % 3 = 0) SELECT page_id, key FROM k WHERE key NOT IN (SELECT key FROM s)")
def set_except_visited(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.key_query(F.col("url")).alias("key"))
    return links.unseen(rows, rows.where("page_id % 3 = 0")).select("page_id", "key")


@register("set_intersect_seen", f"WITH {KEYED} (SELECT key FROM k WHERE page_id % 2 = 0) INTERSECT ({_SEEN})")
def set_intersect_seen(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.key_query(F.col("url")).alias("key"))
    return rows.where("page_id % 2 = 0").select("key").intersect(rows.where("page_id % 3 = 0").select("key"))


@register("set_union_seeds", f"WITH {KEYED} SELECT DISTINCT key FROM (SELECT key FROM k WHERE page_id % 2 = 0 UNION ALL {_SEEN})")
def set_union_seeds(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.key_query(F.col("url")).alias("key"))
    return rows.where("page_id % 2 = 0").select("key").unionByName(rows.where("page_id % 3 = 0").select("key")).distinct()


COMPANIES = " ".join(f"WHEN contains(host, '{k}') THEN '{v}'" for k, v in V.COMPANY_HOSTS.items())


@register("domain_contains_lookup", f"WITH {PARTS}, h AS (SELECT page_id, replace(lower(host), 'www.', '') AS host FROM p) SELECT page_id, CASE {COMPANIES} WHEN regexp_matches(string_split(host, '.')[1], '[^\\x00-\\x7F]') THEN string_split(host, '.')[1] ELSE translate(host, '.:', '__') END AS company FROM h")
def domain_contains_lookup(spark, sf_dir):
    from pagemill.functions import rules

    return pages(spark, sf_dir).select("page_id", rules.company(F.col("url")).alias("company"))
