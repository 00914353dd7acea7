"""URL functions as native column expressions; ``join`` alone needs Python.

URLs are split by the pattern of RFC 3986, appendix B, which accepts every string. Null stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import values as V

RFC3986 = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, RFC3986, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 5)


def any_of(text: Column, words: list[str], how=F.contains) -> Column:
    """Whether ``how`` (contains, startswith, endswith) holds for one of the words."""
    return reduce(lambda a, b: a | b, [how(text, F.lit(w)) for w in words])


def _no_slash(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


def _kept_pairs(q: Column) -> Column:
    """The query's (name, value) pairs, decoded, tracking parameters left out, sorted."""
    part = F.filter(F.split(q, "&"), lambda x: x != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = F.transform(part, lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("k"), decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    return F.array_sort(F.filter(pair, lambda p: ~F.lower(p["k"]).isin(V.TRACKING_PARAMETERS)))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def key_query(url: Column) -> Column:
    """Dedup key: authority and path in lower case, the query without tracking parameters, sorted."""
    base, pairs = F.concat(authority(url), F.lower(_no_slash(path(url)))), _kept_pairs(query(url))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.lower(_no_slash(F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), text)).otherwise(base)))


def key_path(url: Column) -> Column:
    """Dedup key that leaves the query out."""
    return F.lower(_no_slash(F.concat(authority(url), F.lower(_no_slash(path(url))))))


def normalized(url: Column) -> Column:
    """Host in lower case without a default port, no fragment, no slash at the end of the path."""
    s, host, p, q = scheme(url), F.lower(authority(url)), _no_slash(path(url)), query(url)
    host = F.when(s == "http", F.regexp_replace(host, ":80$", "")).when(s == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    p = F.when(p == "", F.lit("/")).otherwise(p)
    return F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit("")), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def link_form(url: Column) -> Column:
    """An absolute link without query and fragment, host in lower case, no slash at the end."""
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), _no_slash(path(url)))


def same_domain(a: Column, b: Column) -> Column:
    return F.lower(authority(a)) == F.lower(authority(b))


def same_site(host: Column, base: Column) -> Column:
    """Equal hosts, ``www.`` aside, or one below the other."""
    a, b = F.replace(host, F.lit("www."), F.lit("")), F.replace(base, F.lit("www."), F.lit(""))
    dot = F.lit(".")
    return (host == base) | (a == b) | F.endswith(a, F.concat(dot, b)) | F.endswith(b, F.concat(dot, a))


def valid_page(url: Column) -> Column:
    """Whether a URL can be a page: no other scheme, file, search, redirect or anchor."""
    low, p, q, f = F.lower(url), _no_slash(path(url)), query(url), fragment(url)
    odd = any_of(low, V.SKIP_SCHEMES, F.startswith) | any_of(low, V.PAGE_SKIP_EXTENSIONS, F.endswith)
    asks = p.isin(V.SEARCH_PATHS + V.REDIRECT_PATHS) & (q != "")
    anchor = (f != "") & path(url).isin("", "/") & (q == "") & (F.char_length(f) <= 15)
    return ~(odd | asks | anchor)


def crawlable(url: Column) -> Column:
    """The rule for links: http or https, and no file by its path."""
    return scheme(url).isin("http", "https") & ~any_of(F.lower(path(url)), V.LINK_SKIP_EXTENSIONS, F.endswith)


def is_home(url: Column, base: Column) -> Column:
    p = _no_slash(path(url))
    return (authority(url) == authority(base)) & ((p == "") | (p == _no_slash(path(base))) | any_of(F.lower(p), V.HOME_ENDINGS, F.endswith))


def list_reason(url: Column, text: Column) -> Column:
    """Why a link leads to a list of pages: the word of its URL or text; null for detail pages."""
    low, said = F.lower(url), F.lower(F.coalesce(text, F.lit("")))
    shows = low.rlike(r"[?&]a=show\b") & low.rlike(r"[?&]id=\d+")

    def hit(word: str) -> Column:
        if word == "page":
            return low.rlike(r"page[/-]\d+")
        if word == "category":
            return F.contains(low, F.lit("/category/")) | F.contains(low, F.lit("category_id"))
        return F.contains(low, F.lit(word))

    by_url = F.coalesce(*[F.when(hit(w), F.lit(w)) for w in V.LIST_URL_WORDS])
    by_text = F.coalesce(*[F.when(F.contains(said, F.lit(w)), F.lit(w)) for w in V.LIST_LINK_TEXTS])
    return F.when(~shows, F.coalesce(by_url, by_text))


def is_detail(url: Column, text: Column) -> Column:
    return list_reason(url, text).isNull()


def path_levels(url: Column, most: int = 4) -> Column:
    """Up to four levels of a URL's path, in lower case, without technical, numeric and date parts."""
    parts = F.split(F.lower(path(url)), "/")
    name = F.transform(parts, lambda x: F.regexp_replace(x, r"\.(html?|shtml|php|aspx?|jsp)$", ""))
    told = F.filter(name, lambda x: (x != "") & ~x.isin("index", "default", "home", "main") & ~x.rlike(r"^[\d_-]+$"))
    return F.slice(F.array_distinct(told), 1, most)


def split_levels(levels: Column, n: int = 4) -> Column:
    """struct(joined, l1 .. ln): a path's levels joined by '/', and one by one, empty where missing."""
    joined = F.array_join(F.filter(levels, lambda x: x != ""), "/")
    return F.struct(F.coalesce(joined, F.lit("")).alias("joined"), *[F.coalesce(F.get(levels, F.lit(i)), F.lit("")).alias(f"l{i + 1}") for i in range(n)])


def join(base: str, href: str) -> str:
    """``href`` resolved against ``base``; empty where that fails."""
    from urllib.parse import urljoin

    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""
