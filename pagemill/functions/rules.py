"""Classifiers and small field rules as native column expressions. Null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import values as V
from pagemill.functions.urls import any_of, authority


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def without_tags(html: Column) -> Column:
    """Text without tags, runs of blanks as one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(_text(html), "<[^>]+>", " "), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags: the regular-markup twin of the tree's text."""
    return without_tags(F.regexp_replace(_text(html), r"(?is)<(script|style)\b.*?</\1\s*>", " "))


def enough_text(html: Column, least: int = 100) -> Column:
    return F.char_length(visible_text(html)) >= least


def is_placeholder(src: Column) -> Column:
    low = F.lower(_text(src))
    return (low == "") | any_of(low, V.PLACEHOLDERS)


def blocked(html: Column, method: Column | None = None) -> Column:
    """Whether a response is a block page: short with a signature, or with a strong one."""
    low, n = F.lower(_text(html)), F.char_length(_text(html))
    found = (n >= 100) & (((n < 1000) & any_of(low, V.BLOCK_SIGNATURES)) | any_of(low, V.STRONG_BLOCK_SIGNATURES))
    return found if method is None else (_text(method) == "anti_crawl_blocked") | found


def looks_like_404(html: Column) -> Column:
    low = F.lower(F.left(_text(html), F.lit(3000)))
    return F.contains(low, F.lit("was not found on this server")) | (F.contains(low, F.lit("404 not found")) & (F.char_length(without_tags(html)) < 500))


def has_captcha(html: Column) -> Column:
    return any_of(F.lower(_text(html)), V.CAPTCHA_WORDS)


def needs_script(html: Column, text_length: Column) -> Column:
    low = F.lower(_text(html))
    return (low == "") | (text_length < 200) | (any_of(low, V.SCRIPT_APP_SIGNALS) & (text_length < 1000))


def site_scores(html: Column) -> Column:
    """struct of the score of each site type."""
    low = F.lower(_text(html))
    typed = F.contains(low, F.lit("itemtype"))
    bonus = {"ecommerce": F.when(typed & F.contains(low, F.lit("product")), 2).otherwise(0), "blog": F.when(typed & (F.contains(low, F.lit("article")) | F.contains(low, F.lit("blogposting"))), 2).otherwise(0)}
    return F.struct(*[(_hits(low, words) * (2 if kind == "spa" else 1) + bonus.get(kind, F.lit(0))).alias(kind) for kind, words in V.SITE_SIGNATURES.items()])


def site_type(html: Column, url: Column) -> Column:
    """The type of the largest score, the first declared of equal ones; without any, by the host."""
    s = site_scores(html)
    best = F.greatest(*[s[k] for k in V.SITE_SIGNATURES])
    named = F.coalesce(*[F.when(s[k] == best, F.lit(k)) for k in V.SITE_SIGNATURES])
    fallback = F.when(any_of(F.lower(authority(url)), V.SHOP_HOSTS), F.lit("ecommerce")).otherwise(F.lit("cms"))
    return F.when(_text(html) == "", F.lit("other")).when(best == 0, fallback).otherwise(named)


def anti_crawl_level(html: Column) -> Column:
    low = F.lower(_text(html))
    robots = F.regexp_extract(low, r"""<meta\b[^>]*name=["']?robots["']?[^>]*>""", 0)
    points = (
        F.when(any_of(low, V.PROTECTION_SIGNALS), 2).otherwise(0) + F.when(any_of(low, V.CAPTCHA_WORDS[:-1]), 2).otherwise(0)
        + F.when(robots.rlike("noindex|nofollow"), 1).otherwise(0) + F.when(F.contains(low, F.lit("<script")) & F.contains(low, F.lit("document.cookie")), 1).otherwise(0)
    )
    return F.when(low == "", F.lit("high")).when(points >= 4, F.lit("high")).when(points >= 2, F.lit("medium")).otherwise(F.lit("low"))


def list_page(text_length: Column, links: Column, title: Column, pager_class: Column, text: Column) -> Column:
    """struct(is_list, confidence, reasons) from what a parsed page holds; ``links`` counts its non-empty hrefs."""
    density = links / F.greatest(text_length, F.lit(1))
    rules = [
        F.when(density > 0.06, F.lit("link density")),
        F.when((text_length < 300) & (links > 10), F.lit("short text, many links")),
        F.when(any_of(F.lower(_text(title)), V.LIST_TITLE_WORDS), F.lit("title")),
        F.when(pager_class, F.lit("pager")),
        F.when(_text(text).rlike(V.PAGER_TEXT), F.lit("pager text")),
    ]
    reasons = F.filter(F.array(*rules), lambda r: r.isNotNull())
    n = F.size(reasons)
    return F.struct((n > 0).alias("is_list"), F.when(n > 0, F.round(F.least(0.5 + 0.15 * n, F.lit(1.0)), 2)).otherwise(0.0).alias("confidence"), F.array_join(reasons, "; ").alias("reasons"))


def confidence(length: Column, steps: list[float] = (0.9, 0.7, 0.4, 0.1)) -> Column:
    """The ladder from a text's length to the trust in its extraction."""
    return F.when(length > 500, steps[0]).when(length > 200, steps[1]).when(length > 50, steps[2]).otherwise(steps[3])


HEURISTIC_STEPS = (0.85, 0.6, 0.3, 0.05)


def noise_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [_text(text).rlike(p).cast("int") for p in V.NOISE_PATTERNS])


def noise_block(names: Column, text: Column) -> Column:
    """Whether a block with these class and id names and this text is page furniture."""
    return ~_text(names).rlike(V.SAFE_BLOCK) & (_text(names).rlike(V.NOISE_BLOCK) | ((F.char_length(_text(text)) >= 20) & (noise_count(text) >= 2)))


def like_title(text: Column) -> Column:
    return (_text(text) != "") & (text.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}\s") | (F.char_length(text) > 15))


def requeue(levels: Column) -> Column:
    """Whether a newly found path is good enough to visit a page again."""
    return F.coalesce((F.size(levels) >= 2) & ~like_title(F.get(levels, F.lit(0))), F.lit(False))


def error_message(reason: Column) -> Column:
    """What a user is told for an error: the anti-crawl message, else the first entry that fits."""
    low = F.lower(_text(reason))
    known = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(m)) for k, m in V.ERROR_MESSAGES.items()])
    return F.when(any_of(low, V.ANTI_CRAWL_TYPES), F.lit(V.BLOCKED_MESSAGE)).otherwise(F.coalesce(known, F.concat(F.lit("⚠️ "), _text(reason))))


def pre_check(url: Column, status: Column, html: Column, anchors: Column, title: Column) -> Column:
    """struct(pass, reason): the gate before a crawl, from a fetched home page."""
    host, low, n = F.lower(authority(url)), F.lower(_text(html)), F.char_length(_text(html))
    shell = any_of(low, ['<div id="app"', '<div id="root"']) & any_of(low, [".js", "vue", "react", "webpack", "__next"])
    bad = F.coalesce(*[F.when(F.contains(F.lower(_text(title)), F.lit(w)), F.lit(w)) for w in V.BAD_TITLES])
    reason = (
        F.when(any_of(host, V.BLOCKED_DOMAINS, F.endswith), F.lit("blocked domain"))
        .when(any_of(host, V.BLOCKED_DOMAIN_WORDS), F.lit("blocked domain word"))
        .when(status.isNull(), error_message(F.lit("connectionerror")))
        .when(status == 429, F.lit("too many requests"))
        .when(status != 200, error_message(status.cast("string")))
        .when(shell, F.lit(None))
        .when(n < 1000, F.lit("too short"))
        .when(any_of(low, V.WAF_WORDS), error_message(F.lit("waf/captcha")))
        .when(anchors < 3, F.lit("too few links"))
        .when(bad.isNotNull(), error_message(bad))
    )
    return F.struct(reason.isNull().alias("pass"), F.coalesce(reason, F.lit("")).alias("reason"))


def datetime_text(text: Column) -> Column:
    """A date in one of three formats as 'yyyy-MM-dd HH:mm:ss'; other text as it is."""
    flat = F.btrim(_text(text))
    for mark, to in (("年", "-"), ("月", "-"), ("日", "")):
        flat = F.replace(flat, F.lit(mark), F.lit(to))
    read = F.coalesce(*[F.try_to_timestamp(flat, F.lit(f)) for f in ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d")])
    return F.coalesce(F.date_format(read, "yyyy-MM-dd HH:mm:ss"), flat)


def publish_time(text: Column) -> Column:
    """The first date in a text, with its time if there is one."""
    found = [F.regexp_extract(_text(text), p, 1) for p in V.DATE_PATTERNS]
    return datetime_text(F.coalesce(*[F.when(x != "", x) for x in found], F.lit("")))


def safe_name(name: Column, most: int = 60, gap: str = "_", empty: str = V.NO_NAME) -> Column:
    """A file name: characters that file systems forbid replaced, blanks collapsed, cut to ``most``."""
    flat = F.regexp_replace(F.regexp_replace(_text(name), r'[\\/:*?"<>|\n\r\t]', gap), r"\s+", " ")
    cut = F.left(F.btrim(flat), F.lit(most))
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def company(url: Column) -> Column:
    """A site's company: a known part of the host, a host that isn't ASCII, else the host with '_' for '.' and ':'."""
    host = F.replace(F.lower(authority(url)), F.lit("www."), F.lit(""))
    head = F.substring_index(host, ".", 1)
    known = F.coalesce(*[F.when(F.contains(host, F.lit(k)), F.lit(v)) for k, v in V.COMPANY_HOSTS.items()])
    return F.coalesce(known, F.when(head.rlike(r"[^\x00-\x7F]"), head), F.translate(host, ".:", "__"))


def clean_label(text: Column) -> Column:
    """A link's text: blanks collapsed, marks at its ends off, at most 80 characters."""
    flat = F.btrim(F.regexp_replace(_text(text), r"\s+", " "), F.lit(" >»›|·-"))
    return F.when(F.char_length(flat) > 80, F.concat(F.left(flat, F.lit(77)), F.lit("..."))).otherwise(flat)


def embeds(src: Column, alt: Column) -> Column:
    """Whether an image is worth embedding: no data URI, icon, pixel, or block word with a meaningless alt."""
    low, said = F.lower(_text(src)), F.btrim(_text(alt))
    dull = (said != "") & said.rlike(r"^[a-zA-Z0-9_\-\s\.]{1,9}$") & any_of(low, V.IMAGE_BLOCK_WORDS)
    return ~(F.startswith(low, F.lit("data:")) | any_of(low, V.ICON_WORDS) | any_of(low, V.PIXEL_WORDS) | dull)


def mime(content_type: Column, src: Column) -> Column:
    plain = F.substring_index(F.lower(_text(src)), "?", 1)
    by_name = F.coalesce(*[F.when(F.endswith(plain, F.lit(e)), F.lit(m)) for e, m in V.IMAGE_TYPES.items()], F.lit(""))
    return F.when(F.contains(_text(content_type), F.lit("image/")), F.btrim(F.substring_index(content_type, ";", 1))).otherwise(by_name)


def looks_like_html(content: Column) -> Column:
    """Whether bytes that should be an image are a page."""
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return F.coalesce(head.rlike(r"^\s*(<html|<!doctype)") | F.contains(F.lower(F.decode(F.substring(content, 1, 200), "ISO-8859-1")), F.lit("http-equiv")), F.lit(False))


def png_size(content: Column) -> Column:
    """struct(width, height) of a PNG's header; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(content: Column, most: int = 64) -> Column:
    """struct(width, height) of a JPEG's frame header, found by walking its first ``most`` segments; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substr(content, at, F.lit(2))), 16, 10).cast("int")
    frame = r"^FFC[0-35-79-BD-F]$"
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("frame"))

    def step(a, _):
        mark, size = F.hex(F.substr(content, a["at"], F.lit(2))), number(a["at"] + 2)
        found = F.when(mark.rlike(frame), a["at"])
        onward = F.when(mark.rlike("^FF(?!FF)") & (size >= 2), a["at"] + 2 + size).otherwise(F.lit(1 << 30))
        return F.when(a["frame"].isNotNull(), a).otherwise(F.struct(F.when(found.isNull(), onward).otherwise(a["at"]).cast("int").alias("at"), found.cast("int").alias("frame")))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["frame"]
    return F.when((F.hex(F.substring(content, 1, 2)) == "FFD8") & at.isNotNull() & number(at + 7).isNotNull(), F.struct(number(at + 7).cast("long").alias("width"), number(at + 5).cast("long").alias("height")))


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG or JPEG."""
    return F.coalesce(png_size(content), jpeg_size(content))


def squarish(width: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (width / height).between(0.8, 1.2), F.lit(False))


def data_uri(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def meta_refresh(content: Column) -> Column:
    return F.regexp_extract(_text(content), r"""(?i)url\s*=\s*["']?([^"'>\s]+)""", 1)


def body_hash(text: Column) -> Column:
    """MD5 of the text without blanks at its ends; empty for none."""
    flat = F.regexp_replace(_text(text), r"^\s+|\s+$", "")
    return F.when(flat == "", F.lit("")).otherwise(F.md5(flat))


def page_hash(body: Column, title: Column) -> Column:
    """MD5 of body, NUL, title."""
    return F.md5(F.concat(_text(body), F.char(F.lit(0)), _text(title)))
