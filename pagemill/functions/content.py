"""Cleaning of page trees and the search for their main content.

Functions change the tree they are given. Thresholds are the parameters of the rules.
"""

from __future__ import annotations

import re

from pagemill.functions import values as V
from pagemill.functions.tree import Node, matches, parse
from pagemill.functions.urls import join

# --- Fixed values: names and words of page parts ---
HEADER_NAMES = r"(?i)(^|[-_])(header|topbar|top-bar|navbar|nav|menu|masthead|logo)([-_]|$)"
FOOTER_NAMES = r"(?i)(^|[-_])(footer|foot|copyright|beian|bottom)([-_]|$)"
SIDE_NAMES = r"(?i)(sidebar|side-bar|aside|left-nav|right-nav|widget)"
POPUP_NAMES = r"(?i)(popup|modal|dialog|float|fixed-|cookie|toast)"
AD_NAMES = r"(?i)(^|[-_])(ad|ads|advert|advertisement|banner-ad|sponsor)([-_]|$)"
META_NAMES = r"(?i)(share|social|meta-info|post-meta|article-meta|author|tags|related|recommend|comment)"
CONTENT_NAMES = r"(?i)(content|article|post|detail|main|entry|body-text|text)"
CONTENT_WORDS = ("content", "main", "article", "detail", "body", "pagebody", "text", "news", "info", "post")
NOISE_TOKENS = {"header", "footer", "nav", "navbar", "menu", "sidebar", "breadcrumb", "pager", "pagination", "copyright", "share", "related", "comment", "banner", "ad", "ads"}
CRUMB_NAMES = r"(?i)(breadcrumb|bread-crumb|crumbs|pager|pagination|page-nav|fenye)"
COPYRIGHT = re.compile(r"版权所有|copyright|©|ICP|备案|all rights reserved", re.I)
PHONE = re.compile(r"(?<!\d)(?:\d{3,4}-)?\d{7,8}(?!\d)|(?<!\d)1\d{10}(?!\d)")
CONTENT_SIGNAL = re.compile(r"\d{4}[-/.年]\d{1,2}|共\s*\d+\s*条|第\s*\d+\s*页|下一页|\d+\s*-\s*\d+")
POSITION_TEXT = re.compile(r"当前位置|您的位置|你的位置|所在位置|current position|you are here", re.I)
PAGER_START = re.compile(r"^(上一[篇页条]|下一[篇页条]|返回|前一篇|后一篇|prev|next|back)", re.I)
BACK_TEXT = re.compile(r"(上一[篇页]|下一[篇页]|返回列表|返回|back to list|previous|next)", re.I)
KEPT_STYLES = {"text-align", "text-indent", "font-weight", "color", "font-style"}
POSITION_STYLES = re.compile(r"(?i)(?:^|;)\s*(position|top|left|right|bottom|float|z-index|margin(?:-\w+)?|width|height)\s*:[^;]*")
KEPT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "img", "figure", "blockquote", "pre", "video", "section", "article", "div"}


def link_share(e: Node) -> float:
    """The share of an element's text that stands in links."""
    n = e.length()
    return sum(a.length() for a in e.all("a")) / n if n else 0.0


def link_density(e: Node) -> float:
    n = e.length()
    return e.count("a") / n if n else 0.0


def position(e: Node, body: Node) -> float:
    """Where an element begins among those of the body, from 0 to 1."""
    order = list(body.elements())
    return next((i for i, x in enumerate(order) if x is e), 0) / max(len(order), 1)


def is_header(e: Node, at: float) -> bool:
    if e.tag in ("header", "nav"):
        return True
    if e.count("img") >= 3:
        return False
    size = e.length()
    if not size:
        return True
    share = link_share(e)
    if size * (1 - share) >= 200:
        return False
    return (share > 0.55 and size < 600) or matches(HEADER_NAMES)(e) or (at < 0.15 and share > 0.4 and size < 2000)


def is_footer(e: Node, at: float) -> bool:
    if e.tag == "footer" or not e.length() or matches(FOOTER_NAMES)(e):
        return True
    text = e.text()
    found = COPYRIGHT.findall(text)
    if found and not (len(text) > 200 and sum(map(len, found)) < len(text) / 2):
        return True
    return at >= 0.8 and len(text) < 2000 and link_share(e) < 0.5 and bool(PHONE.search(text))


def drop(root: Node, *tags: str) -> None:
    for e in root.all(*tags):
        e.remove()


def strip_frame(root: Node) -> None:
    """Removes headers and footers; pages full of images lose only the elements named so."""
    body = root.first("body") or root
    drop(root, "header", "footer", "nav")
    if body.count("img") >= 20:
        return
    edge = [c for c in body.children if isinstance(c, Node)]
    order = {id(e): i for i, e in enumerate(body.elements())}
    for e in {id(x): x for x in [*edge[:2], *edge[-2:], *body.all("div", "section")]}.values():
        if e.tag in ("main", "article") or not e.attached(root) or e.first("article", "main"):
            continue
        at = order[id(e)] / max(len(order), 1)
        if not matches(CONTENT_NAMES)(e) and 0 < e.length() < 0.5 * body.length() and (is_header(e, at) or is_footer(e, at)):
            e.remove()


def strip_sides(root: Node) -> None:
    """Removes side bars, pop-ups, advertisements and what is fixed to the window."""
    drop(root, "aside")
    for pattern, spared in ((SIDE_NAMES, True), (POPUP_NAMES, True), (AD_NAMES, False)):
        for e in root.where(matches(pattern)):
            if e.tag not in ("body", "html") and not (spared and e.count("img") >= 3):
                e.remove()
    for e in root.where(lambda e: re.search(r"(?i)position\s*:\s*(fixed|sticky)", e.get("style"))):
        e.remove()


def strip_metadata(root: Node) -> None:
    """Removes share bars and the like, and links back to lists."""
    for e in root.where(matches(META_NAMES)):
        if e.tag not in ("body", "html", "article", "main") and e.length() < 200:
            e.remove()
    for e in root.all("a", "p", "span", "div", "li"):
        if e.attached(root) and 2 <= e.length() <= 30 and BACK_TEXT.search(e.text()):
            parent = e.parent
            e.remove()
            if parent is not None and parent.tag not in ("body", "html", "#root") and not parent.length() and not parent.first("img"):
                parent.remove()


def strip_link_lists(root: Node) -> None:
    """Removes navigation containers without images and lists that are mostly links."""
    for e in root.where(matches(r"(?i)nav|menu|breadcrumb|pager|pagination")):
        if e.tag not in ("body", "html") and not e.first("img"):
            e.remove()
    for e in root.all("ul", "ol"):
        if e.attached(root) and e.count("a") >= 5 and link_share(e) > 0.8:
            e.remove()


def strip_noise(root: Node) -> None:
    """Removes what never is content: scripts, forms, style sheets, comments."""
    drop(root, "script", "style", "noscript", "iframe", "form", "template", "link", "#comment")


def strip_position_styles(root: Node) -> None:
    for e in root.where(lambda e: "style" in e.attrs):
        style = POSITION_STYLES.sub("", e.get("style")).strip("; ")
        if style:
            e.attrs["style"] = style
        else:
            del e.attrs["style"]


def keep_styles(e: Node) -> None:
    """Keeps the few style properties that carry meaning."""
    pairs = [p.split(":", 1) for p in e.get("style").split(";") if ":" in p]
    style = "; ".join(f"{k.strip()}: {v.strip()}" for k, v in pairs if k.strip().lower() in KEPT_STYLES)
    e.attrs.pop("style", None)
    if style:
        e.attrs["style"] = style


def drop_empty(root: Node, least: int = 1) -> None:
    """Removes containers without text and media until none is left."""
    changed = True
    while changed:
        changed = False
        for e in reversed(root.all("div", "section", "p", "span", "ul", "li")):
            if e.attached(root) and e.length() < least and not e.first("img", "video", "table", "input"):
                e.remove()
                changed = True


def absolute(root: Node, url: str, images_only: bool = False) -> int:
    """Resolves sources, and links unless ``images_only``; the number of images with a source."""
    n = 0
    for e in root.all("img", "video", "source", "a"):
        for name in ("src", "data-src", "data-original", "poster", "href"):
            value = e.get(name).strip()
            if value and not (images_only and name == "href") and not value.startswith(("data:", "javascript:", "mailto:", "tel:", "#")):
                e.attrs[name] = join(url, value)
        if e.tag == "img" and e.get("src"):
            n += 1
            e.attrs.pop("srcset", None)
    return n


def image_source(e: Node) -> str:
    """An image's source: src, then the attributes of lazy loading, then the first of srcset."""
    for name in ("src", "data-src", "data-original", "data-lazy-src", "data-url"):
        value = e.get(name).strip()
        if value and not value.startswith("data:"):
            return value
    first = e.get("srcset").split(",")[0].strip().split(" ")[0]
    return "" if first.startswith("data:") else first


def rescue_images(root: Node, url: str) -> dict[str, int]:
    """Makes images usable: absolute sources, lazy ones, backgrounds as images; how many of each."""
    count = dict.fromkeys(("total", "path_fixed", "lazy_fixed", "css_extracted", "antihotlink"), 0)
    hollow = lambda s: not s or any(w in s.lower() for w in V.PLACEHOLDERS)
    for img in root.all("img"):
        src = img.get("src").strip()
        if src and not src.startswith("data:"):
            count["total"] += 1
            if not src.startswith(("http://", "https://")):
                img.attrs["src"] = join(url, src)
                count["path_fixed"] += 1
        if hollow(src):
            lazy = next((v for v in (img.get(a).strip() for a in V.LAZY_ATTRIBUTES) if not hollow(v)), None)
            if lazy:
                count["total"] += not src or src.startswith("data:")
                count["lazy_fixed"] += 1
                img.attrs = {k: v for k, v in img.attrs.items() if k not in V.LAZY_ATTRIBUTES} | {"src": join(url, lazy)}
    for e in root.where(lambda e: "background" in e.get("style").lower() or e.get("data-background")):
        found = re.findall(r"(?i)url\([\"']?(.*?)[\"']?\)", e.get("style")) if "background" in e.get("style").lower() else []
        for src in [*found, e.get("data-background")]:
            full = join(url, src) if src and not src.startswith("data:") else ""
            if full and all(i.get("src") != full for i in e.all("img")):
                e.add(Node("img", {"src": full}), 0)
                count["css_extracted"] += 1
                count["total"] += 1
    for img in root.all("img"):
        img.attrs.setdefault("referrerpolicy", "no-referrer")
        count["antihotlink"] += 1
    return count


def collect_images(root: Node, url: str, most: int = 20) -> list[tuple[str, str]]:
    """(source, alt) of the first images, each source once."""
    found: dict[str, str] = {}
    for e in root.all("img", "graphic", "image"):
        src = image_source(e)
        if src:
            found.setdefault(join(url, src), e.get("alt").strip())
    return list(found.items())[:most]


def _furniture(e: Node) -> bool:
    text = e.text()
    return len(PHONE.findall(text)) >= 2 or bool(re.search("(?i)icp|备案", text) and PHONE.search(text)) or "二维码" in text


def _noisy(e: Node) -> bool:
    return bool(NOISE_TOKENS & {*e.get("class").lower().split(), e.get("id").lower()})


def blocks(root: Node) -> list[dict]:
    """Content candidates of a page with their measures; pre and post give nesting."""
    body, out, post = root.first("body") or root, [], {}
    order = list(body.elements())
    number = {id(e): i for i, e in enumerate(order)}
    for e in reversed(order):
        post[id(e)] = max([number[id(e)], *(post[id(c)] for c in e.children if isinstance(c, Node))])
    for e in order:
        if e.tag not in ("div", "section", "article", "main", "td"):
            continue
        text = e.length()
        score = 0.5 * text + 100 * e.count("p") + 250 * e.count("img")
        score *= (1.5 if matches(CONTENT_NAMES)(e) else 1) * (1.2 if 0.15 <= number[id(e)] / max(len(order), 1) <= 0.85 else 1)
        out.append({"pre": number[id(e)], "post": post[id(e)], "tag": e.tag, "names": e.names(), "text_length": text, "paragraphs": e.count("p"), "images": e.count("img"), "links": e.count("a"), "score": round(score, 2)})
    return out


def outermost(parts: list[Node]) -> list[Node]:
    """The elements that are inside no other of them."""
    known = {id(e) for e in parts}

    def free(e: Node) -> bool:
        up = e.parent
        while up is not None and id(up) not in known:
            up = up.parent
        return up is None

    return [e for e in parts if free(e)]


def together(parts: list[Node]) -> Node:
    """One element as it is, several in a new container in their order."""
    if len(parts) == 1:
        return parts[0]
    box = Node("div")
    for e in parts:
        box.add(e)
    return box


def by_score(root: Node) -> Node:
    """Main content by measures of blocks: an article; the best-scored blocks together; the densest one; blocks of images; the body.

    What keeps too few of the page's images gives way to the whole body.
    """
    body = root.first("body") or root
    images, article = body.count("img"), root.first("article")
    if article is not None and article.length() > 30:
        return body if images > 5 and article.count("img") < 0.5 * images else article
    order = list(body.elements())
    placed = [(i / len(order), e) for i, e in enumerate(order) if e.tag in ("div", "section", "article")]
    boxes = [(at, e) for at, e in placed if not is_header(e, at) and not is_footer(e, at)]

    def weight(at: float, e: Node) -> float:
        named = any(w in e.names().lower() for w in CONTENT_WORDS)
        return (0.5 * e.length() + 100 * e.count("p") + 250 * e.count("img")) * (1.5 if named else 1) * (1.2 if 0.15 <= at <= 0.85 else 1)

    def density(e: Node) -> float:
        return 10 * e.length() ** 2 / max(len(e.html()), 1) + 80 * e.count("p") + 200 * e.count("img")

    scored = [(weight(at, e), e) for at, e in boxes if e.tag != "article" and e.length() >= 40]
    parts = outermost([e for score, e in sorted(scored, key=lambda x: -x[0])[:3] if score > 200])
    if not parts:
        whole = 0.8 * body.length()
        rest = [e for _, e in boxes if e.length() > 30 and not (e.parent is body and e.length() > whole)]
        parts = [max(rest, key=density)] if rest else []
    if parts:
        return body if images > 3 and sum(e.count("img") for e in parts) < 0.4 * images else together(parts)
    parts = outermost([e for _, e in boxes if e.tag != "article" and e.count("img") >= 2]) if images > 10 else []
    return together(parts) if parts and sum(e.count("img") for e in parts) >= 0.5 * images else body


def main_content(root: Node) -> Node:
    """Main content as up to five blocks: an article, else main, named containers and image groups, else divs."""
    body = root.first("body") or root
    article = root.first("article")
    if article is not None and article.length() > 100 and not _furniture(article):
        return article
    found = [e for e in body.elements() if not _noisy(e) and ((e.tag == "main" or matches(CONTENT_NAMES)(e)) and e.length() >= 100 and link_density(e) <= 0.3 and not _furniture(e) or e.tag in ("table", "td", "div") and e.count("img") >= 3)]
    limit = 5
    if not found:
        found, limit = [e for e in body.all("div") if e.length() > 100 or e.first("img")], 3
    outer = sorted(outermost(found), key=lambda e: -(e.length() + 100 * e.count("img")))[:limit]
    return together(outer) if outer else body


def widened(e: Node, most: int = 8) -> Node:
    """The outermost container around an element that adds to it: more images, a twentieth more text, or only a wrapper."""
    for _ in range(most):
        up = e.parent
        if up is None or up.tag in ("html", "body", "#root") or _noisy(up):
            break
        more, same = up.count("img") > e.count("img"), up.count("img") == e.count("img")
        if not (more or up.length() > 1.05 * e.length() or same and abs(up.length() - e.length()) <= 5):
            break
        e = up
    return e


def loudest(part: Node, least: int = 20) -> str:
    """The short text of the largest font in a part, the first of equal ones; empty if none has ``least`` pixels."""
    best, top = "", least - 1
    for e in part.all("strong", "b", "span"):
        m = re.search(r"(?i)font-size\s*:\s*(\d+)\s*px", e.get("style"))
        if m and int(m[1]) > top and 2 < len(e.text("")) < 50:
            best, top = e.text(""), int(m[1])
    return best


def isolated(e: Node, long: int = 200) -> bool:
    """Whether an element without long text stands between siblings without long text."""
    around = [c for c in e.parent.children if isinstance(c, Node)] if e.parent is not None else [e]
    i = next(k for k, c in enumerate(around) if c is e)
    return all(c.length() <= long for c in around[max(0, i - 1) : i + 2])


def structured_body(html: str, url: str) -> str:
    """The main content as a flat run of blocks, links unwrapped, furniture removed."""
    root = parse(html)
    strip_noise(root)
    drop(root, "header", "nav", "footer")
    part = main_content(root)
    for img in part.all("img"):
        if re.search(r"(?i)icon|logo|qrcode|erweima|arrow|btn", img.get("src") + " " + img.get("alt")):
            img.remove()
    for a in part.all("a"):
        a.rename("span")
        a.attrs = {}
    for e in part.all("div", "section", "ul", "table"):
        names, size = e.names(), e.length()
        if not e.attached(part) or size >= 0.5 * part.length() or re.search(V.SAFE_BLOCK, names):
            continue
        text = e.text() if size >= 20 else ""
        if re.search(V.NOISE_BLOCK, names) or text and sum(bool(re.search(p, text)) for p in V.NOISE_PATTERNS) >= 2:
            e.remove()
    drop_empty(part, 10)
    out = []
    for c in part.children:
        if isinstance(c, str):
            if len(c.strip()) > 15:
                out.append(f"<p>{c.strip()}</p>")
        elif c.tag in KEPT_BLOCKS:
            for e in [c, *c.elements()]:
                keep_styles(e)
            out.append(c.html())
        elif c.length() > (10 if c.tag == "span" else 20):
            out.append(f"<p>{c.text()}</p>")
    return "\n".join(out)


#: The rules of ``strip_navigation`` in order: name, tags, text test, longest text, further test.
def _navigation_rules(url: str):
    host = re.sub(r"^www\.", "", re.sub(r"^[a-z]+://([^/]*).*", r"\1", url or "").lower())

    def internal(e: Node) -> int:
        return sum(1 for a in e.all("a") if (h := a.get("href")) and (not re.match(r"(?i)[a-z]+:|//", h) or host and host in h))

    plain = lambda e: not e.first("h1", "h2", "h3", "img")
    bare = lambda e: not CONTENT_SIGNAL.search(e.text())
    home = lambda e: any(a.text() in V.HOME_NAMES for a in e.all("a"))
    menu = matches(r"(?i)menu|nav")
    return (
        ("crumb element", ("nav",), lambda e: "breadcrumb" in e.get("class").lower()),
        ("crumb or pager name", None, matches(CRUMB_NAMES)),
        ("position text", ("ul", "ol", "div"), lambda e: e.length() <= 80 and POSITION_TEXT.search(e.text()) and plain(e)),
        ("previous and next", ("p", "div", "li", "ul", "span"), lambda e: e.length() <= 120 and PAGER_START.match(e.text())),
        ("pager text", ("span", "div"), lambda e: e.length() <= 80 and re.search(V.PAGER_TEXT, e.text())),
        ("separated crumbs", ("div", "p", "ul"), lambda e: e.length() <= 100 and e.count("a") >= 2 and internal(e) >= 2 and home(e) and re.search("[>»＞/|]", e.text()) and plain(e)),
        ("link group", ("div", "ul", "ol", "p"), lambda e: e.count("a") >= 5 and e.length() <= 250 and internal(e) >= 5 and home(e) and bare(e)),
        ("menu container", ("div", "ul", "ol"), lambda e: menu(e) and not e.first("h1", "h2", "h3") and e.length() <= 200 and internal(e) >= 3),
        ("menu without links", ("div", "ul"), lambda e: menu(e) and not e.first("h1", "h2", "h3", "a") and e.count("li") >= 3 and e.length() <= 800),
        ("banner", ("div", "section"), lambda e: matches(r"(?i)banner|swiper|slide")(e) and not e.first("h1", "h2", "h3", "a") and 1 <= e.length() <= 300),
        ("builder header", ("div", "section"), lambda e: matches(r"(?i)head|top-?bar|logo")(e) and not e.first("h1", "h2", "h3") and e.length() <= 200 and bare(e)),
        ("service bar", ("div", "ul"), lambda e: matches(r"(?i)service|kefu|contact-bar|float")(e) and not e.first("h1", "h2", "h3") and bare(e)),
        ("site menu", ("div", "ul"), lambda e: e.first("h6") is not None and home(e) and bare(e)),
        ("footer", ("div", "section"), lambda e: matches(r"(?i)foot|bottom")(e) and bare(e) and e.length() < 2000),
    )


def strip_navigation(html: str, url: str = "") -> str:
    """The page without breadcrumbs, pagers, menus, banners and footers that a template left."""
    root = parse(html)
    for _, tags, test in _navigation_rules(url):
        for e in root.elements() if tags is None else root.all(*tags):
            if e.tag not in ("html", "body", "article", "main") and e.attached(root) and test(e):
                e.remove()
    return root.html()


def template(body: str, title: str, levels: list[str], url: str, time: str) -> str:
    """A whole document around a body."""
    from html import escape as e

    crumbs = " &gt; ".join(map(e, levels))
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{e(title)}</title></head>\n<body>\n<h1>{e(title)}</h1>\n<nav>{crumbs}</nav>\n<p><a href="{e(url)}">{e(url)}</a> {e(time)}</p>\n{body}\n</body></html>'


def clean_page(html: str, url: str) -> dict:
    """One page through the whole cleaning: html, text, title, images."""
    root = parse(html)
    strip_noise(root)
    strip_frame(root)
    strip_sides(root)
    if root.count("img") < 20:
        strip_metadata(root)
    part = by_score(root)
    strip_position_styles(part)
    strip_link_lists(part)
    drop_empty(part)
    rescue_images(part, url)
    images = absolute(part, url)
    return {"html": part.html(), "text": part.text(), "images": images}


# --- Fixed values: the limits of extraction rules ---
RULE_PURPOSES = ("content", "title", "image", "remove")
RULE_FORBIDDEN = ("script", "javascript", "eval", "import", "exec", "onerror", "onclick", "onload", "expression(", "url(", "@import", "<", "{", "}", ";", "\\", "`", "$(", "document.")


def rule_faults(rules: list[tuple[str, str]]) -> list[str]:
    """What is wrong with (selector, purpose) rules; nothing if they may be applied."""
    out = [] if rules else ["no rules"]
    for selector, purpose in rules:
        low = (selector or "").strip().lower()
        if not low or len(low) > 500:
            out.append("selector is empty or too long")
        out += [f"forbidden: {t}" for t in RULE_FORBIDDEN if t in low]
        if purpose not in RULE_PURPOSES:
            out.append(f"unknown purpose: {purpose}")
        if purpose == "remove" and low in ("html", "body", "*"):
            out.append("removes the whole page")
    return out


def extract_by_rules(html: str, url: str, rules: list[tuple[str, str]]) -> dict:
    """Title, content and images by selectors; the first content of over 50 characters counts."""
    from pagemill.functions.tree import select

    root, of = parse(html), {p: [s for s, q in rules if q == p] for p in RULE_PURPOSES}
    for s in of["remove"]:
        for e in select(root, s):
            e.remove()
    part = next((e for s in of["content"] for e in select(root, s) if e.length() > 50), None)
    title = next((e.text() for s in of["title"] for e in select(root, s) if e.text()), "")
    if part is None:
        return {"title": title, "html": "", "images": 0}
    absolute(part, url)
    images = sum(len(select(part, s)) for s in of["image"]) if of["image"] else part.count("img")
    return {"title": title, "html": part.html(), "images": images}
