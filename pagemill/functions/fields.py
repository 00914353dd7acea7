"""Fields of a page tree: titles, dates, breadcrumbs, links, menus, company names."""

from __future__ import annotations

import re

from pagemill.functions import values as V
from pagemill.functions.tree import Node, classed, matches
from pagemill.functions.urls import join


def title_tag(root: Node) -> str:
    e = root.first("title")
    return "".join(e.strings()).strip() if e is not None else ""


def heading(root: Node) -> str:
    """The first heading outside header and nav, else the title, else any h1."""
    for tag in ("h1", "h2", "h3", "h4"):
        for e in root.all(tag):
            if not e.inside("header", "nav") and e.text(""):
                return e.text("")[:300]
    h1 = root.first("h1")
    return (title_tag(root) or (h1.text("") if h1 is not None else ""))[:300]


def page_title(root: Node) -> str:
    """A first h1 of two characters at least, an element classed as title, the title."""
    h1 = root.first("h1")
    if h1 is not None and len(h1.text("")) >= 2:
        return h1.text("")
    named = next((e.text("") for e in root.where(classed(V.TITLE_CLASS))), "")
    return named or title_tag(root)


def charset(root: Node) -> str:
    metas = root.all("meta")
    for e in metas:
        if "charset" in e.attrs:
            return e.get("charset") or "utf-8"
    for e in metas:
        if re.search("(?i)content-type", e.get("http-equiv")):
            m = re.search(r"(?i)charset=([^\s;]+)", e.get("content"))
            if m:
                return m[1]
    return "utf-8"


def publish_text(root: Node) -> str:
    """Where a page tells its date: a time element, an element classed so, or the text."""
    e = root.first("time")
    if e is not None:
        return e.get("datetime") or e.text("")
    named = next(iter(root.where(classed(V.TIME_CLASS))), None)
    return named.text("") if named is not None else root.text("")


def crumbs(root: Node) -> list[str]:
    """The links of the breadcrumb, and its last plain item, without the home page."""
    for word in V.BREADCRUMB_CLASSES:
        test = re.compile(word, re.I)
        found = next(iter(root.where(classed(f"(?i){word}"))), None) or next(iter(root.where(lambda e, t=test: t.search(e.get("id")) or t.search(e.get("aria-label")))), None)
        if found is None:
            continue
        items = [t for t in (a.text("") for a in found.all("a")) if t and t not in V.HOME_NAMES]
        spans = found.all("span")
        last = spans[-1].text("") if spans else ""
        if last and last not in (*V.HOME_NAMES, ">") and last not in items:
            items.append(last)
        if items:
            return items
    return []


def crumb_levels(root: Node) -> list[str]:
    """The levels that a breadcrumb's text names, prefixes up to a colon and the home page left out."""
    for e in [*root.where(classed(V.CRUMB_CLASS)), *root.where(lambda e: re.search(V.CRUMB_ID, e.get("id")))]:
        text = e.text()
        if len(text) < 5:
            continue
        parts = [re.sub(r"^.*[：:]\s*", "", p.strip()).strip() for p in re.split(r"\s*[>＞»→/|]\s*", text)]
        parts = [p for p in parts if p and len(p) <= 50 and not re.match(r"^(网站)?(首页|主页|Home|HOME)$", p)]
        if parts:
            return parts
    return []


def links(root: Node, url: str) -> list[tuple[str, str]]:
    """(absolute URL, text up to 50 characters) of every anchor that leads to a page."""
    out = []
    for a in root.all("a"):
        href = a.get("href").strip()
        if href and not href.lower().startswith(("javascript:", "mailto:", "tel:", "ftp:", "#")):
            out.append((join(url, href), a.text("")[:50]))
    return out


def other_links(root: Node, html: str, url: str) -> list[str]:
    """Links besides anchors: canonical, frames, areas, and hrefs in the source."""
    found = [e.get("href") for e in root.all("link") if e.get("rel") == "canonical"]
    found += [e.get("src") for e in root.all("iframe", "frame")] + [e.get("href") for e in root.all("area")]
    found += re.findall(r"""href\s*=\s*["']([^"'#]+)["']""", html or "")
    return list(dict.fromkeys(join(url, h) for h in found if h.strip() and not h.strip().lower().startswith(tuple(V.SKIP_SCHEMES))))


def paging(root: Node, url: str) -> list[tuple[str, str]]:
    """(URL, label) of pages that scripts turn: by a page count and a pattern, else by click handlers."""
    total = 0
    for e in root.all("input"):
        if e.get("totalpage").strip().isdigit():
            total = int(e.get("totalpage"))
            if total > 1:
                break
    out: dict[str, str] = {}
    if total > 1:
        for a in root.all("a"):
            m = re.match(r"^(.+?)(\d+)(\.html?)$", a.get("tagname").strip())
            for p in range(1, total + 1) if m else ():
                out.setdefault(join(url, f"{m[1]}{p}{m[3]}"), f"分页-{p}")
    if not out:
        box = next(iter(e for e in root.all("div") if re.search("(?i)pag", e.get("class"))), None)
        for a in box.all("a") if box is not None else ():
            m = re.search(r"""['"]([^'"]*\.html?[^'"]*)['"]""", a.get("onclick"))
            if m:
                out.setdefault(join(url, m[1].strip()), a.text("")[:20])
    return list(out.items())


def _menus(root: Node) -> list[Node]:
    boxes = root.all("nav") + [e for e in root.all("header") if e.first("nav") is None]
    return boxes + root.where(lambda e: e.tag in ("div", "ul") and matches(r"(?i)nav|menu")(e))


def menu_links(root: Node, url: str, nested: bool = False, most: int = 4) -> list[tuple[str, str, list[str], int]]:
    """(URL, text, path, depth) of the links in navigation, each URL once; all anchors where there is no navigation.

    As defined, list items are not descended into, so all depths are 1; ``nested`` follows sub-menus to ``most`` levels.
    """
    out: dict[str, tuple] = {}

    def walk(items: list[Node], path: list[str], depth: int):
        for li in items:
            a = li if li.tag == "a" else li.first("a")
            if a is None or not a.get("href").strip():
                continue
            name = a.text("")
            out.setdefault(join(url, a.get("href")), (join(url, a.get("href")), name, [*path, name], depth))
            if nested and li.tag == "li" and depth < most:
                walk([x for u in li.all("ul", "ol")[:1] for x in u.children if isinstance(x, Node) and x.tag == "li"], [*path, name], depth + 1)

    for box in _menus(root):
        lists = [box] if box.tag in ("ul", "ol") else [c for c in box.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        items = [x for u in lists for x in u.children if isinstance(x, Node) and x.tag == "li"] or box.all("a")
        walk(items, [], 1)
    if not out:
        walk((root.first("body") or root).all("a"), [], 1)
    return list(out.values())


def menu_prefixes(root: Node, url: str) -> list[tuple[str, str]]:
    """(name, path prefix) of the top-level navigation on the page's own host, each prefix once."""
    from urllib.parse import urlsplit

    box = next(iter(root.where(lambda e: e.tag in ("nav", "div", "ul") and re.search("nav|menu", e.names().lower()))), None) or root.first("body") or root
    top = box if box.tag in ("ul", "ol") else box.first("ul", "ol")
    items = [c for c in (top or box).children if isinstance(c, Node) and c.tag in ("li", "div", "span", "p", "a")]
    out: dict[str, str] = {}
    host = urlsplit(url).netloc.lower()
    for li in items:
        a = li if li.tag == "a" else li.first("a")
        name, href = (a.text(""), a.get("href").strip()) if a is not None else ("", "")
        if not name or not href or name in V.HOME_NAMES or len(name) > 20 or href.startswith(("javascript:", "mailto:", "tel:", "#")):
            continue
        part = urlsplit(join(url, href))
        if part.netloc.lower() == host:
            out.setdefault(part.path.rstrip("/") or "/", name)
    return [(n, p) for p, n in out.items()]


# --- Fixed values: company names ---
COMPANY_WORDS = r"[\w一-鿿（）()·&\- ]{2,40}?(?:有限公司|股份公司|集团|公司|Co\., ?Ltd\.?|Inc\.?|Corp\.?|GmbH|LLC)"
TITLE_BREAKS = ("|", "_", "-", "—", "–", "·")
LOGO_WORDS = ("logo", "图片", "image", "首页", "home")


def company(root: Node, host: str) -> str:
    """A site's company by the first that tells one: title, description, keywords, logo, footer, heading, host."""
    title = title_tag(root)
    for mark in TITLE_BREAKS:
        if mark in title:
            head = title.split(mark)[0].strip()
            if 2 <= len(head) <= 50 and head not in V.HOME_NAMES:
                return head
            break
    if 2 <= len(title) <= 50 and title not in V.HOME_NAMES:
        return title
    meta = {(e.get("name") or e.get("property")).lower(): e.get("content") for e in root.all("meta")}
    for name in ("description", "og:description"):
        m = re.search(COMPANY_WORDS, meta.get(name, ""))
        if m:
            return m[0].strip()
    word = re.split("[,，;；]", meta.get("keywords", ""))[0].strip()
    if 2 <= len(word) <= 30:
        return word
    for e in root.where(lambda e: "logo" in e.names().lower()):
        said = e.get("alt") or next((i.get("alt") for i in e.all("img") if i.get("alt")), "") or e.text("")
        if 2 <= len(said) <= 30 and said.lower() not in LOGO_WORDS:
            return said
    foot = root.first("footer")
    m = re.search(r"(?:©|版权所有|Copyright)\s*(?:\d{4}(?:-\d{4})?)?\s*([^\d\s|。.,，][^|。，,\n]{1,29})", foot.text() if foot is not None else "")
    if m:
        return m[1].strip()
    for e in root.all("h1", "h2"):
        m = re.search(COMPANY_WORDS, e.text(""))
        if m:
            return m[0].strip()
    return re.sub(r"^www\.", "", host).split(".")[0]
