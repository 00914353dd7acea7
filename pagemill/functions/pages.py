"""The one Python stage over pages: each page's tree is built once, and all asked of it is returned.

``parse_pages`` takes (key columns, url, html) and the names of the fields wanted; nothing that is
not wanted is computed. Null html gives the fields of an empty page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from pagemill.functions import content, fields, values
from pagemill.functions.tree import classed, parse

#: Pages whose fields are held at one time, and bytes of input that they may have unless it is one page.
TOGETHER, BYTES = 64, 1 << 20

S, L, B = T.StringType(), T.IntegerType(), T.BooleanType()
_LINK = T.ArrayType(T.StructType([T.StructField("url", S), T.StructField("text", S)]))


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _body(root):
    return root.first("body") or root


def _clean(root, html, url):
    got = content.clean_page(html, url)
    return (got["html"], got["text"], got["images"])


def _main(root, html, url):
    other = parse(html)
    content.strip_noise(other)
    part = content.main_content(other)
    return (part.tag, part.names(), part.text())


def _rescued(root, html, url):
    other = parse(html)
    count = content.rescue_images(other, url)
    return (other.html(), *count.values())


#: Each field: its type and what gives it from (root, html, url).
FIELDS = {
    "title": (S, lambda r, h, u: fields.title_tag(r)),
    "heading": (S, lambda r, h, u: fields.heading(r)),
    "page_title": (S, lambda r, h, u: fields.page_title(r)),
    "charset": (S, lambda r, h, u: fields.charset(r)),
    "text": (S, lambda r, h, u: r.text()),
    "text_length": (L, lambda r, h, u: r.length()),
    "body_length": (L, lambda r, h, u: _body(r).length()),
    "hrefs": (L, lambda r, h, u: sum(bool(a.get("href")) for a in r.all("a"))),
    "body_anchors": (L, lambda r, h, u: sum("href" in a.attrs for a in _body(r).all("a"))),
    "pager_class": (B, lambda r, h, u: bool(r.where(classed(values.PAGER_CLASS)))),
    "publish_text": (S, lambda r, h, u: fields.publish_text(r)),
    "crumbs": (T.ArrayType(S), lambda r, h, u: fields.crumbs(r)),
    "crumb_levels": (T.ArrayType(S), lambda r, h, u: fields.crumb_levels(r)),
    "links": (_LINK, lambda r, h, u: fields.links(r, u)),
    "other_links": (T.ArrayType(S), lambda r, h, u: fields.other_links(r, h, u)),
    "paging": (_LINK, lambda r, h, u: fields.paging(r, u)),
    "menu": (T.ArrayType(_struct(url=S, text=S, path=T.ArrayType(S), depth=L)), lambda r, h, u: fields.menu_links(r, u)),
    "menu_nested": (T.ArrayType(_struct(url=S, text=S, path=T.ArrayType(S), depth=L)), lambda r, h, u: fields.menu_links(r, u, True)),
    "menu_prefixes": (T.ArrayType(_struct(name=S, prefix=S)), lambda r, h, u: fields.menu_prefixes(r, u)),
    "company": (S, lambda r, h, u: fields.company(r, (u or "").split("//")[-1].split("/")[0])),
    "images": (T.ArrayType(_struct(url=S, alt=S)), lambda r, h, u: content.collect_images(r, u)),
    "blocks": (T.ArrayType(_struct(pre=L, post=L, tag=S, names=S, text_length=L, paragraphs=L, images=L, links=L, score=T.DoubleType())), lambda r, h, u: [tuple(b.values()) for b in content.blocks(r)]),
    "rescued": (_struct(html=S, total=L, path_fixed=L, lazy_fixed=L, css_extracted=L, antihotlink=L), _rescued),
    "clean": (_struct(html=S, text=S, images=L), _clean),
    "main": (_struct(tag=S, names=S, text=S), _main),
    "structured": (S, lambda r, h, u: content.structured_body(h, u)),
    "denavigated": (S, lambda r, h, u: content.strip_navigation(h, u)),
}


def schema_of(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, FIELDS[n][0]) for n in names])


def small(batches):
    """Arrow batches, which may be of ten thousand pages or 64 MB, in parts of few pages and bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, TOGETHER)
            while part.nbytes > BYTES and part.num_rows > 1:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part


def parse_pages(pages: DataFrame, keep: list[Column], names: list[str], url: Column, html: Column, ended: bool = False) -> DataFrame:
    """``keep`` with the named fields, one row per page; ``ended`` as for ``tree.parse``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    unknown = set(names) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    source = pages.select(*keep, url.alias("__url"), html.alias("__html"))
    kept = source.drop("__url", "__html")
    schema = T.StructType([*kept.schema.fields, *schema_of(names).fields])
    wanted, columns = {n: FIELDS[n][1] for n in names}, kept.columns
    types = to_arrow_schema(schema)

    def each(batches):
        for part in small(batches):
            out = {n: [] for n in wanted}
            for u, h in zip(part.column("__url"), part.column("__html")):
                u, h = u.as_py() or "", h.as_py() or ""
                root = parse(h, ended)
                for n, f in wanted.items():
                    value = f(root, h, u)
                    kind = types.field(n).type
                    out[n].append(_as(value, kind))
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(types.field(c).type) for c in columns), *(pa.array(out[n], types.field(n).type) for n in wanted)], schema=types)

    return source.mapInArrow(each, schema)


def extract_by_rules(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """(key, title, html, images) by (selector, purpose) rules, which are checked first; faulty ones raise ValueError."""
    faults = content.rule_faults(rules)
    if faults:
        raise ValueError("; ".join(faults))

    def each(batches):
        for b in batches:
            got = [content.extract_by_rules(h, u or "", rules) for u, h in zip(b["url"], b["html"])]
            yield b[[key]].assign(**{k: [g[k] for g in got] for k in ("title", "html", "images")})

    schema = T.StructType([pages.schema[key], *_struct(title=S, html=S, images=L).fields])
    return pages.select(key, "url", "html").mapInPandas(each, schema)


def _as(value, kind):
    """Tuples as the records that Arrow wants."""
    import pyarrow as pa

    if pa.types.is_list(kind):
        return [_as(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {kind.field(i).name: _as(v, kind.field(i).type) for i, v in enumerate(value)}
    return value
