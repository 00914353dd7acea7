"""Images: embedding of fetched image bytes into pages.

``blobs``: url, content binary, content_type, status. What stays: bytes that are an image of a known
type up to ``LARGEST``; small square icons and pictures that many pages repeat are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.functions import values as V
from pagemill.functions.pages import TOGETHER
from pagemill.functions.urls import any_of
from pagemill.operators import chunks

LARGEST, SMALL, REPEATS = 2_097_152, 30_000, 5


def usable(blobs: DataFrame) -> DataFrame:
    """(url, data_uri): one row per image that may be embedded."""
    rows = blobs.where((F.col("status") == 200) & F.col("content").isNotNull() & (F.length("content") <= LARGEST) & ~rules.looks_like_html(F.col("content")))
    size = rules.image_size(F.col("content"))
    icon = rules.squarish(size["width"], size["height"]) & (F.length("content") < SMALL) & any_of(F.lower("url"), V.IMAGE_BLOCK_WORDS)
    rows = rows.withColumn("mime", rules.mime(F.col("content_type"), F.col("url"))).where((F.col("mime") != "") & ~F.coalesce(icon, F.lit(False)))
    return rows.groupBy("url").agg(F.min(rules.data_uri(F.col("content"), F.col("mime"))).alias("data_uri"))


def references(parsed: DataFrame, blobs: DataFrame) -> DataFrame:
    """(page_id, pos, url, embed): the images of pages; the same bytes from the fifth time on are decoration.

    Counting is per content hash in order of page and place, in chunks where very many pages share
    one. Images without bytes are dealt out by page.
    """
    each = parsed.select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", F.col("i.url").alias("url"), F.col("i.alt").alias("alt"))
    hashed = each.join(blobs.select("url", F.md5("content").alias("md5")).dropDuplicates(["url"]), "url", "left")
    hashed = chunks.numbered(hashed.withColumn("_page", F.when(F.col("md5").isNull(), F.col("page_id"))), ["md5", "_page"], ["page_id", "pos"], "_seen")
    fresh = F.col("md5").isNull() | (F.col("_seen") < REPEATS)
    return hashed.withColumn("embed", fresh & rules.embeds(F.col("url"), F.col("alt"))).select("page_id", "pos", "url", "embed")


def embedded(pages: DataFrame, parsed: DataFrame, blobs: DataFrame) -> DataFrame:
    """(page_id, html, ok, failed): pages with their images as data URIs; images that cannot be are removed.

    ``pages``: page_id, url, html. ``parsed``: page_id, images.
    """
    wanted = references(parsed, blobs)
    found = wanted.where("embed").join(usable(blobs), "url", "left")
    given = found.groupBy("page_id").agg(F.collect_list(F.struct("url", "data_uri")).alias("given"))

    def put(batches):
        import pyarrow as pa

        from pagemill.functions.content import image_source
        from pagemill.functions.tree import parse
        from pagemill.functions.urls import join

        for part in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            out = []
            for url, html, pairs in zip(*(part.column(c) for c in ("url", "html", "given"))):
                have = {p["url"]: p["data_uri"] for p in pairs.as_py() or ()}
                root, ok, failed = parse(html.as_py()), 0, 0
                for img in root.all("img"):
                    src = join(url.as_py() or "", image_source(img))
                    if src not in have:
                        continue
                    if have[src]:
                        img.attrs["src"] = have[src]
                        ok += 1
                    else:
                        failed += 1
                        box = img.parent if img.parent is not None and img.parent.tag == "figure" else img
                        box.remove()
                out.append((root.html(), ok, failed))
            made = [pa.array(values, kind) for values, kind in zip(zip(*out), (pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), *made], ["page_id", "html", "ok", "failed"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(given, "page_id", "left").mapInArrow(put, "page_id long, html string, ok int, failed int")


def overridden(fetched: DataFrame, media: DataFrame, key: str = "key") -> DataFrame:
    """Fetched rows with those of ``media`` in their place where there are any; media rows of no fetched page are added.

    ``replaced`` says which rows come from ``media``. Of several media rows of a key any one may count.
    """
    rest = [c for c in fetched.columns if c != key]
    other = media.select(key, F.struct(*rest).alias("_media")).dropDuplicates([key])
    both = fetched.select(key, F.struct(*rest).alias("_row")).join(other, key, "full")
    return both.select(key, F.coalesce("_media", "_row").alias("_r"), F.col("_media").isNotNull().alias("replaced")).select(key, "_r.*", "replaced")


def missing(rescued: DataFrame, cleaned: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """The images that rescue found and cleaning lost: rescued rows whose (page, source) is not among the cleaned."""
    return rescued.join(cleaned.select(page, url).distinct(), [page, url], "left_anti")
