"""Table functions for SQL: a page's links, paging links, menu, images, blocks and record, called by LATERAL.

``register`` gives them to a session; then one statement does what tools ask of pages, with no
DataFrame code::

    SELECT p.page_id, l.* FROM parquet.`/data/pages.parquet` p, LATERAL page_links(p.html, p.url) l

``analyze`` checks a call's arguments when the statement is parsed. Null pages give the rows of an
empty one.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: The functions' names and the lists of fields that they give a row an entry of.
LISTS = {"page_links": "links", "page_paging_links": "paging", "page_menu": "menu", "page_images": "images", "page_blocks": "blocks"}
#: The fields of ``page_record``, one row a page.
RECORD = ["title", "heading", "charset", "text_length", "publish_text"]


def _checked(html: AnalyzeArgument, url: AnalyzeArgument) -> None:
    for name, argument in (("html", html), ("url", url)):
        if argument.isTable or not isinstance(argument.dataType, StringType):
            raise ValueError(f"{name} must be a string")


def _of_list(field: str):
    """The table function that gives the entries of one list."""
    from pagemill.functions.pages import FIELDS

    entry = FIELDS[field][0].elementType
    schema = StructType([StructField("pos", IntegerType()), *entry.fields])
    names = [f.name for f in entry.fields]

    class Entries:
        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument) -> AnalyzeResult:
            _checked(html, url)
            return AnalyzeResult(schema)

        def eval(self, html: str, url: str):
            from pagemill.functions.pages import FIELDS
            from pagemill.functions.tree import parse

            for i, e in enumerate(FIELDS[field][1](parse(html or ""), html or "", url)):
                yield (i, *([e[n] for n in names] if isinstance(e, dict) else e))

    return udtf(Entries)


def _record():
    from pagemill.functions.pages import FIELDS, schema_of

    schema = StructType(schema_of(RECORD).fields)

    class Record:
        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument) -> AnalyzeResult:
            _checked(html, url)
            return AnalyzeResult(schema)

        def eval(self, html: str, url: str):
            from pagemill.functions.tree import parse

            root = parse(html or "")
            yield tuple(FIELDS[n][1](root, html or "", url) for n in RECORD)

    return udtf(Record)


def register(spark: SparkSession) -> list[str]:
    """Registers all table functions; their names."""
    for name, field in LISTS.items():
        spark.udtf.register(name, _of_list(field))
    spark.udtf.register("page_record", _record())
    return [*LISTS, "page_record"]
