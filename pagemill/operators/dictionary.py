"""Joins of texts with a dictionary by substring: of the patterns that a text contains, the first.

The patterns make an Aho-Corasick automaton, so a text is read once however many there are. Patterns
are sent to the tasks in parts of ``PART`` characters at most; a dictionary of more parts takes a pass
a part, and the least place of all counts. The driver holds the patterns, never texts.

Of patterns contained the one with the smallest (``order``, pattern) wins. Null and empty patterns match
nothing; a null text contains none. Repeated patterns count with their first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns in one automaton.
PART = 8_000_000


def first_match(rows: DataFrame, text: Column, patterns: DataFrame, pattern: str, order: str, part: int = PART) -> DataFrame:
    """``rows`` with ``match``, the first pattern that ``text`` contains, null where there is none."""
    spark = rows.sparkSession
    known = patterns.where(F.col(pattern).isNotNull() & (F.col(pattern) != "")).groupBy(F.col(pattern).alias("p")).agg(F.min(order).alias("o"))
    parts, size = [[]], 0
    for i, p in enumerate(r["p"] for r in known.orderBy("o", "p").toLocalIterator()):
        if size + len(p) > part and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((i, p))
        size += len(p)
    out = rows.withColumn("_text", text)
    fields = T.StructType([*[T.StructField(f.name, f.dataType) for f in out.schema.fields], T.StructField("_at", T.LongType()), T.StructField("_found", T.StringType())])
    for k, some in enumerate(parts):
        sent = spark.sparkContext.broadcast(some)
        out = out.mapInArrow(_matcher(sent, k > 0), fields)
    return out.drop("_text", "_at").withColumnRenamed("_found", "match")


def _matcher(sent, again: bool):
    """A function of batches that adds the first match, or betters the one there is."""

    def each(batches):
        import ahocorasick
        import pyarrow as pa

        machine = ahocorasick.Automaton()
        for i, p in sent.value:
            machine.add_word(p, (i, p))
        if len(machine):
            machine.make_automaton()
        for b in batches:
            at, found = ([None] * b.num_rows, [None] * b.num_rows) if not again else (b.column("_at").to_pylist(), b.column("_found").to_pylist())
            if len(machine):
                for k, text in enumerate(b.column("_text").to_pylist()):
                    if text and (at[k] is None):  # earlier parts hold smaller places
                        best = min((v for _, v in machine.iter(text)), default=None)
                        if best is not None:
                            at[k], found[k] = best
            names = [n for n in b.schema.names if n not in ("_at", "_found")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(at, pa.int64()), pa.array(found, pa.string())], [*names, "_at", "_found"])

    return each
