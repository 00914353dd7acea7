"""Exact dedup by 128-bit content hash, with a comparison of bytes inside the groups.

Rows without text count as empty texts. Texts are equal when they are identical after runs of
white space became one space. A row without id yields to every row with one. Of repeated rows
(same id, same text) exactly one stays. Empty tables give empty results; columns beside id and
text are never read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Work, ident, maybe_in, squeezed, told_apart

#: Copies of one text are dealt out by so many salts before they meet.
SALTS = 64


def content_hash(text):
    """128 bits of the text with squeezed white space."""
    return F.unhex(F.md5(squeezed(text)))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    For the rows only ids and hashes are shuffled. Texts are looked at again only where a hash
    occurs more than once, found by their ids, and shuffled once per task and distinct text:
    grouping by the text itself compares bytes. Should two texts share a hash, classes are told
    apart by hash and SHA-256.
    A hot group is spread over ``salts`` keys in every exchange of rows.
    """
    work = Work(docs.sparkSession, "exact")
    keyed = docs.select(F.col(id_col).alias("doc_id"), squeezed(text_col).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    slim = work.table(
        keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("uid"))
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")),
        "slim",
    )

    def groups(by: list[str]) -> DataFrame:
        """The groups of several rows, with the row that stays: the smallest id, null ids last."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
        part = slim.groupBy(*by, "salt").agg(first, F.count("*").alias("n"))
        return part.groupBy(*by).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")

    key = ["h"]
    found = work.table(groups(key), "groups")
    copied = slim.join(found.select("h", F.explode("salts").alias("salt")), ["h", "salt"]).select(ident("doc_id").alias("ident"))
    copied = work.table(copied.distinct(), "copied")
    texts = maybe_in(docs.select(ident(id_col).alias("ident"), F.col(text_col).alias("text")), F.col("ident"), copied, F.col("ident"))
    texts = texts.select(squeezed("text").alias("norm")).groupBy("norm").agg(F.count("*").alias("n")).select(F.md5("norm").alias("h"))
    if not texts.groupBy("h").count().where("count > 1").isEmpty():
        key = ["h", "sha"]
        found = work.table(groups(key), "groups")
    shared = found.select(*key, F.explode("salts").alias("salt"), F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"), "n")
    alone = F.col("n").isNull()
    return slim.join(shared, [*key, "salt"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that ``classes`` drops."""
    return keep_rows(docs, classes(docs, id_col, text_col).select("doc_id", F.unhex("text_sha256").alias("key"), "kept"), F.col(id_col), F.unhex(F.sha2(squeezed(text_col), 256)))


def keep_rows(docs: DataFrame, decided: DataFrame, doc_id, key) -> DataFrame:
    """The rows of ``docs`` that stay by ``decided`` (doc_id, key, kept: one row per row of docs).

    Rows are matched by id and key, null ids with null ids. Only rows that by a bitmap of ids may
    match a dropped one get a key and are joined, so the others are not shuffled; where id and key
    repeat, as many rows stay as were kept.
    """
    work = Work(docs.sparkSession, "keep")
    dropped = work.table(
        decided.groupBy("doc_id", "key").agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows")).where("stay < rows"), "dropped"
    )
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    doubtful, sure = told_apart(docs, text, dropped, ident("doc_id"))
    sure = sure.select(*[F.col(f"`{c}`") for c in docs.columns])
    row = doubtful.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("doc_id"), key.alias("key"))
    gone = dropped.where("stay = 0").select("doc_id", F.col("key").alias("k"))
    left = row.join(gone, row["doc_id"].eqNullSafe(gone["doc_id"]) & (row["key"] == gone["k"]), "left_anti")
    some = dropped.where("stay > 0")
    if some.isEmpty():
        return sure.unionByName(left.select("row.*"))
    some = some.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "stay")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(0)))
    joined = left.join(some, left["doc_id"].eqNullSafe(some["d"]) & (left["key"] == some["k"]), "left")
    return sure.unionByName(joined.where("stay is null").select("row.*")).unionByName(joined.where("stay is not null").withColumn("nth", nth).where("nth <= stay").select("row.*"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
