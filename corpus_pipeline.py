"""The corpus pipeline: five stages over documents, each of which its runner writes and reads again.

Every stage takes (spark, docs, sf_dir) and decides by the whole of what its predecessor kept:

1. language: documents without letters, without a clear language, or whose letters random bytes
   would explain better than any learned language, go.
2. exact_dedup: of equal texts the row with the smallest id stays.
3. near_dedup: of linked documents the one with the smallest id stays.
4. mixing: equal weights for domains, languages and sources; a budget of ``SHARE`` of the tokens,
   one epoch, so no document is repeated.
5. bpe: doc_id, lang, source, n_tokens and the ids of every document left.

All but the last return the columns of documents, added ones included, whatever their names. Whole
texts count in all of them. Null or blank texts go in stage 1; null languages and sources form
branches of their own in stage 4. A row without id yields to one with an id in stages 2 and 3; of
repeated rows one stays; unlike documents that share an id all stay. Ties in the order of stage 4 are
broken by tokens, and rows equal in both are taken one by one. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, exact_dedup, languages, mixing, near_dedup
from pagemill.llm.common import Work, tokenizer_file

CLEAR = 0.5
SHARE = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.fit(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    told = languages.predict(docs, model, [row])
    return told.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= CLEAR) & (F.col("fit") >= languages.UNIFORM)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.select(docs, levels, F.floor(F.col("total") * SHARE)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), [F.col("doc_id"), F.col("lang"), F.col("source")])
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]
#: Language models, signatures and BPE are not SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, work.table(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
