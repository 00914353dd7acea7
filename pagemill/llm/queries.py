"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, chat_format, exact_dedup, languages, mixing, near_dedup, nearest, personal, quality, repair, sharding, token_counts, whitening
from pagemill.llm.common import crc_mod, tokenizer_file


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = languages.fit(docs.where(~held_out), tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return languages.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.turns(_read(spark, sf_dir, "conversations"), "conv_id")
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(chat_format.HOSTILE).alias("content")) for r in ("user", "assistant")])
    hostile = chat_format.turns(spark.range(-1, 0).select(F.col("id").alias("conv_id"), said.alias("messages")), "conv_id")
    return chat_format.digests(chat_format.formatted(rows.unionByName(hostile)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.select(_read(spark, sf_dir, "documents"), levels, F.floor(F.col("total") * mixing.SHARE), mixing.WEIGHTS, mixing.EPOCHS)
    return taken.select("row.doc_id", "epoch", "domain", "lang", "source", "n_tokens", "leaf_budget")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_read(spark, sf_dir, "documents"), F.col("doc_id"), sharding.SHARDS).select("row.doc_id", "slot", "shard")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _read(spark, sf_dir, "documents"), crc_mod("doc_id", 3) == 1
    forest = quality.fit(docs, _read(spark, sf_dir, "labels").where(~held_out))
    return quality.predict(docs, forest, [F.col("doc_id"), held_out.alias("held_out")])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), [F.col("doc_id")], decoded=True)
    return got.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find(_read(spark, sf_dir, "documents"), [F.col("doc_id")]))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), [F.col("doc_id")])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(_read(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whitening.whiten(_read(spark, sf_dir, "embeddings"), "embedding", [F.col("vec_id")])
    return got.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_mixing, op4_sharding, op5_exact_dedup, op6_quality, op7_bpe, op8_near_dedup, op9_personal, op10_nearest, op11_token_counts, op12_conversation_repair, op13_whitening)}
ORACLE_SQL = {"op2_chat_format": chat_format.ORACLE, "op3_mixing": mixing.ORACLE, "op4_sharding": sharding.oracle(), "op5_exact_dedup": exact_dedup.ORACLE, "op12_conversation_repair": repair.ORACLE}
