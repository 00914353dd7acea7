"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, a permutation given by
its name. Shards take turns claiming their most preferred free slot until the table is full; a
shard of weight w claims w slots a turn. A row's key is hashed to a slot, and the broadcast table
gives its shard: one look-up, no shuffle, and few keys move when a shard comes or goes.

The table has a fixed number of entries (``SLOTS``), whatever the data. Null keys count as empty
text, so they share a slot; empty tables give empty results; other columns are never touched.
``spread`` deals the rows of each shard over several tasks, so a shard that holds many rows of
one key is written by many tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and over 100 times the number of shards, which keeps shares within about 1 %.
SLOTS = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime, no smaller than the number of shards")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, and one must be positive")
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % slots for s in shards]
    step = [number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i, claims in enumerate(turns):
            for _ in range(min(claims, free)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                table[at[i]] = i
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as (slot, shard) rows, made from one literal."""
    listed = F.split(F.lit(" ".join(map(str, table))), " ")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """(row struct, slot, shard): each row of ``df`` with its place."""
    table = table_frame(df.sparkSession, lookup_table(shards, slots, weights))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot_of(key, slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("row", "slot", "shard")


def spread(placed: DataFrame, parts_per_shard: int = 8) -> DataFrame:
    """Rows repartitioned by shard, each shard over ``parts_per_shard`` keys by the whole row."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts_per_shard))
    return placed.withColumn("part", part).repartition(F.col("shard"), F.col("part"))


def write(df: DataFrame, key: Column, shards: list[str], path: str, parts_per_shard: int = 8, **options) -> None:
    """Writes ``df`` as Parquet below ``path``, a folder per shard."""
    flat = spread(place(df, key, shards, **options), parts_per_shard).select("row.*", F.col("shard").alias("_shard"))
    flat.write.partitionBy("_shard").parquet(path)


#: The query's shards.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def oracle() -> str:
    table = ", ".join(map(str, lookup_table(SHARDS)))
    return f"""
WITH t AS (SELECT [{table}] AS shards),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, t.shards[slot + 1]::INTEGER AS shard FROM d, t
"""
