"""Cutting the lineage of a frame by a table in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.sources.places import shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written below the session's checkpoint folder and read back: computed once, and safe from lost executors."""
    path = shared(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
