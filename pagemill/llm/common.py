"""What several operators share: work tables in the shared folder, key filters, white space."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of these operators define it.
SPACE = r"[\x20\x09-\x0D]"

_FOLDERS: dict[int, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own below ``spark.checkpoint.dir``.

    The setting is read from the session; only where it is unset (tests, a single machine)
    a local folder is used. The folder is removed when the driver ends.
    """
    key = id(spark.sparkContext)
    if key not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            root = "/tmp/checkpoints"
            spark.sparkContext.setCheckpointDir(root)
        _FOLDERS[key] = (spark, f"{root.rstrip('/')}/pagemill-{uuid.uuid4().hex}")
        atexit.register(_remove, spark, _FOLDERS[key][1])
    return _FOLDERS[key][1]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already
        pass


def released(function):
    """``function`` of batches, after whose last one the worker hands freed memory back to the system.

    Spark keeps Python workers for the stages that follow, in which what they once needed would count.
    """

    def each(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return each


class Work:
    """Tables of one operator call, written to the shared folder and read back.

    A written table cuts the lineage and survives lost executors. ``drop`` removes tables
    that nothing reads any more, so that disk use follows the largest step.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _remove(self.spark, t._work_path)

    def close(self) -> None:
        """Removes all tables of this call."""
        _remove(self.spark, self.folder)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of fewer rows and bytes than Spark's default, as texts can be long.

    Frames are run after the operator has returned, so both settings stay on the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on the driver; executors get its contents by broadcast."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def share_of(df: DataFrame, key: Column, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows, those of the smallest hashes of a key: nothing is sorted or gathered for it."""
    if total <= most:
        return df
    return df.where(F.pmod(key, F.lit(1 << 40)) < F.lit(int((1 << 40) * (most / total))))


def squeezed(text: Column | str) -> Column:
    """Text (null: empty) with every run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE + "+", " ")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def free_names(kept: DataFrame, *added: str) -> None:
    """Raises ValueError where columns to keep have a name that the operator gives to its own; a struct of them has none of these."""
    clash = sorted({*kept.columns} & {*added})
    if clash or len({*kept.columns}) < len(kept.columns):
        raise ValueError(f"columns to keep must be renamed or put in a struct: {clash or kept.columns}")


def ident(column: str) -> Column:
    """An id as text, null ids alike."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: One row of a key bitmap holds so many bits; Spark's bitmap functions fix the number.
_BUCKET = 32768


def _placed(df: DataFrame, key: Column, keys: DataFrame, keys_column: Column, most_bits: int) -> tuple[DataFrame, DataFrame, Column]:
    """``df`` as (row, p, bucket), the bitmap of ``keys`` by bucket, and whether the bit of a joined row is set."""
    bits = min(most_bits, max(1 << 20, 1 << (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmap = (
        keys.where(keys_column.isNotNull())
        .select(place(keys_column).alias("p"))
        .groupBy(F.floor(F.col("p") / _BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("bits"))
    )
    # Words of 32 bits, the bytes of each in the order of the bitmap.
    words = F.transform(F.sequence(F.lit(0), F.lit(_BUCKET // 32 - 1)), lambda i: F.conv(F.hex(F.substring("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    rows = df.select(F.struct("*").alias("row"), place(key).alias("p"), key.isNotNull().alias("keyed")).withColumn("bucket", F.floor(F.col("p") / _BUCKET))
    bit = F.expr("shiftright(element_at(words, int(p % 32768 div 32) + 1), int((3 - p % 32 div 8) * 8 + p % 8)) & 1") == 1
    return rows, F.broadcast(bitmap.select("bucket", words.alias("words"))), F.col("keyed") & bit


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_column: Column, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of ``df`` whose key can be among ``keys``: all that are, and few others.

    A bitmap of 16 positions per key is built and broadcast, never over ``most_bits / 4`` bytes
    (32 MB as given). It only spares a later exact step the rows that cannot match, so a crowded
    bitmap costs time, never results. Null keys match none. ``keys`` should be a written table. Follow
    with an inner join on distinct keys: a semi join would be moved below this filter.
    """
    rows, bitmap, found = _placed(df.where(key.isNotNull()), key, keys, keys_column, most_bits)
    return rows.join(bitmap, "bucket").where(found).select("row.*")


def told_apart(df: DataFrame, key: Column, keys: DataFrame, keys_column: Column, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """(rows whose key can be among ``keys``, the others), by the bitmap of ``maybe_in``; null keys are among the others."""
    rows, bitmap, found = _placed(df, key, keys, keys_column, most_bits)
    marked = rows.join(bitmap, "bucket", "left").withColumn("may", F.coalesce(found, F.lit(False)))
    return marked.where("may").select("row.*"), marked.where("not may").select("row.*")
