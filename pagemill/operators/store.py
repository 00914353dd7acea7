"""A keyed table that is merged by rewriting only what changed.

Rows lie in buckets by a hash of their key; a manifest names each bucket's folder. A merge reads the
buckets that its writes touch, folds old and new rows, writes those buckets anew and puts a new
manifest in place. Other buckets are neither read nor written, so a merge costs what its writes touch.
Readers see the manifest before or after, never between: it is put in place by a rename that fails if
another merge was first, and then nothing of the later one counts (``Conflict``). Old versions can be
read until ``vacuum`` removes what no kept manifest names.

The fold must be one that can be repeated: folding a folded row with later writes gives what folding
all writes gives. ``cache.fold`` is such a one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another merge was put in place meanwhile; run this one again."""


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, fold: Callable[[DataFrame], DataFrame], buckets: int = 256):
        """``schema``: the columns of a stored row. ``fold`` takes rows of them with ``seq``, stored ones with -1."""
        self.spark, self.folder, self.key, self.fold, self.buckets = spark, folder.rstrip("/"), key, fold, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/manifest")
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; without any a table without rows."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": {}, "n": self.buckets}
        fs, p = self._fs(f"{self.folder}/manifest/v{version if version is not None else known[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(list(self.manifest(version)["buckets"].values()))

    def merge(self, writes: DataFrame) -> dict:
        """Folds writes (the stored columns and ``seq``) into the table; {version, touched, bytes} of what was written."""
        now = self.manifest()
        bucket = F.pmod(F.xxhash64(self.key), F.lit(now["n"])).cast("int")
        touched = sorted(r[0] for r in writes.select(bucket).distinct().collect())  # at most as many as buckets
        if not touched:
            return {"version": now["version"], "touched": 0, "bytes": 0}
        old = self._read([now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]])
        rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(writes.select(*self.schema.names, F.col("seq").cast("long")))
        version = now["version"] + 1
        data = f"data/v{version}-{uuid.uuid4().hex[:12]}"
        folded = self.fold(rows).select(*self.schema.names).withColumn("_bucket", bucket)
        folded.repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder}/{data}")
        named = now["buckets"] | {str(b): f"{data}/_bucket={b}" for b in touched}
        if not self._put(version, {"version": version, "buckets": named, "n": now["n"]}):
            self._drop(data)
            raise Conflict(f"version {version} of {self.folder} exists")
        fs, p = self._fs(f"{self.folder}/{data}")
        return {"version": version, "touched": len(touched), "bytes": int(fs.getContentSummary(p).getLength())}

    def _put(self, version: int, said: dict) -> bool:
        fs, part = self._fs(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(json.dumps(said).encode())
        out.close()
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/v{version}")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, none)
        except Exception as e:
            fs.delete(part, False)
            if fs.exists(target):
                return False
            raise e
        return True

    def _drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the newest ``keep`` versions and the folders that only they name; the number of folders removed.

        Run it when no merge is going on: one that is has written a folder that no manifest names yet.
        """
        known = self.versions()
        kept = {f.rsplit("/", 1)[0]: set() for v in known[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in known[-keep:]:
            for f in self.manifest(v)["buckets"].values():
                kept[f.rsplit("/", 1)[0]].add(f.rsplit("/", 1)[1])
        for v in known[:-keep]:
            self._drop(f"manifest/v{v}")
        n = 0
        fs, p = self._fs(f"{self.folder}/data")
        for merge in fs.listStatus(p) if fs.exists(p) else []:
            name = f"data/{merge.getPath().getName()}"
            if name not in kept:
                self._drop(name)
                n += 1
                continue
            for b in fs.listStatus(merge.getPath()):
                if b.isDirectory() and b.getPath().getName() not in kept[name]:
                    fs.delete(b.getPath(), True)
                    n += 1
        return n
