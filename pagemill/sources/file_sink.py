"""Files from rows, written once: tasks stage, the driver commits, tasks publish.

``write_files`` runs a job with a name. A task writes its rows as numbered files below
``_staging/<job>/<attempt>`` with a list of their final paths; one that fails removes what it wrote. The
commit is one small file with a line a task, put in place by a rename: before it nothing of the job is
visible, after it all of it counts. Publishing moves staged files to their paths, a task of Spark a task of
the job, and can be run again from any point: moved files are not there any more. A job that was
committed is never written again, so running it twice, or after a lost driver, leaves the files as they
are; ``recover`` publishes what a lost driver left committed.

The same sink takes streams: a micro-batch is a job, published in its commit.

Folders are addresses that pyarrow opens on every executor. Paths are relative and stay inside the
folder; others fail the job. Null texts are empty files; rows without a path are left out. Of rows with
one path the last published stays, so number them first (``categories.file_paths``).
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from pagemill.sources.places import opened, place_of

WRITTEN = "path string, bytes long, sha256 string"
FORMAT = "pagemill_files"


@dataclass
class Staged(WriterCommitMessage):
    """What a task reports: one folder, whatever it holds."""

    folder: str
    files: int
    bytes: int


def _inside(path: str) -> str:
    clean = posixpath.normpath(path)
    if path.startswith("/") or clean.startswith("..") or clean in ("", ".") or clean.split("/")[0] in ("_staging", "_jobs"):
        raise ValueError(f"not a path inside the folder: {path!r}")
    return clean


def _stage(folder: str, job: str, batches) -> Staged:
    fs, root = opened(folder)
    here = f"_staging/{job}/{uuid.uuid4().hex}"
    n, size = 0, 0
    fs.create_dir(f"{root}/{here}", recursive=True)
    try:
        with fs.open_output_stream(f"{root}/{here}/list") as names:
            for b in batches:
                for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if path is None:
                        continue
                    data = (text or "").encode()
                    with fs.open_output_stream(f"{root}/{here}/{n}") as f:
                        f.write(data)
                    names.write((json.dumps([n, _inside(path), len(data), hashlib.sha256(data).hexdigest()]) + "\n").encode())
                    n, size = n + 1, size + len(data)
    except BaseException:
        fs.delete_dir(f"{root}/{here}")
        raise
    return Staged(here, n, size)


def _commit(folder: str, job: str, messages) -> list[str]:
    """Makes a job count; the folders its tasks staged."""
    done = place_of(f"{folder}/_jobs/{job}/commit.json")
    if done is None:
        done = {"tasks": [m.folder for m in messages if m is not None and m.files], "files": sum(m.files for m in messages if m), "bytes": sum(m.bytes for m in messages if m)}
        place_of(f"{folder}/_jobs/{job}/commit.json", done)
    return done["tasks"]


def _abort(folder: str, job: str) -> None:
    fs, root = opened(folder)
    import pyarrow.fs

    if fs.get_file_info(f"{root}/_staging/{job}").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{root}/_staging/{job}")


def _publish(folder: str, job: str, task: str) -> int:
    """Moves one task's files to their paths and keeps its list with the job; the number moved now."""
    import pyarrow.fs

    fs, root = opened(folder)
    kept = f"{root}/_jobs/{job}/{task.rsplit('/', 1)[1]}.json"
    missing = pyarrow.fs.FileType.NotFound
    if fs.get_file_info(f"{root}/{task}/list").type == missing:
        return 0  # published before
    moved, rows, made = 0, [], set()
    with fs.open_input_stream(f"{root}/{task}/list") as f:
        for line in f.read().decode().splitlines():
            n, path, size, digest = json.loads(line)
            rows.append(json.dumps({"path": path, "bytes": size, "sha256": digest}))
            at, parent = f"{root}/{task}/{n}", posixpath.dirname(f"{root}/{path}")
            if fs.get_file_info(at).type != missing:
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                fs.move(at, f"{root}/{path}")
                moved += 1
    with fs.open_output_stream(f"{kept}.new") as f:
        f.write("\n".join(rows).encode())
    fs.move(f"{kept}.new", kept)
    fs.delete_dir(f"{root}/{task}")
    return moved


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job
        self.done = place_of(f"{folder}/_jobs/{job}/commit.json") is not None

    def write(self, iterator):
        if self.done:
            for _ in iterator:
                pass
            return Staged("", 0, 0)
        return _stage(self.folder, self.job, iterator)

    def commit(self, messages):
        _commit(self.folder, self.job, messages)

    def abort(self, messages):
        _abort(self.folder, self.job)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def write(self, iterator):
        return _stage(self.folder, f"{self.job}-stream", iterator)

    def commit(self, messages, batchId):
        job = f"{self.job}-{batchId}"
        known = place_of(f"{self.folder}/_jobs/{job}/commit.json") is not None
        tasks = _commit(self.folder, job, messages)
        if known:  # a batch that is run again: what it staged now is not needed
            fs, root = opened(self.folder)
            for m in messages:
                if m is not None and m.folder not in tasks:
                    fs.delete_dir(f"{root}/{m.folder}")
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda t: _publish(self.folder, job, t), tasks))

    def abort(self, messages, batchId):
        fs, root = opened(self.folder)
        for m in messages:
            if m is not None and m.folder:
                fs.delete_dir(f"{root}/{m.folder}")


class FileSink(DataSource):
    """Format ``pagemill_files``: rows (path, text); options ``folder`` and ``job``."""

    @classmethod
    def name(cls):
        return FORMAT

    def writer(self, schema, overwrite):
        return _Writer(self.options["folder"], self.options["job"])

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["folder"], self.options["job"])


def write_files(rows: DataFrame, folder: str, job: str, path: str = "file_path", text: str = "html") -> DataFrame:
    """Writes each row's text below ``folder`` as ``job``; (path, bytes, sha256) of the job's files.

    A job that was committed before is not run again, whatever its rows are now.
    """
    spark = rows.sparkSession
    if place_of(f"{folder}/_jobs/{job}/commit.json") is None:
        spark.dataSource.register(FileSink)
        rows.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).write.format(FORMAT).option("folder", folder).option("job", job).mode("append").save()
    return recover(spark, folder, job)


def recover(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """Publishes what is committed of a job and not yet in place; the job's files."""
    done = place_of(f"{folder}/_jobs/{job}/commit.json")
    if done is None:
        raise ValueError(f"no job {job} is committed in {folder}")
    if done["tasks"]:
        tasks = spark.createDataFrame([(t,) for t in done["tasks"]], "task string")

        def publish(batches):
            import pandas as pd

            for b in batches:
                yield pd.DataFrame({"moved": [_publish(folder, job, t) for t in b["task"]]})

        tasks.repartition(min(len(done["tasks"]), 10_000), "task").mapInPandas(publish, "moved long").agg(F.sum("moved")).collect()
        _abort(folder, job)
        return spark.read.schema(WRITTEN).option("pathGlobFilter", "*.json").json([f"{folder}/_jobs/{job}/{t.rsplit('/', 1)[1]}.json" for t in done["tasks"]])
    return spark.createDataFrame([], WRITTEN)


def stream_files(stream: DataFrame, folder: str, job: str, checkpoint: str, path: str = "file_path", text: str = "html"):
    """Writes a stream's rows as they come, each micro-batch once; the query, which ends when all that is there is written."""
    stream.sparkSession.dataSource.register(FileSink)
    rows = stream.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    return rows.writeStream.format(FORMAT).option("folder", folder).option("job", job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
