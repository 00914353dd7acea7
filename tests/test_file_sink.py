"""Files are written once, whole jobs or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources import file_sink, readers


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names if "_jobs" not in d}


def rows(spark, n=40):
    return spark.range(n, numPartitions=4).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/é "), F.col("id").cast("string"), F.lit(".html")).alias("file_path"), F.when(F.col("id") != 5, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("html"))


def test_files_of_a_job_and_a_rerun(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    got = file_sink.write_files(rows(spark), folder, "one")
    files = tree(tmp_path / "out")
    assert len(files) == 40 and files["d2/é 5.html"] == "" and files["d0/é 6.html"] == "text 6"
    assert {r["path"]: r["bytes"] for r in got.collect()} == {p: len(t.encode()) for p, t in files.items()}
    assert readers.saved_pages(spark, str(tmp_path / "out")).count() == 39  # empty files give no row
    before = {p: os.stat(tmp_path / "out" / p).st_mtime_ns for p in files}
    again = file_sink.write_files(rows(spark).withColumn("html", F.lit("other")), folder, "one")
    assert again.count() == 40 and {p: os.stat(tmp_path / "out" / p).st_mtime_ns for p in files} == before
    file_sink.write_files(rows(spark).withColumn("html", F.lit("other")), folder, "two")
    assert set(tree(tmp_path / "out").values()) == {"other"}
    assert file_sink.write_files(rows(spark).limit(0), folder, "none").count() == 0
    assert file_sink.write_files(rows(spark).withColumn("file_path", F.lit(None)), folder, "null").count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    broken = rows(spark).withColumn("html", F.when(F.col("file_path").contains("39"), F.raise_error(F.lit("broken"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="broken"):
        file_sink.write_files(broken, folder, "job")
    assert tree(tmp_path / "out") == {} and not os.path.exists(tmp_path / "out" / "_jobs" / "job" / "commit.json")
    for bad in ("../x", "/x", "a/../../x", "_jobs/x", "."):
        with pytest.raises(Exception, match="not a path inside"):
            file_sink.write_files(rows(spark).withColumn("file_path", F.lit(bad)), folder, "job")
    assert file_sink.write_files(rows(spark), folder, "job").count() == 40


def test_a_driver_lost_between_commit_and_publishing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    spark.dataSource.register(file_sink.FileSink)
    rows(spark).toDF("path", "text").write.format(file_sink.FORMAT).option("folder", folder).option("job", "lost").mode("append").save()
    assert not [p for p in tree(tmp_path / "out") if p.endswith(".html")]  # committed, nothing in place
    done = file_sink.place_of(f"{folder}/_jobs/lost/commit.json")
    assert done["files"] == 40
    file_sink._publish(folder, "lost", done["tasks"][0])  # one task had been published
    assert file_sink.recover(spark, folder, "lost").count() == 40 and len(tree(tmp_path / "out")) == 40
    assert file_sink.write_files(rows(spark), folder, "lost").count() == 40
    with pytest.raises(ValueError, match="no job"):
        file_sink.recover(spark, folder, "never")


def test_streamed_files(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows(spark).write.parquet(str(tmp_path / "in"))

    def run(checkpoint):
        stream = spark.readStream.schema("file_path string, html string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = file_sink.stream_files(stream, folder, "s", str(tmp_path / checkpoint))
        query.awaitTermination()
        return len(query.recentProgress)

    run("c")
    files = tree(tmp_path / "out")
    assert len(files) == 40
    before = {p: os.stat(tmp_path / "out" / p).st_mtime_ns for p in files}
    run("other")  # the same batches again, their commits are known
    assert {p: os.stat(tmp_path / "out" / p).st_mtime_ns for p in tree(tmp_path / "out")} == before
