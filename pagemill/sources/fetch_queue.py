"""Fetching by a plan: a queue table with a start time for every URL, read by a streaming source.

``plan`` gives each URL of a table its place in its host's line, and by the host's interval the
second at which it is due. Rounds are stretches of that time; lanes are groups of hosts. ``write_queue``
stores the plan by round and lane. ``queue_source`` is a streaming data source whose offsets are rounds
that have begun and whose partitions are lanes: the driver only counts rounds, URLs go from the queue's
files to the tasks. As a host has one lane, one task alone speaks to it and can keep its interval,
whatever is late: a call begins when it is due and when the host's last call began an interval ago.
The stream's checkpoint holds the rounds that are done, so a restart goes on behind them.

``fetch_all`` runs attempt after attempt: what ``fetching.due`` finds in the log of attempts makes the
queue of the next one, no earlier than its back-off ends.

Folders are addresses that pyarrow can open on every executor (a mounted path, hdfs, s3, gs).
"""

from __future__ import annotations

import heapq
import json
import queue
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pagemill.functions.urls import authority
from pagemill.operators import chunks, fetching
from pagemill.sources.places import opened, place_of

ATTEMPT = "url string, host string, round long, attempt int, status int, html string, error string, started double"


def plan(urls: DataFrame, interval: float = 1.0, round_seconds: float = 60.0, lanes: int = 64) -> DataFrame:
    """(url, host, attempt, n, at, round, lane) of (url, pos[, attempt, not_before]).

    ``pos`` is a number that orders a host's URLs; ``not_before`` counts seconds from the start, like
    ``at``. A host may hold most URLs: they are numbered in chunks, and a round has no more of them
    than its interval allows. URLs without a host share one; null URLs are left out.
    """
    rows = urls.where(F.col("url").isNotNull())
    for c, kind, value in (("attempt", "int", 1), ("not_before", "double", 0.0)):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(value)).cast(kind) if c in urls.columns else F.lit(value).cast(kind))
    rows = chunks.numbered(rows.withColumn("host", F.lower(authority(F.col("url")))), ["host"], ["pos", "url"], "n")
    rows = rows.withColumn("at", F.greatest((F.col("n") - 1) * F.lit(float(interval)), F.col("not_before")))
    return rows.select("url", "host", "attempt", "n", "at", F.floor(F.col("at") / round_seconds).alias("round"), F.pmod(F.xxhash64("host"), F.lit(lanes)).alias("lane"))


def write_queue(planned: DataFrame, folder: str, interval: float, round_seconds: float) -> int:
    """Stores a plan, a file a round and lane, then what the source must know of it; the number of rounds."""
    planned.repartition("round", "lane").sortWithinPartitions("round", "lane", "at").write.mode("overwrite").partitionBy("round", "lane").parquet(f"{folder}/plan")
    spark = planned.sparkSession
    parts = spark.read.schema("round long, lane long").parquet(f"{folder}/plan").groupBy("lane").agg(F.max("round").alias("last"))
    said = parts.agg(F.max("last"), F.collect_list("lane")).first()  # a number a lane
    rounds = 0 if said[0] is None else int(said[0]) + 1
    fs, path = opened(folder)
    with fs.open_output_stream(f"{path}/about.json") as f:
        f.write(json.dumps({"rounds": rounds, "lanes": sorted(map(int, said[1])), "interval": interval, "round_seconds": round_seconds}).encode())
    return rounds


class _Lane(InputPartition):
    def __init__(self, lane: int, begin: int, end: int):
        self.lane, self.begin, self.end = lane, begin, end


def queue_source(name: str, fetch: Callable[[str], tuple[str | None, int | None]], concurrency: int = 8) -> type[DataSource]:
    """A streaming source that fetches a queue: options ``folder`` and ``start`` (seconds since 1970). Register it with ``spark.dataSource.register``."""

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.folder, self.start = options["folder"], float(options["start"])
            fs, path = opened(self.folder)
            with fs.open_input_stream(f"{path}/about.json") as f:
                self.about = json.loads(f.read())

        def initialOffset(self):
            return {"round": 0}

        def latestOffset(self):
            begun = int((time.time() - self.start) // self.about["round_seconds"]) + 1
            return {"round": max(0, min(self.about["rounds"], begun))}

        def partitions(self, start, end):
            return [_Lane(lane, start["round"], end["round"]) for lane in self.about["lanes"]]

        def commit(self, end):
            pass

        def read(self, partition) -> Iterator[tuple]:
            yield from paced(_rows(self.folder, partition), fetch, self.start, self.about["interval"], concurrency)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ATTEMPT

        def streamReader(self, schema):
            return Reader(self.options)

    return Source


def _rows(folder: str, lane: _Lane) -> Iterator[tuple]:
    """(at, host, url, attempt, round) of a lane's rounds in order of time, a file at a time."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, path = opened(folder)
    for number in range(lane.begin, lane.end):
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/plan/round={number}/lane={lane.lane}", allow_not_found=True))
        for info in sorted((i for i in found if i.path.endswith(".parquet")), key=lambda i: i.path):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["at", "host", "url", "attempt"]):
                    for at, host, url, attempt in zip(*[c.to_pylist() for c in batch.columns]):
                        yield at, host, url, attempt, number


def paced(rows: Iterator[tuple], fetch: Callable, start: float, interval: float, concurrency: int, ahead: int = 10_000) -> Iterator[tuple]:
    """Rows of ``ATTEMPT`` as calls end. Calls to one host begin an interval apart at least, the first one that long after now or when it is due.

    ``concurrency`` threads take whichever host is due first; ``ahead`` rows are held at a time.
    """
    lock, done = threading.Condition(), queue.Queue()
    waiting: dict[str, deque] = defaultdict(deque)
    due: list[tuple[float, str]] = []
    ready = time.time() + interval  # the last batch may have called this host just now
    free: dict[str, float] = {}
    busy: set[str] = set()
    held, ended = 0, False

    def offer(host: str) -> None:
        if waiting[host] and host not in busy:
            busy.add(host)
            heapq.heappush(due, (max(start + waiting[host][0][0], free.get(host, ready)), host))

    def work() -> None:
        nonlocal held
        while True:
            with lock:
                while not due or due[0][0] > time.time():
                    if not due and ended and not held:
                        return
                    lock.wait(max(0.0, due[0][0] - time.time()) if due else 0.2)
                _, host = heapq.heappop(due)
                _, _, url, attempt, number = waiting[host].popleft()
                began = time.time()
                free[host] = began + interval
            html, status, error = None, None, None
            try:
                html, status = fetch(url)
                error = None if status == 200 else f"status {status}"
            except Exception as e:  # a row for every URL
                error = f"{type(e).__name__}: {e}"
            done.put((url, host, number, attempt, status, html, error, began))
            with lock:
                held -= 1
                busy.discard(host)
                offer(host)
                lock.notify_all()

    threads = [threading.Thread(target=work, daemon=True) for _ in range(concurrency)]
    for t in threads:
        t.start()
    for row in rows:
        with lock:
            held += 1
            waiting[row[1]].append(row)
            offer(row[1])
            lock.notify()
        while held >= ahead:
            yield done.get()
        while not done.empty():
            yield done.get()
    with lock:
        ended = True
        lock.notify_all()
    while any(t.is_alive() for t in threads) or not done.empty():
        try:
            yield done.get(timeout=0.05)
        except queue.Empty:
            continue


def fetch_all(spark: SparkSession, urls: DataFrame, fetch: Callable, folder: str, interval: float = 1.0, round_seconds: float = 60.0, lanes: int = 64, most: int = 3, backoff: float = 30.0, concurrency: int = 8) -> DataFrame:
    """The log of all attempts (``ATTEMPT``) at (url, pos): each URL once, failed ones again after ``backoff`` * 2^(attempt - 1) seconds, ``most`` times in all.

    Plans, logs and checkpoints stay below ``folder``. Called again with the same folder it goes on
    where it ended: attempts whose log is complete are not made again.
    """
    from pagemill.streaming.state import drain

    name = f"queue_{abs(hash(folder))}"
    spark.dataSource.register(queue_source(name, fetch, concurrency))
    todo, logs = urls, []
    for attempt in range(1, most + 1):
        here = f"{folder}/attempt={attempt}"
        start = place_of(f"{here}/start.json")
        if start is None:
            rounds = write_queue(plan(todo, interval, round_seconds, lanes), here, interval, round_seconds)
            start = {"start": time.time(), "rounds": rounds}
            place_of(f"{here}/start.json", start)
        if not start["rounds"]:
            break
        stream = spark.readStream.format(name).option("folder", here).option("start", str(start["start"])).load()
        while True:
            out = drain(stream, f"{here}/stream")
            left = start["start"] + (start["rounds"] - 1) * round_seconds - time.time()
            if left <= 0 and _drained(f"{here}/stream", start["rounds"]):
                break
            time.sleep(max(0.0, min(left, round_seconds)))
        logs.append(out)
        log = logs[0]
        for other in logs[1:]:
            log = log.unionByName(other)
        todo = fetching.due(log, most, backoff).withColumn("not_before", F.greatest(F.col("not_before") - F.lit(time.time()), F.lit(0.0))).withColumn("pos", F.col("not_before"))
    return log if logs else spark.createDataFrame([], ATTEMPT)


def _drained(checkpoint: str, rounds: int) -> bool:
    """Whether the stream's last committed offset is the last round."""
    fs, path = opened(f"{checkpoint}/log")
    import pyarrow.fs

    names = [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/commits", allow_not_found=True)) if i.base_name.isdigit()]
    if not names:
        return False
    with fs.open_input_stream(f"{path}/offsets/{max(names, key=int)}") as f:
        return json.loads(f.read().decode().splitlines()[-1])["round"] >= rounds
