"""Keyed state with timers: retries with back-off, and the best path of each page.

Both are stateful processors over streams with a watermark. State is kept in RocksDB, so it is
bounded by disk, not by an executor's heap, and entries go when a timer says that nothing can change
them any more. Rows of a key come in frames that are folded one by one, in any order: results are
those of the rows in order of their time, as long as none is later than the watermark allows.

``retries`` keeps per key when it last succeeded, how many failures after that are older than the
watermark (no success can come between those any more, so they are a number), and the younger ones one
by one. ``paths`` keeps what each parent page last said of a page's path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRY = "key long, kind string, failures long, exhausted boolean, due long"
PATH = "key long, path array<string>, parent string, final boolean"


def in_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need this store; a session that names another provider of its own keeps it."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Retries(StatefulProcessor):
    def __init__(self, most: int, backoff: float):
        self.most, self.backoff = most, int(backoff * 1e6)

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("retries", "ok long, ok_id long, settled long, last long, at array<long>, ids array<long>")

    def _row(self, key, kind, n, due=None):
        return pd.DataFrame({"key": [key[0]], "kind": [kind], "failures": [n], "exhausted": [n >= self.most], "due": pd.array([due], "Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ok, settled, last, at, ids = (-1 << 63, -1 << 63), 0, 0, np.empty(0, np.int64), np.empty(0, np.int64)
        if self.state.exists():
            s = self.state.get()
            ok, settled, last, at, ids = (s[0], s[1]), s[2], s[3], np.array(s[4], np.int64), np.array(s[5], np.int64)
        before, n, mark = ok, settled + len(at), timerValues.getCurrentWatermarkInMs() * 1000
        for t in list(self.handle.listTimers()):
            if n and t * 1000 <= mark:  # due before these rows came
                yield self._row(key, "due", n, last + self.backoff * (1 << (n - 1)))
            self.handle.deleteTimer(t)
        for frame in rows:
            when, number, failed = frame["at"].to_numpy(np.int64), frame["seq"].to_numpy(np.int64), frame["failed"].to_numpy(bool)
            if (~failed).any():
                w, s = when[~failed], number[~failed]
                top = int(np.lexsort((s, w))[-1])
                ok = max(ok, (int(w[top]), int(s[top])))
            at, ids = np.concatenate([at, when[failed]]), np.concatenate([ids, number[failed]])
            after = (at > ok[0]) | ((at == ok[0]) & (ids > ok[1]))
            at, ids = at[after], ids[after]
        if ok > before:
            settled = 0  # what was older than the watermark is older than a success that came in time
        n = settled + len(at)
        last = int(at.max()) if len(at) else last
        old = at <= mark
        settled, at, ids = settled + int(old.sum()), at[~old], ids[~old]
        self.state.update((ok[0], ok[1], settled, last, at.tolist(), ids.tolist()))
        if 0 < n < self.most:
            self.handle.registerTimer(max((last + self.backoff * (1 << (n - 1))) // 1000, mark // 1000 + 1))
        elif n == 0:
            self.handle.registerTimer(max(ok[0] // 1000 + 1, mark // 1000 + 1))
        yield self._row(key, "counted", n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.state.get()
        n = s[2] + len(s[4])
        if n == 0:
            self.state.clear()  # a success, and the watermark is past it
            return
        yield self._row(key, "due", n, s[3] + self.backoff * (1 << (n - 1)))

    def close(self):
        pass


def retries(rows: DataFrame, key: str, seq: str, failed, most: int = 3, backoff: float = 60.0, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``RETRY``, ``due`` as a time: after each batch a ``counted`` row a key it touched, with the failures since the last success; a ``due`` row once the watermark passes a retry's time.

    A retry after failure n is due ``backoff`` * 2^(n - 1) seconds after that failure, as long as n is below
    ``most``. ``key`` and ``seq`` (which breaks ties of time) are longs.
    """
    in_rocksdb(rows.sparkSession)
    slim = rows.withWatermark(time, delay).select(F.col(key).cast("long").alias("key"), F.col(time).alias("ts"), F.unix_micros(time).alias("at"), F.col(seq).cast("long").alias("seq"), F.coalesce(failed, F.lit(False)).alias("failed"))
    told = slim.groupBy("key").transformWithStateInPandas(_Retries(most, backoff), RETRY, "update", "eventtime")
    return told.withColumn("due", F.timestamp_micros("due"))


class _Paths(StatefulProcessor):
    def init(self, handle):
        self.handle = handle
        self.said = handle.getMapState("said", "parent string", "offers string")
        self.page = handle.getValueState("page", "done long, closed boolean, path array<string>, parent string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, closed, path, parent = self.page.get() if self.page.exists() else (None, False, None, None)
        shown, new = (done is not None, path, parent), {}
        for frame in rows:
            if closed:
                continue
            for at, seq, who, said, ends in zip(frame["at"].tolist(), frame["seq"].tolist(), frame["parent"], frame["path"], frame["done"]):
                if ends:
                    done = at if done is None else min(done, at)
                else:
                    new.setdefault(who, []).append([at, seq, None if said is None else [str(x) for x in said]])
        if closed:
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for who, offers in new.items():
            old = json.loads(self.said.getValue((who,))[0]) if self.said.containsKey((who,)) else []
            self.said.updateValue((who,), (json.dumps(self._open(old + offers, mark, done)),))
        path, parent = self._best(done)
        if done is not None:
            self.handle.registerTimer(max(done // 1000 + 1, mark // 1000 + 1))
        self.page.update((done, False, path, parent))
        if (done is not None, path, parent) != shown:
            yield pd.DataFrame({"key": [key[0]], "path": [path], "parent": [parent], "final": [done is not None]})

    @staticmethod
    def _open(offers: list, mark: int, done: int | None) -> list:
        """The offers that can still be the last up to an end: all that are younger than the watermark, and the last of the others."""
        offers = sorted((o for o in offers if done is None or o[0] <= done), key=lambda o: (o[0], o[1]))
        old = sum(o[0] <= mark for o in offers)
        return offers[max(old - 1, 0) :]

    def _best(self, done):
        """The longest path of the parents' last offers, of equals the least."""
        found = []
        for (who,), (offers,) in self.said.iterator():
            last = max((o for o in json.loads(offers) if done is None or o[0] <= done), key=lambda o: (o[0], o[1]), default=None)
            if last and last[2]:
                found.append((-len(last[2]), last[2], who))
        return min(found)[1:] if found else (None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, closed, path, parent = self.page.get()
        if not closed and done is not None and timerValues.getCurrentWatermarkInMs() * 1000 >= done:
            self.said.clear()  # no earlier row can come: the page is closed, its offers go
            self.page.update((done, True, path, parent))
        return iter(())

    def close(self):
        pass


def paths(rows: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``PATH``: a page's best path each time it changes, from rows (key, time, seq, parent, path, done).

    A row with ``done`` ends a page at its time; others are what a parent says of the path, null where it
    has none any more. Of each parent the last offer up to the end counts, of those the longest
    path, of equals the least. A better or a withdrawn offer puts out a corrected row. Once the watermark
    is past a page's end its offers are deleted and further rows of it are ignored.
    """
    in_rocksdb(rows.sparkSession)
    slim = rows.withWatermark(time, delay).select(F.col(key).cast("long").alias("key"), F.col(time).alias("ts"), F.unix_micros(time).alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("parent", F.lit("")).alias("parent"), "path", F.coalesce("done", F.lit(False)).alias("done"))
    return slim.groupBy("key").transformWithStateInPandas(_Paths(), PATH, "update", "eventtime")
