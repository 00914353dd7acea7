"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, picked by hash) a neighbour graph is built and cut into
balanced parts by recursive bisection: an order along the graph's slowest mode, halves of equal
size, then exchanges of vertices that lower the cut. A small network learns to tell which parts
hold a vector's neighbours. Every vector of the table is indexed under its most probable part, and
a query is routed to its most probable parts until their probability reaches a threshold that was
calibrated on the sample, and at least ``2 k`` candidates are among them. Routed candidates are
reranked by the exact inner product in double precision.

Parts grow with the table: past ``TOP`` parts of ``PART`` vectors each of them is cut again in the
same way, on a bounded sample of its own vectors, so a query meets about as many candidates in a
table of any size up to ``TOP`` squared parts. The second networks are trained on the executors.

Parts are searched in blocks of at most about ``BLOCK`` candidates and ``QUERIES`` queries, so a
part that holds a third of all rows is many tasks. A query's k-th best score within the sample
bounds its result from below, so that blocks report few candidates.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without id. Vectors of different lengths have no inner product: each length is searched by itself.
Ties in score go to the smaller id. Rows that repeat an id are candidates each, and none is found
by a query of its own id. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Work, share_of

K = 20
SAMPLE, GRAPH_K, HIDDEN = 4096, 16, 128
#: Vectors of a part; there are 8 to ``TOP`` parts, each of which can have up to as many.
PART, TOP = 4096, 64
BLOCK, QUERIES = 8192, 1024
#: Recall within the sample that the routing threshold is set for.
AIM = 0.975


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added component by component in order, in double precision."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def neighbours(x: np.ndarray, q: np.ndarray, own: np.ndarray | None, k: int) -> np.ndarray:
    """For each row of q the k rows of x with the largest inner product; ``own`` are excluded."""
    out = []
    for s in range(0, len(q), 256):
        score = q[s : s + 256] @ x.T
        if own is not None:
            score[np.arange(len(score)), own[s : s + 256]] = -np.inf
        out.append(np.argpartition(-score, k - 1, 1)[:, :k] if k < len(x) else np.argsort(-score, 1)[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), int)


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each vertex of the graph with edges i - near[i, j]; sizes differ by one at most per cut."""
    n = len(near)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        idx, first, count = todo.pop()
        if count == 1 or len(idx) < 2:
            label[idx] = first
            continue
        number = np.full(n, -1)
        number[idx] = np.arange(len(idx))
        inside = (number[src] >= 0) & (number[dst] >= 0)
        a, b, m = number[src[inside]], number[dst[inside]], len(idx)
        degree = np.bincount(a, minlength=m) + 1e-9
        v = rng.standard_normal(m)
        for _ in range(60):  # power iteration on the lazy walk, its constant mode removed
            v = (v + np.bincount(a, v[b], m) / degree) / 2
            v -= np.average(v, weights=degree)
            v /= np.linalg.norm(v) + 1e-30
        half = (count // 2) * m // count
        side = np.zeros(m, bool)
        side[np.argsort(v, kind="stable")[half:]] = True
        for _ in range(10):  # exchange the vertices that gain most
            other = np.bincount(a, (side[a] != side[b]).astype(float), m)
            gain = 2 * other - np.bincount(a, minlength=m)
            left = np.flatnonzero(~side & (gain > 0))
            right = np.flatnonzero(side & (gain > 0))
            swap = min(len(left), len(right)) // 2
            if swap < 1:
                break
            side[left[np.argsort(-gain[left], kind="stable")[:swap]]] = True
            side[right[np.argsort(-gain[right], kind="stable")[:swap]]] = False
        todo += [(idx[~side], first, count // 2), (idx[side], first + count // 2, count - count // 2)]
    return label


@dataclass
class Router:
    """A network with one hidden layer from unit vectors to probabilities of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    threshold: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40) -> Router:
    """Fits the router to the parts of each vector's neighbours (rows of ``target`` sum to 1), by Adam."""
    n, d = x.shape
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            i = order[s : s + 256]
            h = np.maximum(unit[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            e = (z / z.sum(1, keepdims=True) - target[i]) / len(i)
            back = (e @ p[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((unit[i].T @ back + 1e-5 * p[0], back.sum(0), h.T @ e + 1e-5 * p[2], e.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, parts: int, k: int, seed: int = 5) -> Router:
    """The router for a sample ``x``."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if parts == 1 or n < 4:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbours(x, x, np.arange(n), min(GRAPH_K, n - 1))
    label = balanced_parts(near, parts, rng)
    share = np.zeros((n, parts))
    np.add.at(share, (np.arange(n)[:, None], label[near]), 1 / near.shape[1])
    share[np.arange(n), label] += 1
    router = train(x, share / share.sum(1, keepdims=True), rng)
    # The threshold: the least probability that routes queries to most of their neighbours' parts.
    p = router.probabilities(x)
    at = p.argmax(1)
    q = rng.permutation(n)[: min(n, 1024)]
    true = neighbours(x, x[q], q, min(k, n - 1))
    order = np.argsort(-p[q], 1)
    before = np.take_along_axis(p[q], order, 1).cumsum(1) - np.take_along_axis(p[q], order, 1)
    need = np.zeros_like(before)
    np.put_along_axis(need, order, before, 1)
    needed = np.sort(np.take_along_axis(need, at[true], 1).ravel())
    router.threshold = float(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))))]) + 1e-9
    return router


@dataclass
class Tree:
    """Routers in two levels: part i of the first has ``width`` parts of its own, told apart by ``below[i]``."""

    top: Router
    below: dict[int, Router]
    width: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        first = self.top.probabilities(x).argmax(1)
        out = first * self.width
        for i in np.unique(first):
            if i in self.below:
                own = first == i
                out[own] += self.below[i].probabilities(x[own]).argmax(1)
        return out

    def routed(self, x: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        """Which parts (columns) each vector (row) is searched in: the probable ones, and at least ``least`` vectors of ``held`` a part."""
        p = self.top.probabilities(x)
        first, share = _until(p, self.top.threshold), np.zeros((len(x), p.shape[1] * self.width))
        chosen = np.zeros(share.shape, bool)
        for i in range(p.shape[1]):
            own = slice(i * self.width, (i + 1) * self.width)
            if i not in self.below:
                share[:, own.start], chosen[:, own.start] = p[:, i], first[:, i]
                continue
            q = self.below[i].probabilities(x)
            share[:, own], chosen[:, own] = p[:, [i]] * q, first[:, [i]] & _until(q, self.below[i].threshold)
        order = np.argsort(-(share + chosen), 1, kind="stable")  # the chosen ones first
        have = held[order].cumsum(1) - held[order]
        np.put_along_axis(chosen, order, np.take_along_axis(chosen, order, 1) | (have < least), 1)
        return chosen


def _until(p: np.ndarray, threshold: float) -> np.ndarray:
    """The likeliest of each row before their probabilities reach a threshold."""
    order = np.argsort(-p, 1, kind="stable")
    before = np.take_along_axis(p, order, 1).cumsum(1) - np.take_along_axis(p, order, 1)
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, before < threshold, 1)
    return out


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), dim)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each row for which ``is_query`` (over ``id``) holds."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row per length
    out = None
    for r in sizes or [{"d": 1, "count": 0}]:
        found = _search(rows.where(F.size("v") == r["d"]), is_query, k, r["d"], r["count"], sample, part)
        out = found if out is None else out.unionByName(found)
    return out


def plan(rows: DataFrame, dim: int, total: int, k: int, sample: int, part: int, work: Work) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The routers for a table of ``total`` vectors, and the ids and vectors of the sample that the first one is fitted on."""
    want = max(1, total // part)
    parts = 1 if total < 64 else max(8, min(TOP, 1 << want.bit_length()))
    got = share_of(rows, F.xxhash64("id", F.lit(43)), sample, total).limit(2 * sample).toPandas()  # the limit is for repeated ids
    got = got.sort_values("id", kind="stable")
    x = _matrix(got["v"], dim)
    top = fit(x, parts if len(x) >= 64 else 1, k)
    width = 1 if want <= TOP else min(TOP, 1 << (want // TOP).bit_length())
    if width == 1 or top.w2.shape[1] < parts:
        return Tree(top, {}, 1), got["id"].to_numpy().astype(np.int64), x
    sent = rows.sparkSession.sparkContext.broadcast(top)

    def first(batches):
        for b in batches:
            yield b.assign(part=sent.value.probabilities(_matrix(b["v"], dim)).argmax(1).astype(np.int32))

    def second(rows):
        import pickle

        import pandas as pd

        rows = rows.sort_values("id", kind="stable").iloc[: 2 * sample]
        router = fit(_matrix(rows["v"], dim), width, k, seed=int(rows["part"].iloc[0])) if len(rows) >= 4 * width else None
        return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [None if router is None else pickle.dumps(router)]})

    placed = work.table(rows.mapInPandas(first, "id long, v array<double>, part int"), "placed")
    held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    keep = F.element_at(F.array(*[F.lit(min(1.0, sample / max(held.get(i, 1), 1))) for i in range(parts)]), F.col("part") + 1)
    picked = placed.where(F.pmod(F.xxhash64("id", F.lit(47)), F.lit(1 << 30)) < keep * (1 << 30))
    import pickle

    routers = picked.groupBy("part").applyInPandas(second, "part int, router binary").collect()  # ``TOP`` small networks at most
    work.drop(placed)
    below = {r["part"]: pickle.loads(r["router"]) for r in routers if r["router"] is not None}
    return Tree(top, below, width), got["id"].to_numpy().astype(np.int64), x


def _first(i: np.ndarray, j: np.ndarray, q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of queries and candidates the ``k`` of each query with the largest exact score, of ties those with the smallest ids."""
    score = dot(q[i], c[j]) if len(set(i.tolist())) != 1 else dot(q[i[:1]], c[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0])) if len(i) else np.empty(0, np.int64)
    nth = np.arange(len(i)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(i)]])))
    return i[nth < k], j[nth < k], score[nth < k]


def _search(rows: DataFrame, is_query: Column, k: int, dim: int, total: int, sample: int, part: int) -> DataFrame:
    """``search`` among vectors of one length."""
    import pandas as pd

    spark, work = rows.sparkSession, Work(rows.sparkSession, "nearest")
    tree, sample_ids, x = plan(rows, dim, total, k, sample, part, work)
    parts = tree.top.w2.shape[1] * tree.width
    sent = spark.sparkContext.broadcast((tree, x, sample_ids))

    def indexed(batches):
        for b in batches:
            yield b.assign(part=sent.value[0].leaf(_matrix(b["v"], dim)).astype(np.int32))

    index = rows.mapInPandas(indexed, "id long, v array<double>, part int").withColumn("uid", F.monotonically_increasing_id())
    index = work.table(index, "index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row per part

    def routed(batches):
        tree, x, ids = sent.value
        at = tree.leaf(x) if len(x) else np.empty(0, np.int64)
        in_part = np.array([held.get(i, 0) for i in range(parts)])
        for b in batches:
            q = _matrix(b["v"], dim)
            chosen = tree.routed(q, in_part, 2 * k + 1)
            score = q @ x.T  # only vectors of parts that are searched bound the result
            score[(b["id"].to_numpy()[:, None] == ids[None, :]) | ~chosen[:, at]] = -np.inf
            floor = -np.partition(-score, k - 1, 1)[:, k - 1] if len(x) > k else np.full(len(q), -np.inf)
            yield b[["id", "v"]].assign(floor=floor, parts=[list(map(int, np.flatnonzero(c))) for c in chosen])

    queries = index.where(is_query).select("id", "v").dropDuplicates(["id"]).mapInPandas(routed, "id long, v array<double>, floor double, parts array<int>")
    queries = work.table(queries.select("id", "v", "floor", F.explode("parts").alias("part")), "queries")
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    blocks = {i: -(-n // BLOCK) for i, n in held.items()}
    groups = {i: -(-n // QUERIES) for i, n in asked.items()}

    def of(numbers: dict) -> Column:
        return F.element_at(F.array(*[F.lit(max(1, numbers.get(i, 1))) for i in range(parts)]), F.col("part") + 1)

    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cand = index.where(F.col("part").isin(list(asked))).withColumn("block", F.pmod(F.xxhash64("uid"), of(blocks)).cast("int")).withColumn("qgroup", count(of(groups))).select("part", "block", "qgroup", "id", "v")
    asks = queries.withColumn("qgroup", F.pmod(F.xxhash64("id"), of(groups)).cast("int")).withColumn("block", count(of(blocks))).select("part", "block", "qgroup", "id", "v", "floor")

    def reranked(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        c, q = np.array(left["v"].tolist()), np.array(right["v"].tolist())
        ids, qids, floor = left["id"].to_numpy(), right["id"].to_numpy(), right["floor"].to_numpy()
        near = q @ c.T
        near[qids[:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (1 + np.abs(q).sum(1) * np.abs(c).max())
        if len(ids) > k:
            floor = np.maximum(floor, -np.partition(-near, k - 1, 1)[:, k - 1])
        hit = (near >= (floor - slack)[:, None]) & (near > -np.inf)
        crowded = hit.sum(1) > 4 * k
        out = [_first(*np.nonzero(hit & ~crowded[:, None]), q, c, ids, k)]
        for row in np.flatnonzero(crowded):  # very many ties: one query at a time bounds memory
            j = np.flatnonzero(hit[row])
            out.append(_first(np.full(len(j), row), j, q, c, ids, k))
        i, j, score = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query_id": qids[i], "vec_id": ids[j], "score": score})

    key = ["part", "block", "qgroup"]
    found = cand.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(reranked, "query_id long, vec_id long, score double")
    from pyspark.sql import Window

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
