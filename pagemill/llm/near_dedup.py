"""Near-duplicate documents by MinHash and an LSH forest.

Words are runs of other than white space, A-Z in lower case; a document's set are its distinct
shingles of ``WORDS`` words (one of all words, if there are fewer). Documents are linked when
100 * |intersection| >= 75 * |union| of their sets, checked on the full sets.

Documents with one sequence of words are one node. The forest holds ``TREES`` sorted orders of the
nodes' signatures, order t beginning at the t-th group of ``DEPTH`` values and going on around.
Nodes that share those ``DEPTH`` values form a region. In a region of up to ``SMALL`` nodes all pairs
are candidates. In a larger one the depth adapts: its nodes are sorted by the values that follow, and
those next to each other, which have the longest common prefixes, are candidates, in every ``STEP``-th
order. Candidates whose signatures agree in ``CUT`` of their places (``NEAR`` in large regions) are
checked on full sets: first each node's likest and one other, then, of what is left, the pairs that
still lie in different components.

What a large region leaves out is found exactly (``rare_rows``, ``rare_pairs``): if nodes of different components
are in one, they are joined by their rarest shingles. In any one order of all shingles, two linked
sets share a shingle among the first quarter of each; an order with rare ones first keeps what many
share out of that quarter, and only shingles that different components share give pairs. The order
follows a sketch of counts of bounded size; a coarse one costs time, never links.

A pair at the very threshold shares no region with probability (1 - 0.75^3)^24 = 2e-6 and is lost to
``CUT`` with about as much (4.4 standard deviations), however many nodes its regions have. Regions lie
in partitions by range, so that a large one spans several; pairs are not formed across their bounds,
of which there is one a task.

Nothing is collected but the sketch: sets, signatures, links and components stay distributed tables.

Documents without text or words have no set, are linked with nothing and stay. Null ids are never a
component's id as long as one of its documents has one. Repeated rows are documents of their own
with one set. Empty tables give empty results. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Work, bounded_batches, ident, maybe_in, released

WORDS = 5
PERCENT = 75
TREES, DEPTH = 24, 3
#: Values of a signature: those of the trees, and as many more for the estimate.
HASHES = 2 * TREES * DEPTH
#: Values after its prefix by which a region is sorted.
ORDER = 7
SMALL, STEP = 8, 4
CUT, NEAR = 0.59, 0.72
#: Links whose components are found in one task.
FEW = 200_000
#: The sketch of counts has 2^LEAST to 2^MOST places, an eighth of the counted shingles between.
LEAST, MOST, PIECE = 17, 23, 17

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def words_of(text: str | None) -> list[bytes]:
    """The words in lower case: bytes of A-Z and of white space as the contract has them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> bytes:
    return md5(b" ".join(words)).digest()


class Shingler:
    """Hashes of 64 bits for the shingles of texts; remembers words up to a number."""

    def __init__(self, remembered: int = 200_000):
        from xxhash import xxh3_64_intdigest

        self.known, self.most, self.hash = {}, remembered, xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = self.hash(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        with np.errstate(over="ignore"):
            n = min(WORDS, len(h))
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = (out ^ h[k : len(h) - n + k + 1]) * _ODD
                out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for s in range(0, len(low), 512):
            out = np.minimum(out, ((low[s : s + 512, None] ^ _XOR) * _MUL).min(0))
    return out


def _signatures(batches):
    import pandas as pd

    shingle = Shingler()
    for b in batches:
        n, full, short, node = [], [], [], []
        for text in b["text"]:
            words = words_of(text)
            s = shingle(words)
            n.append(len(s))
            node.append(node_of(words))
            g = signature(s) if len(s) else None
            full.append(None if g is None else g[: TREES * DEPTH].astype(">u4").tobytes())
            short.append(None if g is None else (g >> np.uint32(5)).astype(np.uint8).tobytes())
        yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "node": node, "n": n, "mh": full, "sig": short})


def _sets(batches):
    import pandas as pd

    shingle = Shingler()
    for b in batches:
        words = [words_of(t) for t in b["text"]]
        yield pd.DataFrame({"node": [node_of(w) for w in words], "shingles": [shingle(w).view(np.int64) for w in words]})


def _several(batches):
    """The rows of groups of two and more of sorted keys."""
    import pyarrow as pa

    last, told = None, False  # the last row so far, and whether it was given out
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
        key = t["key"].to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False) | np.append(False, same)
        if last is not None and told:
            keep[0] = False
        last, told = t.slice(len(t) - 1).to_batches()[0], bool(keep[-1])
        yield from t.filter(pa.array(keep)).to_batches()


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _matrix(array) -> np.ndarray:
    """The bytes of signatures, a row each."""
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(len(array), HASHES)


def _neighbours(batches):
    """(u, v, like): candidates among rows sorted by region and signature."""
    import pyarrow as pa

    held = None
    for b in batches:
        old = 0 if held is None else held.num_rows
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        key, n, sig, wide = t["key"].to_numpy(), t["n"].to_numpy(), _matrix(t["sig"]), t["large"].to_numpy(zero_copy_only=False).astype(bool)
        left, right, likes = [], [], []
        for k in range(1, SMALL):
            i = np.arange(max(0, old - k), len(t) - k)
            i = i[(key[i] == key[i + k]) & (~wide[i] | (k == 1))]
            i = i[100 * np.minimum(n[i], n[i + k]) >= PERCENT * np.maximum(n[i], n[i + k])]
            like = (sig[i] == sig[i + k]).mean(1)
            ok = like >= np.where(wide[i], NEAR, CUT)
            left.append(i[ok]), right.append(i[ok] + k), likes.append(like[ok])
        i, j = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([t["node"].combine_chunks().take(pa.array(i)), t["node"].combine_chunks().take(pa.array(j)), pa.array(np.concatenate(likes).astype(np.float32))], ["u", "v", "like"])
        held = t.slice(max(0, len(t) - SMALL + 1)).combine_chunks().to_batches()
        held = held[0] if held else None


def _alike(batches):
    """The pairs whose signatures agree enough."""
    import pyarrow as pa

    for b in batches:
        ok = (_matrix(b.column("a")) == _matrix(b.column("b"))).mean(1) >= CUT
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok))


def _place(shingles: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((shingles.view(np.uint64) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batches, bits: int):
    """A sketch of the shingles of a task in pieces of 2^PIECE counts."""
    import zlib

    import pyarrow as pa

    count = np.zeros(1 << bits, np.uint32)
    for b in batches:
        np.add.at(count, _place(b.column("shingles").flatten().to_numpy(), bits), 1)
    for k, part in enumerate(count.reshape(-1, 1 << PIECE)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["piece", "data"])


def _levels(batches):
    """The sums of sketches, as logarithms in steps of a half."""
    import zlib

    import pyarrow as pa

    total: dict = {}
    for b in batches:
        for k, data in zip(b.column("piece").to_pylist(), b.column("data").to_pylist()):
            part = np.frombuffer(zlib.decompress(data), np.uint32)
            total[k] = total.get(k, 0) + part.astype(np.uint64)
    for k, count in total.items():
        level = np.floor(2 * np.log2(count + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["piece", "data"])


def _rarest(batches, level: np.ndarray, bits: int):
    """(token, node, n, at): the first quarter of each set's shingles, rare ones first."""
    import pyarrow as pa

    for b in batches:
        tokens, size, n = [], [], []
        for x in b.column("shingles"):
            h = x.values.to_numpy()
            most = len(h) - -(-PERCENT * len(h) // 100) + 1
            tokens.append(h[np.lexsort((h, level[_place(h, bits)]))[:most]])
            size.append(most), n.append(len(h))
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) if len(of) else of
        flat = np.concatenate([np.empty(0, np.int64), *tokens])
        yield pa.RecordBatch.from_arrays([pa.array(flat), b.column("node").take(pa.array(of)), pa.array(np.array(n, np.int32)[of]), pa.array(at.astype(np.int32))], ["token", "node", "n", "at"])


def rare_rows(sets: DataFrame, crowd: DataFrame, work: Work) -> DataFrame:
    """(token, node, n, at): the rarest shingles of the nodes of ``crowd``, as far as two nodes share them."""
    some = maybe_in(sets, F.col("node"), crowd, F.col("node"))
    total = some.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 1
    bits = max(LEAST, min(MOST, (int(total) // 8).bit_length()))
    pieces = some.mapInArrow(released(lambda it: _counted(it, bits)), "piece int, data binary").repartition("piece").mapInArrow(_levels, "piece int, data binary")
    level = np.zeros(1 << bits, np.uint8)
    for r in pieces.collect():  # 2^MOST bytes at most, whatever the table
        level[r["piece"] << PIECE : (r["piece"] + 1) << PIECE] = np.frombuffer(r["data"], np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(level)
    tokens = work.table(some.mapInArrow(released(lambda it: _rarest(it, sent.value, bits)), "token long, node binary, n int, at int"), "tokens")
    shared = work.table(tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token"), "shared")
    rows = work.table(maybe_in(tokens, F.col("token"), shared, F.col("token")).join(shared, "token").select("token", "node", "n", "at"), "shared_rows")
    work.drop(tokens, shared)
    return rows


def rare_pairs(rows: DataFrame, nodes: DataFrame, roots: DataFrame, work: Work, whole: bool) -> DataFrame | None:
    """(u, v): candidates of different components that share one of their rarest shingles; with ``whole`` all that can be linked.

    In each token's group the nodes outside its largest component are probes, so nodes of one
    component do not meet. Without ``whole`` a probe only meets the member of the largest component
    that has the fewest rare shingles before the token, which of all is likeliest to be linked with it.
    """
    rows = work.table(rows.join(roots, "node", "left").select("token", "node", "n", "at", F.coalesce("root", "node").alias("comp")), "rows")
    shares = rows.groupBy("token", "comp").agg(F.count("*").alias("rows"))
    several = shares.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("token", "most")
    several = work.table(several, "several")
    mixed = work.table(rows.join(several, "token").withColumn("probe", F.col("comp") != F.col("most")).drop("most"), "mixed")
    members = mixed
    if not whole:
        first = mixed.where("not probe").groupBy("token").agg(F.min(F.struct("at", "node", "n", "comp", "probe")).alias("m"))
        members = work.table(first.select("token", "m.*"), "leads")
    # Pairs with a probe, each once.
    fits = "100 * least(a.n, b.n) >= {0} * greatest(a.n, b.n) and (100 + {0}) * (a.n - a.at) >= {0} * (a.n + b.n) and (100 + {0}) * (b.n - b.at) >= {0} * (a.n + b.n)".format(PERCENT)
    met = mixed.where("probe").alias("a").join(members.alias("b"), (F.col("a.token") == F.col("b.token")) & F.expr(f"a.comp <> b.comp and (not b.probe or a.node < b.node) and {fits}"))
    found = work.table(met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct(), "met")
    work.drop(rows, several, mixed)
    sig = nodes.select("node", "sig")
    both = found.join(sig.toDF("u", "a"), "u").join(sig.toDF("v", "b"), "v").select("u", "v", "a", "b")
    alike = work.table(both.mapInArrow(_alike, "u binary, v binary"), "alike")
    return None if alike.isEmpty() else alike


def forest(nodes: DataFrame, work: Work) -> DataFrame:
    """(key, tree, node): the members of the regions of two and more nodes, a row for each tree that has one."""
    rows = nodes.select("node", "mh", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.xxhash64("tree", F.expr(f"substring(mh, tree * {4 * DEPTH} + 1, {4 * DEPTH})"))
    rows = rows.select(key.alias("key"), "tree", "node")
    return work.table(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_several, "key long, tree int, node binary"), "regions")


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, root): of each node with a link the smallest node it is joined to.

    Stars are grown in turns: each node hands its larger neighbours to its smallest one, then its
    smaller ones; rounds grow with the logarithm of a component's size. Minima are written before
    they are joined, so that Spark can split the edges of a hub. Up to ``FEW`` links, for which
    exchanges would cost more than the work, are kept in one task.
    """
    start = work.table(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), "edges")
    few = start.count() <= FEW

    def kept(df: DataFrame, name: str) -> DataFrame:
        t = work.table(df, name)
        out = t.coalesce(1) if few else t
        out._work_path = t._work_path
        return out

    now, mark = start.coalesce(1) if few else start, None
    now._work_path = start._work_path
    for _ in range(60):
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
        least = kept(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = kept(both.join(least, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = kept(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        # Each node keeps its smallest neighbour, which gets the others.
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = kept(small, "small")
        work.drop(now, least, large, down)
        now = new
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(got)
    raise RuntimeError("components did not settle in 60 rounds")


def text_hash(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, node (the words' MD5), th (the text's), root (the component's node)."""
    work = Work(docs.sparkSession, "near")
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    slim = work.table(source.mapInPandas(released(_signatures), f"doc_id {id_type}, th binary, node binary, n long, mh binary, sig binary"), "signatures")
    per_task = slim.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("mh").alias("mh"), F.max("sig").alias("sig"))
    nodes = work.table(per_task, "nodes")
    regions = forest(nodes.select("node", "mh"), work)
    large = work.table(regions.groupBy("key").count().where(F.col("count") > SMALL).select("key", F.lit(True).alias("large")), "large")
    sorted_by = F.expr(f"substring(concat(mh, mh), (tree + 1) * {4 * DEPTH} + 1, {4 * ORDER})").alias("rot")
    tried = regions.join(large, "key", "left").where(f"large is null or tree % {STEP} = 0")
    members = tried.join(nodes.select("node", "n", "mh", "sig"), "node").select("key", sorted_by, "node", "n", "sig", F.coalesce("large", F.lit(False)).alias("large"))
    pairs = members.repartitionByRange("key", "rot").sortWithinPartitions("key", "rot").mapInArrow(released(_neighbours), "u binary, v binary, like float")
    pairs = work.table(pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("like").alias("like")), "pairs")
    crowds = work.table(regions.join(large, "key").select("key", "node"), "crowds")
    work.drop(regions)

    wanted = pairs.select("u").union(pairs.select("v")).withColumnRenamed("u", "node").union(crowds.select("node")).distinct()
    needed = work.table(wanted.join(nodes.select("node", "first_id"), "node").select("node", ident("first_id").alias("ident")), "needed")
    texts = maybe_in(source.select("text", ident("doc_id").alias("ident")), F.col("ident"), needed, F.col("ident"))
    # One document of each node; its words decide whether it is one.
    sets = texts.select("text").mapInPandas(released(_sets), "node binary, shingles array<long>")
    sets = work.table(sets.join(needed.select("node"), "node").dropDuplicates(["node"]), "sets")

    def linked(tried: DataFrame, name: str) -> DataFrame:
        a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        both = tried.join(a, "u").join(b, "v").select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("n"))
        return work.table(both.where(100 * F.col("i").cast("long") >= PERCENT * (F.col("n") - F.col("i"))).select("u", "v"), name)

    def apart(tried: DataFrame) -> DataFrame:
        """The pairs whose nodes lie in different components."""
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        told = tried.join(of("u"), "u", "left").join(of("v"), "v", "left")
        return told.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    def joined_by(found: DataFrame) -> DataFrame:
        return components(found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), work)

    ends = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"), "like").unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y"), "like"))
    ends = ends.withColumn("h", F.xxhash64("x", "y")).groupBy("x").agg(F.max(F.struct("like", "h", "y")).alias("likest"), F.max(F.struct("h", "y")).alias("other"))
    first = ends.select("x", F.explode(F.array("likest.y", "other.y")).alias("y")).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    first = work.table(first, "first")
    roots = components(linked(first, "links"), work)
    rest = work.table(apart(pairs.select("u", "v").join(first, ["u", "v"], "left_anti")), "rest")
    if not rest.isEmpty():
        found = linked(rest, "more")
        if not found.isEmpty():
            roots = joined_by(found)
    comps = crowds.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    mixed = work.table(comps.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"), "mixed")
    crowd = work.table(crowds.join(mixed, "key").select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        rows = rare_rows(sets, crowd, work)
        for whole in (False, True):
            met = rare_pairs(rows, nodes, roots, work, whole)
            found = None if met is None else linked(met, "rare")
            if found is not None and not found.isEmpty():
                roots = joined_by(found)
        work.drop(rows)
    work.drop(sets)
    joined = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = work.table(joined.join(ids, "root").select("node", "component_id", "root"), "components")
    work.drop(nodes, pairs, large, crowds, crowd, mixed, needed, first, rest)
    out = slim.select("doc_id", "th", "node", "n").join(lookup, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "node", "th", "root")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns: of each component one document, of the smallest id, stays.

    Components are told apart by their node, as unlike documents can share an id.
    """
    from pagemill.llm.exact_dedup import keep_rows

    found = near_duplicates(docs, id_col, text_col)
    nth = F.row_number().over(Window.partitionBy("root", "doc_id").orderBy("node", "th"))
    alone = F.col("n_shingles") == 0
    decided = found.where(~alone & F.col("kept")).withColumn("nth", nth).select("doc_id", F.col("th").alias("key"), (F.col("nth") == 1).alias("kept"))
    rest = found.where(alone | ~F.col("kept")).select("doc_id", F.col("th").alias("key"), alone.alias("kept"))
    return keep_rows(docs, decided.unionByName(rest), F.col(id_col), text_hash(text_col))
