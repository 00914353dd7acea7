"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (lengths, shares of character classes, word and line repetition) are
cut into quantile bins. Trees are grown level by level from histograms of gradients; a fitted
forest is flattened into arrays (feature, threshold, children, value) that numpy walks for all
rows of a batch at once, a level a step.

The model is fitted on about ``TRAIN_ROWS`` labelled rows at most, picked by a threshold of their
hash: a fixed, documented bound. Null texts count as empty and get a score like any other text. Of several labels of one
document the larger one counts; null labels are not learned from. Without labels, or with one
class alone, every score is the (smoothed) share of the class. Repeated rows are scored each, equal
texts alike. Columns to keep must not be called as those that are added.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import Work, bounded_batches, free_names, share_of

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 120, 4, 64, 0.1, 20.0, 1.0

FEATURES = (
    "chars", "words", "word_length", "upper", "digits", "space", "line_ends", "other_ascii", "stops", "commas", "exclaims", "pipes",
    "marks", "high", "distinct_words", "longest_word", "lines", "line_length", "distinct_lines", "short_lines", "upper_words", "stop_ended_lines",
    "compressed",
)

_MARKS = np.frombuffer(b"#$%&*@^~=<>{}[]\\_", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = set(words)
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    ascii_other = count[33:127].sum() - upper - lower - count[48:58].sum()
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - count[32] - count[10]) / n_words, upper / max(upper + lower, 1), count[48:58].sum() / n,
        count[32] / n, count[10] / n, ascii_other / n, count[46] / n_words, count[44] / n_words, count[33] / n_words, count[124] / n_words,
        count[_MARKS].sum() / n_words, count[128:].sum() / n, len(distinct) / n_words, max(map(len, distinct), default=0), np.log1p(len(lines)), len(raw) / n_lines,
        len(set(lines)) / n_lines, sum(len(x) < 30 for x in lines) / n_lines, sum(w.isupper() for w in distinct) / max(len(distinct), 1), sum(x.endswith((b".", b"!", b"?")) for x in lines) / n_lines,
        len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class Forest:
    """Trees as arrays: node i of a tree goes to left[i] if its feature's value <= threshold[i], else to left[i] + 1; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.left[at] == at
                at = np.where(leaf, at, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]))
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """A forest for the logistic loss."""
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        flat = code + np.arange(d) * bins
        f = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            roots.append(len(feature))
            level = [len(feature)]
            feature.append(0), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
            for step in range(depth + 1):
                k, size = len(level), len(level) * d * bins
                live = node >= 0
                key = (node[live, None] * (d * bins) + flat[live]).ravel()
                gs = np.bincount(key, np.repeat(g[live], d), size).reshape(k, d, bins)
                hs = np.bincount(key, np.repeat(h[live], d), size).reshape(k, d, bins)
                gt, ht = gs[:, 0].sum(1), hs[:, 0].sum(1)
                for i, at in enumerate(level):
                    value[at] = float(rate * gt[i] / (ht[i] + L2))
                if step == depth:
                    break
                gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
                gr, hr = gt[:, None, None] - gl, ht[:, None, None] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (gt**2 / (ht + L2))[:, None, None]
                gain[(hl < LEAST / 20) | (hr < LEAST / 20)] = 0
                best = gain.reshape(k, -1).argmax(1)
                new, to = [], np.full((k, 2), -1)
                cut_f, cut_b = best // (bins - 1), best % (bins - 1)
                for i, at in enumerate(level):
                    j, b = int(cut_f[i]), int(cut_b[i])
                    if gain[i, j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    feature[at], threshold[at], left[at] = j, float(edges[j][b]), len(feature)
                    for side in (0, 1):
                        to[i, side] = len(new)
                        new.append(len(feature))
                        feature.append(0), threshold.append(0.0), left.append(len(feature) - 1), value.append(0.0)
                if not new:
                    break
                rows = np.flatnonzero(live)
                of = node[rows]
                node[rows] = to[of, (code[rows, cut_f[of]] > cut_b[of]).astype(int)]
                level = new
            # All rows walk the finished tree.
            at = np.full(n, roots[-1])
            fe, th, le = np.array(feature), np.array(threshold), np.array(left)
            for _ in range(depth):
                leaf = le[at] == at
                at = np.where(leaf, at, le[at] + (x[np.arange(n), fe[at]] > th[at]))
            f += np.array(value)[at]
    return Forest(base, *[np.array(v) for v in (roots, feature, threshold, left, value)], depth)


def _features(docs: DataFrame, keep: list[Column], text_col: str, then, extra: list) -> DataFrame:
    """``keep`` with the columns that ``then`` (statistics matrix -> dict of columns) gives."""
    bounded_batches(docs.sparkSession)
    free_names(docs.select(*keep), *[f.name for f in extra])
    source = docs.select(*keep, F.col(text_col).alias("__text"))

    def each(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b["__text"]], dtype=float).reshape(len(b), len(FEATURES))
            yield b.drop(columns="__text").assign(**then(x))

    return source.mapInPandas(each, T.StructType([*source.drop("__text").schema.fields, *extra]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Forest:
    """A forest for ``label_col`` of ``labels``, whose rows are all free to learn from."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    work = Work(docs.sparkSession, "quality")
    lab = work.table(lab, "labels")
    picked = work.table(share_of(lab, F.xxhash64("id", F.lit(31)), rows, lab.count()), "picked")  # about ``rows`` rows of 12 bytes
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    got = work.table(_features(known, [F.col("id"), F.col("label")], "text", lambda x: {"x": list(x)}, [T.StructField("x", T.ArrayType(T.DoubleType()))]), "features")
    got = share_of(got, F.xxhash64("id", "x"), rows, got.count()).limit(2 * rows).toPandas()  # ids may repeat, so cut again
    work.close()
    got = got.assign(key=[tuple(v) for v in got["x"]]).sort_values(["id", "key"], kind="stable")
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return grow(x, got["label"].to_numpy().astype(float))


def predict(docs: DataFrame, forest: Forest, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with score (of label 1) and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(x):
        s = sent.value.score(x)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return _features(docs, keep, text_col, scored, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
