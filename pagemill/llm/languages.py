"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (a byte-level one, so
every text can be segmented). A word's probability in a language is the sum over all its
segmentations of the product of their pieces' probabilities; the forward algorithm computes it.
A text's score is the sum of its words' logarithms over all its words; the language with the
largest sum is predicted, with its posterior under equal priors as score.

Training: expected piece counts from the forward-backward algorithm, a few rounds of EM, each a
distributed aggregate whose result has at most (pieces x languages) rows. Every language's shares are
mixed with ``SHARED`` parts of one background, the mean of all languages and a little of every piece,
so what no language knows is equally likely in all, however little text one has. The model is fitted
on a sample of at most about ``SAMPLE`` labelled rows a language, picked by hash; nothing else is
sampled. For the counts alone, words over ``LONG`` bytes are cut into runs of whole characters.

Words are runs of letters in lower case. Texts that are null or hold no letter get ``und`` and 0.
Texts of any length are scored whole; words over ``LONG`` bytes are scored one by one with
rescaling. Without a labelled row nothing can be learned, and every text is ``und``. Of languages
with equal sums the first in order is taken. Repeated rows are scored each. Columns to keep must not
be called as those that are added; in a struct they can have any names.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Work, bounded_batches, free_names, released

#: Labelled rows a language that a model is fitted on.
SAMPLE = 4000
ROUNDS = 3
#: Bytes of the longest piece that is used, and of the longest word that is scored in a block.
PIECE, LONG = 12, 48
#: The background's part in every language, and the part of the background that all pieces share.
SHARED, ALL = 0.1, 0.01
#: Words kept per task before its table of scores is emptied.
CACHED = 400_000
UNKNOWN = "und"
UNIFORM = float(np.log(1 / 256))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_BITS = 20


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file (base64 piece, rank a line) that can occur in a word."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(x.split()[0]) for x in lines if x.strip()}
    # All single bytes are pieces, so every word can be segmented.
    keep = {p for p in pieces if len(p) <= PIECE and _wordlike(p)} | {bytes([i]) for i in range(256)}
    return sorted(keep)


def _wordlike(piece: bytes) -> bool:
    s = piece.decode("utf-8", "ignore")
    s = s[1:] if s.startswith(" ") else s
    return bool(s) and s == s.lower() and all(c.isalpha() for c in s)


class Pieces:
    """Finds pieces by hash: two tables of 2^20 places, the second for what collides in the first."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        raw = np.zeros(self.n, np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(pieces):
                h = np.uint64(0)
                for b in p:
                    h = h * _BASE + np.uint64(b + 1)
                raw[i] = h
        if len(np.unique(raw)) != self.n:
            raise ValueError("two pieces share a hash")
        self.keys = raw
        self.first = np.full(1 << _BITS, -1, np.int32)
        self.second = np.full(1 << _BITS, -1, np.int32)
        one, two = _places(raw, 0), _places(raw, 1)
        for i in range(self.n):
            if self.first[one[i]] < 0:
                self.first[one[i]] = i
            elif self.second[two[i]] < 0:
                self.second[two[i]] = i
            else:
                raise ValueError("the piece tables are too small for this vocabulary")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of the piece with each hash; ``n`` if there is none."""
        a = self.first[_places(h, 0)]
        hit = (self.keys[a] == h) & (a >= 0)
        out = np.where(hit, a, self.n)
        rest = np.flatnonzero((a >= 0) & ~hit)  # a piece is in the second table only if its first place was taken
        b = self.second[_places(h[rest], 1)]
        out[rest] = np.where((b >= 0) & (self.keys[b] == h[rest]), b, self.n)
        return out


def _places(h: np.ndarray, table: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h * _MIX[table] >> np.uint64(64 - _BITS)).astype(np.int64)


def _blocks(words: list[bytes], front: bytes = b" "):
    """(indices, matrix of bytes) of words of one length, a space put in front."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, idx in by.items():
        for s in range(0, len(idx), 4096):
            part = idx[s : s + 4096]
            yield part, np.frombuffer(b"".join(front + words[i] for i in part), np.uint8).reshape(len(part), n + len(front))


def _runs(word: bytes) -> list[bytes]:
    """A word cut into runs of at most ``LONG`` bytes, no character torn."""
    out, at = [], 0
    while len(word) - at > LONG:
        end = at + LONG
        while end > at + LONG - 4 and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def _piece_grid(pieces: Pieces, m: np.ndarray):
    """{(start, end): piece index of each word}, by rolling hashes."""
    out, n = {}, m.shape[1]
    with np.errstate(over="ignore"):
        codes = m.astype(np.uint64) + np.uint64(1)
        for s in range(n):
            h = np.zeros(len(m), np.uint64)
            for e in range(s, min(n, s + PIECE)):
                h = h * _BASE + codes[:, e]
                out[s, e + 1] = pieces.find(h)
    return out


def word_scores(pieces: Pieces, probs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log probability (words x languages); ``probs`` is (pieces + 1) x languages, its last row zero."""
    out = np.empty((len(words), probs.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for part, m in _blocks([words[i] for i in short]):
        n = m.shape[1]
        alpha = np.zeros((n + 1, len(m), probs.shape[1]))
        alpha[0] = 1
        for (s, e), found in sorted(_piece_grid(pieces, m).items()):
            rows = np.flatnonzero(found < pieces.n)
            if len(rows) > len(found) // 2:
                alpha[e] += alpha[s] * probs[found]
            else:
                alpha[e][rows] += alpha[s][rows] * probs[found[rows]]
        out[[short[i] for i in part]] = np.log(np.maximum(alpha[n], 1e-300))
    for i in set(range(len(words))) - set(short):
        out[i] = _long_score(pieces, probs, words[i])
    return out


def _long_score(pieces: Pieces, probs: np.ndarray, word: bytes) -> np.ndarray:
    """The forward sum of one long word, rescaled at every byte."""
    codes = np.frombuffer(b" " + word, np.uint8).astype(np.uint64) + np.uint64(1)
    n, h, found = len(codes), np.zeros(len(codes), np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(PIECE):  # pieces of k + 1 bytes that begin at each place
            if k >= n:
                break
            h = h[: n - k] * _BASE + codes[k:]
            found.append(pieces.find(h))
    window, log = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for e in range(1, n + 1):
        a = sum(window[-k - 1] * probs[found[k][e - k - 1]] for k in range(min(len(window), len(found))))
        scale = np.maximum(a, 1e-300)
        log += np.log(scale)
        window = [w / scale for w in window[-(PIECE - 1) :]] + [a / scale]
    return log


def expected_counts(pieces: Pieces, probs: np.ndarray, words: list[bytes], lang: np.ndarray, weight: np.ndarray, n_lang: int) -> np.ndarray:
    """(pieces x languages) expected counts of the pieces over all segmentations, by forward-backward.

    Of a word over ``LONG`` bytes each run counts by itself.
    """
    out = np.zeros((pieces.n + 1, n_lang))
    first = [(_runs(w)[0] if len(w) > LONG else w, i) for i, w in enumerate(words)]
    later = [(r, i) for i, w in enumerate(words) if len(w) > LONG for r in _runs(w)[1:]]
    for runs, front in ((first, b" "), (later, b"")):
        for part, m in _blocks([r for r, _ in runs], front):
            rows = np.array([runs[i][1] for i in part])
            of, w, n = lang[rows], weight[rows], m.shape[1]
            grid = sorted(_piece_grid(pieces, m).items())
            p = {k: probs[f, of] for k, f in grid}
            alpha, beta = np.zeros((n + 1, len(m))), np.zeros((n + 1, len(m)))
            alpha[0], beta[n] = 1, 1
            for (s, e), _ in grid:
                alpha[e] += alpha[s] * p[s, e]
            for (s, e), _ in reversed(grid):
                beta[s] += beta[e] * p[s, e]
            scale = w / np.maximum(alpha[n], 1e-300)
            for (s, e), f in grid:
                np.add.at(out, (f, of), alpha[s] * beta[e] * p[s, e] * scale)
    return out[: pieces.n]


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    probs: np.ndarray  # (pieces + 1) x languages

    @classmethod
    def start(cls, languages: list[str], pieces: Pieces, lengths: np.ndarray) -> Model:
        """Equal for all languages, shorter pieces likelier."""
        p = 4.0 ** -lengths.astype(float)
        return cls(languages, pieces, _with_none(np.repeat((p / p.sum())[:, None], len(languages), 1)))


def _with_none(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def smoothed(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Shares of the pieces in each language (a column), mixed with one background; a language without counts is the background."""
    total = counts.sum(0)
    own = counts / np.maximum(total, 1e-300)
    shared = (1 - ALL) * own.sum(1, keepdims=True) / max(1, (total > 0).sum()) + ALL * start
    out = np.where(total > 0, (1 - SHARED) * own + SHARED * shared, shared)
    return out / out.sum(0)


def letters(text: Column) -> Column:
    """The runs of letters in lower case, one space between; null texts have none."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def fit(docs: DataFrame, vocabulary_path: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model of the languages in ``docs``, whose rows are all free to learn from."""
    spark, work = docs.sparkSession, Work(docs.sparkSession, "languages")
    lab = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = {r["lang"]: r["n"] for r in lab.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    vocab = vocabulary(vocabulary_path)
    model = Model.start(sorted(size), Pieces(vocab), np.array([len(p) for p in vocab]))
    if not size:
        return model
    share = F.lit(0.0)
    for name, n in size.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = lab.where(F.pmod(F.xxhash64(F.col("id"), F.lit(29)), F.lit(1_000_000)) < share * 1_000_000)
    number = {name: i for i, name in enumerate(model.languages)}

    def words(batches):
        import pandas as pd

        for b in batches:
            count: dict = {}
            for lang, text in zip(b["lang"], b["text"]):
                at = count.setdefault(number[lang], {})
                for w in text.split():
                    at[w] = at.get(w, 0) + 1
            yield pd.DataFrame([(k, w, n) for k, at in count.items() for w, n in at.items()], columns=["lang", "word", "n"])

    counted = picked.select("lang", letters(F.col("text")).alias("text")).mapInPandas(released(words), "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Each round reads it in as many tasks as there are cores: its rows are few, the work on each is much.
    table = work.table(counted.repartition(spark.sparkContext.defaultParallelism, "word"), "words")
    start = model.probs[:-1, :1]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model.pieces, model.probs))

        def count(batches, sent=sent, n_lang=len(size)):
            import pandas as pd

            pieces, probs = sent.value
            total = np.zeros((pieces.n, n_lang))
            for b in batches:
                total += expected_counts(pieces, probs, [w.encode() for w in b["word"]], b["lang"].to_numpy(), b["n"].to_numpy().astype(float), n_lang)
            i, j = np.nonzero(total)
            yield pd.DataFrame({"piece": i.astype(np.int32), "lang": j.astype(np.int32), "n": total[i, j]})

        got = table.mapInPandas(released(count), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        new = np.zeros((model.pieces.n, len(size)))
        new[got["piece"], got["lang"]] += got["n"]
        model = Model(model.languages, model.pieces, _with_none(smoothed(new, start)))
        sent.unpersist()
    return model


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score and fit, a row per row of ``docs``; only ``keep`` and the text are read.

    ``fit`` is the best language's log probability per byte of the letters; under ``UNIFORM`` a
    text is told worse than by random bytes, so it is in none of the languages.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, letters(F.col(text_col)).alias("__text"))
    free_names(kept, "lang_pred", "score", "fit")
    fields = kept.drop("__text").schema
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.probs))

    def score(batches):
        languages, pieces, probs = sent.value
        names, cache, table = np.array([*languages, UNKNOWN], dtype=object), {}, np.empty((len(languages), 0))
        for b in batches:
            sums = np.zeros((len(b), len(languages)))
            ok = (b["__text"] != "").to_numpy() & (len(languages) > 0)
            for at in _parts(b["__text"]):
                if len(cache) > CACHED:
                    cache, table = {}, table[:, :0]
                texts = [t.encode().split() if f else [] for t, f in zip(b["__text"].iloc[at], ok[at])]
                table = _learned(cache, table, texts, pieces, probs)
                size = np.array([len(t) for t in texts])
                of = np.fromiter(map(cache.__getitem__, chain.from_iterable(texts)), np.int64, size.sum())
                full = np.flatnonzero(size)
                for k in range(len(languages) if len(full) else 0):
                    sums[at.start + full, k] = np.add.reduceat(table[k][of], (np.cumsum(size) - size)[full])
            out = b.drop(columns="__text")
            best = np.where(ok, sums.argmax(1) if len(languages) else 0, len(languages))
            top = sums.max(1, keepdims=True) if len(languages) else sums
            share = 1 / np.exp(np.maximum(sums - top, -700)).sum(1) if len(languages) else np.zeros(len(b))
            out["lang_pred"] = names[best]
            out["score"] = np.where(ok, share, 0.0)
            size = b["__text"].str.encode("utf-8").str.len().to_numpy()
            out["fit"] = np.where(ok, top[:, 0] if len(languages) else 0.0, 0.0) / np.maximum(size, 1)
            yield out

    from pyspark.sql import types as T

    return kept.mapInPandas(released(score), T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]))


def _parts(texts, most: int = 2_000_000):
    """Slices of the batch of about ``most`` characters, one text at least."""
    begin = total = 0
    for i, n in enumerate(texts.str.len()):
        total += n
        if total >= most:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _learned(cache: dict, table: np.ndarray, texts: list[list[bytes]], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """``table`` (languages x words) with a column for each new word; ``cache`` gets their numbers."""
    new = list(set(chain.from_iterable(texts)).difference(cache))
    if not new:
        return table
    cache.update(zip(new, range(table.shape[1], table.shape[1] + len(new))))
    return np.hstack([table, word_scores(pieces, probs, new).T])
