import hashlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, empty, odd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import bpe, languages, quality
from pagemill.llm.common import crc_mod, tokenizer_file

MULTI, WORD = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def test_forward_sums_all_segmentations():
    pieces = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"bc", b"abc", b"abab"]
    table, rng = languages.Pieces(pieces), np.random.default_rng(1)
    probs = languages._with_none(rng.random((len(pieces), 2)))
    number = {p: i for i, p in enumerate(pieces)}

    def brute(word):
        text, total = b" " + word, np.zeros(2)
        for cuts in product([0, 1], repeat=len(text) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:])]
            if all(p in number for p in parts):
                total += np.prod([probs[number[p]] for p in parts], 0)
        return np.log(total)

    for word in (b"a", b"abc", b"ababab", b"xyz"):
        assert np.allclose(languages.word_scores(table, probs, [word])[0], brute(word))
        assert np.allclose(languages._long_score(table, probs, word), brute(word))
    long = b"ab" * 200
    assert np.isfinite(languages.word_scores(table, probs, [long])).all()


def test_expected_counts_cover_the_words():
    pieces = [bytes([i]) for i in range(256)] + [b"ab"]
    table = languages.Pieces(pieces)
    probs = languages._with_none(np.full((len(pieces), 1), 0.01))
    got = languages.expected_counts(table, probs, [b"ab"], np.array([0]), np.array([2.0]), 1)
    assert np.isclose((got[:, 0] * [len(p) for p in pieces]).sum(), 2 * 3)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod("doc_id", 4) == 2
    model = languages.fit(docs.where(~held), tokenizer_file(MULTI))
    got = languages.predict(docs.where(held), model, [F.col("doc_id"), F.col("lang")]).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.97
    rest = {r["doc_id"]: r for r in languages.predict(odd(spark), model, [F.col("doc_id")]).collect()}
    assert rest[3]["lang_pred"] == rest[4]["lang_pred"] == rest[5]["lang_pred"] == "und" and rest[3]["score"] == 0
    assert rest[1]["lang_pred"] == "en" and 0 <= rest[8]["score"] <= 1
    odd_script = spark.createDataFrame([(1, "漢字仮名交じり文を読む人")], "doc_id long, text string")
    assert languages.predict(odd_script, model, [F.col("doc_id")]).first()["fit"] < languages.UNIFORM
    assert languages.predict(empty(spark), model, [F.col("doc_id")]).count() == 0
    none = languages.fit(empty(spark), tokenizer_file(MULTI))
    assert languages.predict(odd(spark).where("doc_id = 1"), none, [F.col("doc_id")]).first()["lang_pred"] == "und"


PLAIN = {
    "en": "The committee published its annual report on Monday.", "de": "Der Ausschuss hat am Montag seinen Jahresbericht vorgestellt.",
    "fr": "Le comité a publié son rapport annuel lundi dernier.", "es": "El comité publicó su informe anual el lunes pasado.",
}


def test_plain_sentences_whatever_the_shares_of_languages(spark):
    """Models of few texts of a language do not win what none of them knows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.createDataFrame([(k, t) for k, t in PLAIN.items()], "key string, text string")
    few = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0
    for kept in (F.lit(True), (F.col("lang") != "es") | few, (F.col("lang") != "en") | few):
        model = languages.fit(docs.where(kept), tokenizer_file(MULTI))
        got = {r["key"]: r["lang_pred"] for r in languages.predict(rows, model, [F.col("key")]).collect()}
        assert got["en"] == "en" and got["de"] == "de" and got["es"] in ("es", "en") and list(got.values()).count("es") <= 2


def test_long_words_are_learned_from():
    pieces = [bytes([i]) for i in range(256)] + ["語".encode()]
    table = languages.Pieces(pieces)
    probs = languages._with_none(np.full((len(pieces), 1), 0.01))
    word = ("語" * 40).encode()
    assert all(len(r) <= languages.LONG for r in languages._runs(word)) and b"".join(languages._runs(word)) == word
    assert all(r.decode() for r in languages._runs(word))
    got = languages.expected_counts(table, probs, [word], np.array([0]), np.array([1.0]), 1)
    assert np.isclose((got[:, 0] * [len(p) for p in pieces]).sum(), len(word) + 1) and got[-1, 0] > 39


def test_shares_have_one_floor():
    counts, start = np.array([[90.0, 1.0, 0.0], [10.0, 0.0, 0.0], [0.0, 0.0, 0.0]]), np.full((3, 1), 1 / 3)
    p = languages.smoothed(counts, start)
    assert np.allclose(p.sum(0), 1) and np.isclose(p[2, 0], p[2, 1]) and p[2, 0] > 0 and p[1, 2] > p[2, 2]


def test_bpe_equals_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(WORD))
    docs = odd(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    extra = spark.createDataFrame([(500_000 + i, t) for i, t in enumerate(["a b   c", "\x1cA\x1d b\x85c", "İstanbul ΣΊΣΥΦΟΣ", "don't WE'LL <|startoftext|>x<|endoftext|>", "ẛ̣ ﬁ"])], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    got = bpe.encode(docs, tokenizer_file(WORD), [F.col("doc_id"), F.col("key"), F.md5(F.coalesce("text", F.lit(""))).alias("t")], decoded=True).collect()
    want = {}
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest())] = (ids, tok.decode(ids, skip_special_tokens=False))
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["t"]): (list(r["ids"]), r["decoded"]) for r in got} == want
    assert bpe.encode(empty(spark), tokenizer_file(WORD), [F.col("doc_id")]).count() == 0


def test_bpe_decode_join(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(WORD))
    ids = tok.encode("Some text, to decode!", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, tokenizer_file(WORD)).collect()} == {1: tok.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_packed_numbers():
    n = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1])
    assert list(bpe.unpack(bpe.pack(n))) == list(n) and list(bpe.unpack(b"")) == []


def test_blocks_of_any_size(spark):
    texts = ["a b c " * 5, "", "d " * 40, "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tok = Tokenizer.from_file(public_tokenizers.path(WORD))
    for block in (1, 50, 10**6):
        got = bpe.encode(df, tokenizer_file(WORD), [F.col("doc_id")], block=block)
        assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_blocks_hold_so_many_characters(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    class Here:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Here))
    texts = ["a b c " * 5, "", "d " * 40, "e"]
    kept, words = pa.array([{"doc_id": i} for i in range(4)]), pa.array([t.split(" ") for t in texts], pa.list_(pa.string()))
    schema = pa.schema([("kept", kept.type), ("block", pa.int64()), ("codes", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary())])
    out = pa.Table.from_batches(bpe._blocks(iter([pa.RecordBatch.from_arrays([kept, words], ["kept", "words"])]), 4, 50, schema)).to_pylist()
    docs = [r for r in out if r["words"] is None]
    assert [r["kept"]["doc_id"] for r in docs] == [0, 1, 2, 3] and len({r["block"] for r in docs}) == 3


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 2.0)], "doc_id long, text string, score double")
    model = languages.fit(empty(spark), tokenizer_file(MULTI))
    with pytest.raises(ValueError):
        languages.predict(df, model, [F.col("score")])
    assert languages.predict(df, model, [F.struct("score", "text").alias("row")]).first()["row"]["score"] == 2.0
    with pytest.raises(ValueError):
        bpe.encode(df, tokenizer_file(WORD), [F.col("doc_id").alias("ids")])
    assert bpe.encode(df, tokenizer_file(WORD), [F.col("doc_id").alias("block"), F.col("score").alias("words")]).first()["block"] == 1


def test_other_tokenizers_are_refused(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for call in (lambda: bpe.encode(df, tokenizer_file("byte_bpe_50k.json"), [F.col("doc_id")]), lambda: bpe.decode(df, tokenizer_file("byte_bpe_50k.json"), "text")):
        with pytest.raises(ValueError):
            call()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 3) == 1
    forest = quality.fit(docs, labels.where(~held))
    got = quality.predict(docs.join(labels.where(held), "doc_id"), forest, [F.col("doc_id"), F.col("quality")]).toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
    odd_scores = [r["score"] for r in quality.predict(odd(spark), forest, [F.col("doc_id"), F.col("key")]).collect()]
    assert len(odd_scores) == 12 and all(0 <= s <= 1 for s in odd_scores)
    assert quality.predict(empty(spark), forest, [F.col("doc_id")]).count() == 0
    plain = quality.fit(docs, labels.where("quality = 1").withColumn("quality", F.lit(1)))
    assert len(plain.roots) == 0
    nothing = quality.fit(empty(spark), labels.limit(0))
    assert quality.predict(odd(spark).limit(1), nothing, [F.col("doc_id")]).first()["score"] == 0.5


def test_forest_walk_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)

    def walk(row, at):
        while forest.left[at] != at:
            at = forest.left[at] + int(row[forest.feature[at]] > forest.threshold[at])
        return forest.value[at]

    want = [forest.base + sum(walk(r, root) for root in forest.roots) for r in x[:100]]
    assert np.allclose(forest.score(x[:100]), 1 / (1 + np.exp(-np.array(want))))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97
