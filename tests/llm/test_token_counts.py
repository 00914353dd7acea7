"""Token counts against the tokenizers library itself."""

import json
import random

import public_tokenizers
import pytest
from helpers import ODD, SF, empty, odd
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import queries, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter(tok):
    with open(FILE, encoding="utf-8") as f:
        spec = f.read()
    added, ranks = token_counts.checked(spec), token_counts.reachable(tok, spec)
    return token_counts.Counter(tok, added, ranks, token_counts.whole_tokens(tok, ranks, added))


def library(tok, texts):
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


#: What pre-token rules turn on: contractions, kinds of blanks, classes that versions of Unicode differ in, added tokens.
PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "a", "Z", "é", "1", "٣", "!", "<|endoftext|>", "<|endo", "你", "\U0001f600", "՘", "꟎", " ", "'s", "'re", "don't", "\x1c", "\x85", "²", "_", "é", "\x00"]


def test_random_texts_equal_the_library(counter, tok):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(20000)]
    assert counter.counts(texts).tolist() == library(tok, texts)
    assert counter.counts(texts[:500], 7).tolist() == library(tok, texts[:500])  # texts are cut and blocks are small


def test_every_vocabulary_string_and_long_words(counter, tok):
    texts = [t.replace("Ġ", " ") for t in tok.get_vocab()] + ["x" * 50000, " " * 50000 + "a", "né" * 400, "ab\n" * 3000, None, ""]
    assert counter.counts(texts).tolist() == library(tok, texts)


def test_odd_and_empty_tables(spark, tok):
    got = token_counts.count(odd(spark), FILE, [F.struct("*").alias("row")])
    want = sorted(zip((len((r[1] or "").encode()) for r in ODD), library(tok, [r[1] for r in ODD])))
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got.collect())
    assert token_counts.count(empty(spark), FILE, [F.col("doc_id")]).collect() == []
    with pytest.raises(ValueError, match="columns to keep"):
        token_counts.count(odd(spark).withColumn("n_tokens", F.lit(1)), FILE, [F.col("n_tokens")])


def test_other_tokenizers_are_refused(spark, tmp_path):
    with open(FILE, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level BPE"):
            token_counts.count(odd(spark), str(path), [F.col("doc_id")])


def test_op11(spark, tok):
    df = queries.QUERIES["op11_token_counts"](spark, SF)
    kinds = dict(df.dtypes)
    assert (kinds["n_bytes"], kinds["n_tokens"], kinds["over_limit"]) == ("bigint", "bigint", "boolean")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library(tok, list(docs.values()))))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()} == {i: (len(t.encode()), want[i], want[i] > 1024) for i, t in docs.items()}
