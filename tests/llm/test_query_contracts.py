"""The registered queries that have no SQL, each against brute force over a whole small table, in all columns of its contract."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from helpers import SF, near_brute
from test_personal_and_nearest import brute as base_brute
from tokenizers import Tokenizer

from pagemill.llm import languages, quality, queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return dict(df.dtypes), df.collect()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    kinds, got = rows(spark, "op1_language_id")
    assert kinds["held_out"] == "boolean" and kinds["lang_pred"] == "string" and kinds["score"] == "double"
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) >= 0.97
    # A document's sums and posterior from its words, one at a time, by the model that the query fits.
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.fit(table.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    by = {r["doc_id"]: r for r in got}
    for i in sorted(docs)[:12]:
        words = re.sub(r"[\W\d_]+", " ", (docs[i]["text"] or "").lower()).split()
        if not words:
            assert by[i]["lang_pred"] == "und"
            continue
        total = sum(languages._long_score(model.pieces, model.probs, w.encode()) for w in words)
        share = np.exp(total - total.max())
        assert by[i]["lang_pred"] == model.languages[int(total.argmax())] and np.isclose(by[i]["score"], 1 / share.sum(), atol=1e-6)


def test_op6(spark, docs):
    kinds, got = rows(spark, "op6_quality")
    assert kinds["score"] == "double" and kinds["predicted"] == "int" and sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None:
            labels[r["doc_id"]] = max(r["quality"], labels.get(r["doc_id"], 0))
    learned = sorted(i for i in labels if remainder(i, 3) != 1 and i in docs)
    x = np.array([quality.statistics(docs[i]["text"]) for i in learned])
    forest = quality.grow(x, np.array([labels[i] for i in learned], float))
    want = dict(zip(sorted(docs), forest.score(np.array([quality.statistics(docs[i]["text"]) for i in sorted(docs)]))))
    assert all(np.isclose(r["score"], want[r["doc_id"]], atol=1e-9) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(4)
    x, y = rng.random((400, 3)), rng.integers(0, 2, 400).astype(float)
    y[x[:, 1] > 0.6] = 1
    forest = quality.grow(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(j, cut):
        left = x[:, j] <= cut
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
        return part(left) + part(~left) - part(np.ones(len(y), bool))

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    best = max((gain(j, c), j, c) for j in range(3) for c in edges[j])
    assert (forest.feature[0], forest.threshold[0]) == (best[1], pytest.approx(best[2]))


def test_op7(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kinds, got = rows(spark, "op7_bpe")
    assert kinds["n_tokens"] == "bigint" and sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ids = tok.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op8(spark, docs):
    kinds, got = rows(spark, "op8_near_dedup")
    assert (kinds["n_shingles"], kinds["component_id"], kinds["kept"]) == ("bigint", "bigint", "boolean")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_brute([(i, r["text"]) for i, r in docs.items()])


def test_op9(spark, docs):
    kinds, got = rows(spark, "op9_personal")
    assert kinds["n_email"] == "bigint" and kinds["spans"] == "string" and sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = base_brute(docs[r["doc_id"]]["text"])
        found = [s.split(":")[0] for s in base.split(",") if s]
        assert r["base_sha256"] == sha(base) and [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [found.count(k) for k in ("email", "ip", "card", "phone")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == [s for s in base.split(",") if s]


def test_op10(spark):
    kinds, got = rows(spark, "op10_nearest")
    assert (kinds["query_id"], kinds["rank"], kinds["vec_id"], kinds["score"]) == ("bigint", "int", "bigint", "double")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [i for i in sorted(v) if i % 20 == 0]
    hits = []
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(np.isclose(s, v[q] @ v[i], rtol=1e-12) for _, i, s in found)
        score = np.where(ids == q, -np.inf, m @ v[q])
        hits.append(np.mean([s >= np.sort(score)[-20] - 1e-12 for _, _, s in found]))
    assert np.mean(hits) >= 0.95
