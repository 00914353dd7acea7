import re

import numpy as np
from helpers import empty, odd
from pyspark.sql import functions as F

from pagemill.llm import nearest, personal

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


TEXTS = [
    "a@b.c_d@e.f a@b.c..d@e.f x@y a@b.c-@d.e", "ü a.b+c@d-e.f.g, 😀 me@x.yz.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.4 1.2.3 12345.1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (234) 567-8901 +12 +1234567890123456 +49.30.1234567-", "4111111111111111 " * 700, "7" * 5000, "a" * 50000 + "@", "@" * 3000, "+1" * 3000, "", None, "0" * 12,
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = personal.find(df, [F.col("doc_id")]).select("doc_id", personal.listed(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_terms_that_disclose(spark):
    common = ["please write a message about this topic to", "there is some information for readers at", "whoever wants can send their questions to"]
    rows = [(i, f"text {i} {common[i % 3]} anna@example.org the chairwoman Zwölfer number {i}") for i in range(6)]
    rows += [(100 + i, f"another text {i} {common[i % 3]} office{i}@example.org the person number {i}") for i in range(40)]
    rows += [(200, "Long ago Zwölfer was seen elsewhere."), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal.find(df, [F.col("doc_id"), F.col("text")])
    got = {r["doc_id"]: [r["text"][t["start"] : t["end"]] for t in r["terms"]] for r in found.collect()}
    assert all(got[i] == ["chairwoman", "Zwölfer"] for i in range(6))
    assert all(not got[i] for i in got if i >= 100)  # terms of other entities, and texts without the entity, are left alone
    clean = {r["doc_id"]: r["c"] for r in found.select("doc_id", personal.sanitise(F.col("text"), F.col("base"), F.col("terms")).alias("c")).collect()}
    assert clean[0] == f"text 0 {common[0]} <EMAIL> the   number 0" and clean[201] == ""


def test_terms_beside_rare_entities(spark):
    rows = [(i, f"some common words stand here and there {i}") for i in range(50)]
    rows += [(100, "some words: Ann Lee, here, zoe@example.org"), (101, "common words 李明 stand +49 30 1234567 there"), (102, "words bo@example.org of Ann here"), (103, "bo@example.org"), (104, "some words by xy bo@example.org")]
    found = personal.find(spark.createDataFrame(rows, "doc_id long, text string"), [F.col("doc_id"), F.col("text")]).collect()
    got = {r["doc_id"]: [r["text"][t["start"] : t["end"]] for t in r["terms"]] for r in found}
    assert got[100] == ["Lee"] and got[101] == ["李明"] and got[102] == ["of"] and got[103] == [] and got[104] == ["by", "xy"]
    assert not any(got[i] for i in range(50))


def test_personal_odd(spark):
    got = personal.digests(personal.find(odd(spark), [F.col("doc_id")])).collect()
    assert len(got) == 12
    nine = next(r for r in got if r["doc_id"] == 9)
    assert (nine["n_email"], nine["n_ip"], nine["n_phone"]) == (1, 1, 1)
    assert personal.find(empty(spark), [F.col("doc_id")]).count() == 0


def clustered(n=6000, d=24, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((40, d))
    return centre[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, d))


def test_recall(spark):
    x = clustered().astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest.search(df, F.col("id") % 20 == 0, part=500, sample=2000).toPandas()
    x = x.astype(float)
    hits = []
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert len(g) == 20 and q not in set(g["vec_id"])
        score = x @ x[q]
        assert np.allclose(g["score"], score[g["vec_id"]]) and list(g["rank"]) == list(range(1, 21))
        assert (np.diff(g["score"]) <= 0).all()
        score[q] = -np.inf
        hits.append((g["score"].to_numpy() >= np.sort(score)[-20] - 1e-12).mean())
    assert len(hits) == 300 and np.mean(hits) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = nearest.search(df, F.col("id") == 20).orderBy("rank").toPandas()
    assert list(got["vec_id"]) == list(range(20))


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (8, []), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, part int, score int")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest.search(df, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 1): 9, (0, 2): 20, (20, 1): 9, (20, 2): 0}
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    x = clustered(1000)
    near = nearest.neighbours(x, x, np.arange(1000), 8)
    size = np.bincount(nearest.balanced_parts(near, 8, np.random.default_rng(0)), minlength=8)
    assert size.min() >= 120 and size.max() <= 130


def test_recall_of_two_levels(spark, monkeypatch):
    """More parts than the first level has: each is cut again."""
    monkeypatch.setattr(nearest, "TOP", 8)
    x = clustered(8000, 24, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tree, _, _ = nearest.plan(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 24, 8000, 20, 1500, 250, nearest.Work(spark, "test"))
    assert tree.width == 8 and len(tree.below) == 8
    got = nearest.search(df, F.col("id") % 20 == 0, part=250, sample=1500).toPandas()
    score = x[::20] @ x.T
    score[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
    least = np.sort(score, 1)[:, -20]
    hits = [(g["score"].to_numpy() >= least[q // 20] - 1e-12).mean() for q, g in got.groupby("query_id")]
    assert len(hits) == 400 and np.mean(hits) >= 0.9


def test_lengths_are_searched_by_themselves(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(30)] + [(100 + i, [1.0, 1.0 * i, 3.0]) for i in range(25)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    near = {}
    for r in got:
        near.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(near) == [0, 20, 100, 120] and all(v < 100 for v in near[0] + near[20]) and all(v >= 100 for v in near[100] + near[120])
    assert near[0][:3] == [29, 28, 27] and near[120][:3] == [124, 123, 122]


def test_repeated_ids_and_few_candidates(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (3, [5.0, 1.0]), (20, [0.0, 1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0) == [(0, 1, 3, 6.0), (0, 2, 3, 3.0), (0, 3, 3, 3.0), (0, 4, 20, 1.0)]
    assert len([r for r in got if r["query_id"] == 20]) == 5


def disclosed_brute(rows):
    """{id: spans} of (id, text) by the definitions: PMI and information over distinct texts, terms within the window."""
    import math

    texts = {t or "" for _, t in rows}
    near, n_t, n_e, both = {}, {}, {}, {}
    for t in texts:
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            n_t[w] = n_t.get(w, 0) + 1
        spans = [s.split(":") for s in brute(t).split(",") if s]
        said = {}
        for kind, a, b in spans:
            a, b = int(a), int(b)
            value = t[a:b].lower() if kind == "email" else re.sub("[^0-9]", "", t[a:b])
            left, right = re.split(r"[\W_]+", t[max(0, a - 48) : a]), re.split(r"[\W_]+", t[b : b + 48])
            words = (left[1:] if a > 48 else left) + (right[:-1] if b + 48 < len(t) else right)
            said.setdefault((kind, value), set()).update(w.lower() for w in words if len(w) >= 4 or re.search(r"[^\W\d_]", w))
        near[t] = said
        for e, words in said.items():
            n_e[e] = n_e.get(e, 0) + 1
            for w in words:
                both[e, w] = both.get((e, w), 0) + 1
    n, told = len(texts), {}
    for (e, w), c in both.items():
        ic, pmi = math.log(n / n_e[e]), math.log(n * c / (max(n_t.get(w, 0), c) * n_e[e]))
        if ic > 0 and pmi >= personal.THRESHOLD * ic - 1e-12:
            told.setdefault(e, set()).add(w)
    out = {}
    for i, t in rows:
        t = t or ""
        base = [(int(a), int(b)) for _, a, b in (s.split(":") for s in brute(t).split(",") if s)]
        words = set().union(*[told.get(e, set()) for e in near[t]])
        found = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m.group().lower() in words]
        out[i] = [(a, b) for a, b in found if not any(a < d and c < b for c, d in base)]
    return out


def test_disclosing_terms_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if t is None or t.isprintable() or i % 3 == 0][:600] + [(10**6 + i, f"call Jane Roe at +49 30 123456{i % 7} or jane@example.org now {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(t["start"], t["end"]) for t in r["terms"]] for r in personal.find(df, [F.col("doc_id")]).collect()}
    want = disclosed_brute(rows)
    assert got == want and sum(map(len, want.values())) > 30


def test_many_ties_give_k_a_query_and_block(spark):
    """4000 equal vectors and some others: ties go to the smallest ids, and no block puts out more than k for a query."""
    v = [1.0, 2.0, -1.0]
    rows = [(i, v if i % 5 else [0.5 * (i % 7), 0.5, 0.25]) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("id") % 500 == 1).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    same = [i for i in range(5000) if i % 5]
    assert sorted(by) == list(range(1, 5000, 500))
    for q, found in by.items():
        want = [i for i in same if i != q][:20]
        assert [f[1] for f in sorted(found)] == want and {f[2] for f in found} == {6.0}
    rng = np.random.default_rng(2)
    c, q = np.concatenate([np.ones((400, 2)), rng.normal(size=(200, 2))]), rng.normal(size=(3, 2))
    ids = rng.permutation(600)
    i, j = (a.ravel() for a in np.indices((3, 600)))
    gi, gj, gs = nearest._first(i, j, q, c, ids, 5)
    for row in range(3):
        want = sorted((-float(s), int(n)) for s, n in zip(nearest.dot(q[row], c), ids))[:5]
        assert [(-float(s), int(ids[n])) for n, s in zip(gj[gi == row], gs[gi == row])] == want
