import random

from helpers import SF, empty, near_brute, odd, shingles
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, near_dedup
from pagemill.llm.common import maybe_in, told_apart


def test_exact_odd_rows(spark):
    got = exact_dedup.classes(odd(spark)).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[1] == [(1, 3, True)] and by[2] == [(1, 3, False)] * 2
    assert by[3] == [(3, 2, True)] and by[4] == [(3, 2, False)]
    assert by[5] == [(5, 1, True)]
    assert sorted(x[2] for x in by[None]) == [False, True]
    assert exact_dedup.classes(empty(spark)).count() == 0


def test_exact_dedup_keeps_whole_rows(spark):
    got = exact_dedup.dedup(odd(spark))
    assert got.columns == odd(spark).columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 1, 3, 5, 7, 8, 9, 10]
    again = odd(spark).unionByName(odd(spark))
    assert exact_dedup.dedup(again).count() == 8
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_key_filter_loses_nothing(spark):
    df, keys = spark.range(5000), spark.range(0, 5000, 7)
    got = {r["id"] for r in maybe_in(df, F.col("id"), keys, F.col("id")).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 1200


def planted(n=60, seed=3):
    """Families of edited texts around the threshold, copies, a passage that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage, rows, i = [word() for _ in range(60)], [], 0
    for f in range(n):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))]
        for edits in (0, 0, 1, 2, 4, 8, 16):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append((i, ("  " if edits % 2 else " ").join(w).title() if edits == 1 else " ".join(w)))
            i += 1
    for _ in range(300):
        rows.append((i, " ".join([word() for _ in range(rng.randint(20, 60))] + passage)))
        i += 1
    for _ in range(400):  # one large group of near copies
        w = passage * 2
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
        i += 1
    return rows


def test_near_equals_brute_force(spark):
    rows = planted() + [(100_000, ""), (100_001, None), (100_002, " \n"), (100_003, "A"), (100_004, "a")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_brute(rows)


def crowd(n=900, linked=60, seed=5):
    """A group of ``n`` near copies, and documents that only just reach some of them, or only just do not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join([*base[:100], word(), *base[101:]])) for i in range(n)]
    for i in range(n, n + linked):
        w = rows[rng.randrange(n)][1].split()
        for k in (20, 45, 60, 75, 125, 150)[: rng.randint(3, 6)]:
            w[k] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_near_links_of_a_crowded_region(spark):
    rows = crowd()
    want = near_brute(rows)
    assert sum(c == 0 for _, c, _ in want.values()) > 920 and any(c > 0 for _, c, _ in want.values())
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_near_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[3]["n_shingles"] == 0 and by[3]["kept"]
    kept = near_dedup.dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 7, 8, 9, 10]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.dedup(empty(spark)).count() == 0


def test_near_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_brute(rows)


def passage_crowd(n, linked=100, seed=11):
    """Texts of one passage and some own words, 0.70 alike, with partners at 59/77 and 61/75; {doc_id: component}."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(8))
    passage = [word() for _ in range(60)]
    rows = [(i, passage + [word() for _ in range(12)]) for i in range(n)]
    want = {i: i for i in range(n)}
    for k in range(2 * linked):
        w = list(rows[k][1])
        w[-9] = word()
        w[-4 if k % 2 else -2] = word()
        rows.append((n + k, w))
        want[n + k] = k
    return [(i, " ".join(w)) for i, w in rows], want


def test_near_links_within_a_common_passage(spark):
    rows, want = passage_crowd(6000)
    a, b, c = (shingles(rows[i][1]) for i in (0, 6000, 6001))
    assert len(a & b) / len(a | b) == 61 / 75 and len(shingles(rows[1][1]) & c) / len(shingles(rows[1][1]) | c) == 59 / 77
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_dedup_tells_unlike_texts_of_one_id_apart(spark):
    rows = [(1, "one text with its own words and no other like it here"), (1, "quite another story told in words that nobody else has used"), (2, "a third of them that shares nothing at all with those before")]
    assert near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3


def test_bitmap_holds_every_key(spark):
    df = spark.range(300_000)
    keys = spark.range(0, 300_000, 3)
    assert maybe_in(df, F.col("id"), keys, F.col("id")).where("id % 3 = 0").count() == 100_000


def test_rows_are_told_apart_without_loss(spark):
    df = spark.createDataFrame([(i if i % 10 else None, i) for i in range(2000)], "id long, row long")
    keys = spark.range(0, 2000, 7)
    may, sure = told_apart(df, F.col("id"), keys, F.col("id"))
    a, b = [r["row"] for r in may.collect()], [r["row"] for r in sure.collect()]
    assert sorted(a + b) == list(range(2000)) and {i for i in range(0, 2000, 7) if i % 10} <= set(a) and len(a) < 500 and all(i in b for i in range(0, 2000, 10))


def test_components_of_any_graph(spark, monkeypatch):
    from pagemill.llm.common import Work

    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 600)] + [(i, i + 1) for i in range(700, 800)] + [(5, 5)]
    parent = {i: i for e in edges for i in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i: root(i) for i in parent if root(i) != i}
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (0, 10**6):
        monkeypatch.setattr(near_dedup, "FEW", few)
        got = {r["node"]: r["root"] for r in near_dedup.components(df, Work(spark, "test")).collect()}
        assert got == want
    assert near_dedup.components(df.limit(0), Work(spark, "test")).count() == 0
