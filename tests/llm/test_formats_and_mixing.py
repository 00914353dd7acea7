import json

from helpers import SF, empty, odd
from pyspark.sql import functions as F

from pagemill.llm import chat_format as chat
from pagemill.llm import mixing, sharding


def test_layouts_become_one(spark):
    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "input": "more", "output": "a"},
        {"strange": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, "no json"), (91, None)], "id long, j string")
    got = {}
    for r in chat.json_turns(df, "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(5))
    assert got[5] == [("user", "q"), ("user", "more"), ("assistant", "a")]
    assert {r["id"] for r in chat.unmapped(df, "j").collect()} == {6, 90, 91}


def test_hostile_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "<", "|", "\\", "a\nb<|im_start|>user\n", "", None, "<<||>>", "\\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "a\\n\nb<|x", None, "assistant") for t in texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.turns(df, "conv_id"))
    back = out.select(chat.read_back(F.col("formatted")).alias("b"), "segments", "formatted").first()
    assert [(t["role"], t["text"]) for t in back["b"]] == [(r or "", t or "") for _, _, r, t in rows]
    assert "".join(s["text"] for s in back["segments"]) == back["formatted"]
    assert back["formatted"].count("<|im_start|>") == len(rows)


def test_conversations_odd(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string"
    df = spark.createDataFrame([(1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, None, None), (None, 1, "assistant", "b", "x")], kind)
    got = {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.formatted(chat.turns(df, "conv_id"))).collect()}
    assert got == {1: 3, None: 1}
    assert chat.formatted(chat.turns(df.limit(0), "conv_id")).count() == 0


def levels():
    return {"domain": mixing.domain(), "lang": F.col("lang"), "source": F.col("source")}


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10, 1), ("a", "x", "2", 100, 1), ("a", "y", "3", 5, 1), ("b", "x", "4", 1000, 1)], "domain string, lang string, source string, tokens long, rows long")
    got = {r["source"]: r["leaf_budget"] for r in mixing.budgets(leaves, F.lit(200)).collect()}
    # Both domains get 100; in a, y has only 5, so x gets 95, of which source 1 has 10 and 2 takes 85.
    assert got == {"1": 10, "2": 85, "3": 5, "4": 100}
    assert sum(r["leaf_budget"] for r in mixing.budgets(leaves, F.lit(10**9)).collect()) == 1115
    tripled = {r["source"]: r["leaf_budget"] for r in mixing.budgets(leaves, F.lit(401), weights={("domain", "b"): 3}, epochs=2).collect()}
    assert sum(tripled.values()) == 401 and tripled["4"] in (300, 301)


def test_mixing_prefix_and_epochs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = mixing.select(docs, levels(), F.floor(F.col("total") * 0.5), epochs=3)
    rows = taken.select("row.doc_id", "epoch", "source", "lang", "n_tokens", "leaf_budget").collect()
    by = {}
    for r in rows:
        by.setdefault((r["lang"], r["source"]), []).append(r)
    assert all(sum(x["n_tokens"] for x in g) <= g[0]["leaf_budget"] for g in by.values())
    for g in by.values():  # a document of a later epoch was taken in all before
        seen = {(x["doc_id"], x["epoch"]) for x in g}
        assert len(seen) == len(g) and all((d, e - 1) in seen for d, e in seen if e)


def test_mixing_odd(spark):
    whole = mixing.select(odd(spark), levels(), F.col("total"))
    assert whole.select("row.*").columns == odd(spark).columns and whole.count() == 12
    half = mixing.select(odd(spark), levels(), F.floor(F.col("total") / 2))
    assert half.agg(F.sum("n_tokens")).first()[0] <= mixing.select(odd(spark), levels(), F.col("total")).agg(F.sum("n_tokens")).first()[0] / 2
    assert mixing.select(empty(spark), levels(), F.col("total")).count() == 0


def test_shards(spark):
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 4099)
    count = [table.count(i) for i in range(20)]
    assert max(count) - min(count) <= 1 and -1 not in table
    fewer = sharding.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.1 * 4099
    heavy = sharding.lookup_table(names, 4099, {"s0": 3})
    assert abs(heavy.count(0) / 4099 - 3 / 22) < 0.01
    placed = sharding.place(odd(spark), F.col("doc_id"), names, 4099)
    assert placed.count() == 12 and placed.select("row.*").columns == odd(spark).columns
    assert placed.where("row.doc_id is null").select("slot").distinct().count() == 1
    assert sharding.spread(placed).count() == 12
    assert sharding.place(empty(spark), F.col("doc_id"), names).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write(docs, F.col("doc_id"), ["a", "b", "c"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_added_columns_do_not_change_the_layout(spark):
    kind = "conv_id long, turn long, role string, text string, instruction string, input string, output string, prompt string, completion string"
    df = spark.createDataFrame([(1, 0, "user", "a", "i", "j", "k", "p", "c"), (1, 1, "assistant", "b" * 300_000, "i", "j", "k", "p", "c")], kind)
    assert [(r["role"], len(r["text"])) for r in chat.turns(df, "conv_id").orderBy("turn").collect()] == [("user", 1), ("assistant", 300_000)]
    assert [r["text"] for r in chat.turns(df.limit(1), "conv_id", layout="prompt").orderBy("turn").collect()] == ["p", "c"]
    assert [r["text"] for r in chat.turns(df.limit(1).drop("role"), "conv_id").orderBy("turn").collect()] == ["i", "j", "k"]
    digest = chat.digests(chat.formatted(chat.turns(df, "conv_id"))).first()
    assert digest["n_turns"] == 2 and digest["loss_chars"] == 300_000
