"""Conversation repair against all edit sequences tried one by one."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from helpers import SF
from pyspark.sql import functions as F

from pagemill.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, copies long, part string"


def brute(codes):
    """(cost, letters) by breadth over costs and strings: all sequences of edits up to a bound."""
    best = None
    stack = [(0, "", 0, 0)]
    while stack:
        cost, letters, state, i = stack.pop()
        if best and (cost, letters) > best and cost >= best[0] and not best[1].startswith(letters) and cost > best[0]:
            continue
        if i == len(codes) and state in (0, 3) and (best is None or (cost, letters) < best):
            best = (cost, letters)
        if letters[-2:] != "II" and letters.count("I") <= len(codes) + 2:
            stack.append((cost + 5, letters + "I", {0: 2, 1: 2, 2: 3, 3: 2}[state], i))
        if i < len(codes):
            initial, fault = divmod(codes[i], 4)
            stack.append((cost + 2, letters + "D", state, i + 1))
            if fault in (0, 3):
                more = 5 * (fault == 3)
                to = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((state, initial))
                if to:
                    stack.append((cost + more, letters + "K", to, i + 1))
                stack.append((cost + 1 + more, letters + "R", 3 if state == 2 else 2, i + 1))
    return best


def test_walk_is_the_least_of_all_cheapest_sequences():
    rng = random.Random(2)
    cases = [bytes(c) for n in range(3) for c in product(range(16), repeat=n)] + [bytes(rng.choice((0, 4, 8, 12, 5, 7, 11, 3)) for _ in range(4)) for _ in range(60)]
    walker = repair.Walker()
    for codes in cases:
        cost, [(state, letters)] = walker.walk([codes])
        assert (cost, letters) == brute(codes) and state == 0
        at = len(codes) // 2
        cost2, walks = walker.walk([codes[:at], codes[at:]])
        assert (cost2, "".join(w[1] for w in walks)) == (cost, letters)


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)} of rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            key = ":".join(" " if v is None else str(v) for v in (conv, turn))
            role, text = (" " if v is None else v for v in (role, text))
            kind = zlib.crc32(key.encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                left += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in left:
            visible = re.sub("[\x20\x09-\x0d]", "", text)
            fault = 1 if not visible else 2 if (role, text) in seen else 0 if visible[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append(4 * (("s", "u", "a").index(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault)
        turns = [t for t, _, _ in left if t is not None]
        cost, [(_, letters)] = repair.Walker().walk([bytes(codes)])
        lines = repair.repaired(0, letters, [(r, t) for _, r, t in left])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(c % 4 == f for c in codes) for f in (1, 2, 3)],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def results(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_op12(spark):
    df = queries.QUERIES["op12_conversation_repair"](spark, SF)
    kinds = dict(df.dtypes)
    assert {kinds[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} == {"bigint"}
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = results(df)
    assert got == plain(rows)
    assert sum(v[5] > 0 for v in got.values()) > 5


def conversations(seed, n):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["Yes.", "No", "Why? ", "  ", "", None, "x!\n", "é.", "Long " * 200 + "end."]
    return [(rng.choice([1, 2, 3, None, 5]), rng.choice([None, *range(12)]), rng.choice(roles[: rng.choice((2, 7))]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("rows", "chars"), [(20_000, 4_000_000), (5, 4_000_000), (20_000, 300)])
def test_odd_rows_and_cut_segments(spark, monkeypatch, rows, chars):
    monkeypatch.setattr(repair, "ROWS", rows)
    monkeypatch.setattr(repair, "CHARS", chars)
    given = conversations(rows + chars, 300) + [(7, t, ("user", "assistant")[t % 2], "Fine.") for t in range(400)] + [(8, 1, "user", "Same.")] * 50 + [(9, None, None, None)]
    df = spark.createDataFrame([(*r, 5, "clash") for r in given], SCHEMA)
    assert results(repair.audit(df)) == plain(given)


def test_empty_table_and_conversation_that_is_dropped(spark):
    assert repair.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = results(repair.audit(spark.createDataFrame([(gone, 1, "user", "Hi.", 1, "")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_is_dealt_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    dealt = repair._ordered(repair._coded(repair.damage(df))).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 2 * min(r["count"] for r in dealt)
    assert results(repair.audit(df)) == plain([tuple(r) for r in df.collect()])
