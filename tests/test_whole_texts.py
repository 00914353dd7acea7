import random
import time
from difflib import SequenceMatcher

from pagemill.functions import matching
from pagemill.plans import state_queries


def test_string_similarity_reads_whole_texts(spark, tmp_path):
    head = "The same forty characters at the head of both. "
    texts = [head + "one two three", head + "six", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ratio"] for r in state_queries.string_similarity(spark, str(tmp_path)).collect()}
    want = round(SequenceMatcher(None, texts[1].lower(), texts[0].lower()).ratio(), 6)
    assert got == {1: want, 2: 0.0} and want < 1


def _texts(rng, letters, a, b):
    """Two texts, half of the time the second made of the first by some changes."""
    first = "".join(rng.choices(letters, k=a))
    if rng.random() < 0.5:
        return first, "".join(rng.choices(letters, k=b))
    second = first
    for _ in range(rng.randrange(8)):
        at, to = sorted(rng.randrange(len(second) + 1) for _ in range(2))
        second = second[:at] + rng.choice(["", "".join(rng.choices(letters, k=9)), second[at:to] * 2]) + second[to:]
    return first, second


def test_matching_equals_difflib(monkeypatch):
    rng = random.Random(5)
    alphabets = ["ab", "abc é", "abcdefghijklmnopqrstuvwxyz  eeeeaaa", "".join(map(chr, range(0x4E00, 0x4F00)))]
    pairs = [_texts(rng, rng.choice(alphabets), *(rng.choice([0, 1, 5, 40, 199, 200, 201, 450]) for _ in range(2))) for _ in range(600)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [matching.ratio(a, b) for a, b in pairs] == want
    monkeypatch.setattr(matching, "MOST", 100)  # most texts are left to difflib
    assert [matching.ratio(a, b) for a, b in pairs] == want


def test_matching_of_long_texts_is_quick():
    rng = random.Random(6)
    a, b = ("".join(rng.choices("abcdefghijklmnoprstu" * 12 + "ABCDEFGHIJKL.,;!?", k=20_000)) for _ in range(2))
    t = time.perf_counter()
    got = matching.ratio(a, b)
    middle = time.perf_counter()
    assert got == SequenceMatcher(None, a, b).ratio()
    assert 4 * (middle - t) < time.perf_counter() - middle
