"""Small tables with what breaks operators, and brute-force versions."""

import re
from collections import defaultdict

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "src0", 58),
    (2, "The  quick brown fox\tjumps over the lazy dog and runs away.", "en", "src1", 59),
    (2, "The  quick brown fox\tjumps over the lazy dog and runs away.", "en", "src1", 59),
    (3, None, None, None, None),
    (4, "", "en", "src0", 0),
    (5, " \t\n", "en", None, 3),
    (None, "A text without an id, long enough to have some shingles in it.", "en", "src0", 60),
    (None, "A text without an id, long enough to have some shingles in it.", "en", "src0", 60),
    (7, "word " * 60000, "en", "src0", 300000),
    (8, "x" * 100000, None, "src2", 100000),
    (9, "12 345 <|im_start|> <|endoftext|> a@b.c +1 (234) 567-8901 1.2.3.4", "en", "src3", 60),
    (10, "Ünïcödé ÇA VA? é́ 힣 \U0001f600", "fr", "src3", 20),
]


def odd(spark):
    """The odd rows with columns whose names clash with those of the operators."""
    return spark.createDataFrame([r + (0, "k", True, "n") for r in ODD], DOCS + ", h long, key string, kept boolean, node string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_brute(rows):
    """{doc_id: (set size, component, kept)} of (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    by, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in by[s]:
                shared[j] += 1
            by[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
