"""The matching-blocks ratio of two texts: the number that ``difflib.SequenceMatcher(None, a, b).ratio()`` gives.

That matcher takes the longest run of characters that are not frequent in ``b``, the first of equal ones
in ``a`` and then in ``b``, widens it, and goes on to both sides. It goes through all pairs of equal
characters again in each part. Here the starts of runs that both texts hold are listed once by length; a
part begins with the length of the part around it, as it holds no longer run, and finds a start by bisection.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

#: Starts gone through in all from which on two texts are left to difflib: they share very long runs of rare characters.
MOST = 2_000_000


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    shared = _shared(a, b)
    return SequenceMatcher(None, a, b).ratio() if shared is None else 2.0 * _matched(a, b, shared) / (len(a) + len(b))


def _shared(a: str, b: str) -> list[tuple[list[int], list[list[int]]]] | None:
    """For lengths from 1 on: the starts in ``a`` of runs of rare characters that ``b`` holds, and the starts in ``b`` of each."""
    often = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    rare = {c for c, n in Counter(b).items() if n <= often}
    in_a, in_b = ([i for i, c in enumerate(text) if c in rare] for text in (a, b))
    out, left, k = [], MOST, 1
    while in_a:
        where: dict[str, list[int]] = {}
        for j in in_b:
            where.setdefault(b[j : j + k], []).append(j)
        starts = [i for i in in_a if a[i : i + k] in where]
        places = [where[a[i : i + k]] for i in starts]
        left -= len(in_a) + len(in_b)
        if left < 0:
            return None
        if starts:
            out.append((starts, places))
        held = {a[i : i + k] for i in starts}
        in_a = [i for i in starts if a[i + k : i + k + 1] in rare]
        in_b = [j for j in in_b if b[j : j + k] in held and b[j + k : j + k + 1] in rare]
        k += 1
    return out


def _matched(a: str, b: str, shared: list) -> int:
    """The characters in all matching blocks."""
    total, todo = 0, [(0, len(a), 0, len(b), len(shared))]
    while todo:
        from_a, to_a, from_b, to_b, k = todo.pop()
        i, j, n = from_a, from_b, 0
        k = min(k, to_a - from_a, to_b - from_b)
        while k and not n:
            starts, places = shared[k - 1]
            for x in range(bisect_left(starts, from_a), bisect_left(starts, to_a - k + 1)):
                y = bisect_left(places[x], from_b)
                if y < len(places[x]) and places[x][y] + k <= to_b:
                    i, j, n = starts[x], places[x][y], k
                    break
            else:
                k -= 1
        while i > from_a and j > from_b and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < to_a and j + n < to_b and a[i + n] == b[j + n]:
            n += 1
        if n:
            total += n
            if from_a < i and from_b < j:
                todo.append((from_a, i, from_b, j, k))
            if i + n < to_a and j + n < to_b:
                todo.append((i + n, to_a, j + n, to_b, k))
    return total
