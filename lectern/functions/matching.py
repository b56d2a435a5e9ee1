"""Matching blocks of two texts as the standard library's sequence matcher finds them, from runs that are found once.

A pair of texts is a set of places (i, j) with equal characters; those on one
diagonal that follow each other are a run.  All runs come from two sorts of interned
codes.  The longest block of any part of the pair is then the longest run cut to that
part, so the recursion into what lies left and right of a block works on ever fewer
runs, in whole-array steps, where the library walks all places again.  Long runs come
first: where a part has one of eight characters, shorter ones cannot be its longest,
and are only looked for in parts that have none.

In texts of 200 characters or more the library does not start a block at characters
that are frequent in the second one (`autojunk`); blocks only grow over them.  That
is kept, as results depend on it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Fixed values of the library: length from which frequent characters start no block, and what is frequent.
LONG, FREQUENT = 200, 100
#: Most places of equal characters held at once (32 MB an array); pairs with more are left to the library, which needs no room for them.
PLACES = 4 << 20
#: Lengths of the stretches by which runs are looked for, long runs first, and characters times characters of parts that are compared one by one.
SEEDS, SMALL = (8, 3, 1), 100


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the stretches of k characters of both, and k: at most `most`, fewer where the numbers of that many would not fit or a text is shorter."""
    letters, known = np.unique(np.concatenate([a, b]), return_inverse=True)
    k = max(1, min(most, len(a), len(b), int(62 / np.log2(len(letters) + 1))))
    out = []
    for c in (known[: len(a)], known[len(a) :]):
        n = len(c) - k + 1
        total = c[:n].astype(np.int64)
        for d in range(1, k):
            total = total * len(letters) + c[d : d + n]
        out.append(total)
    return *out, k


def _runs(a: np.ndarray, b: np.ndarray, autojunk: bool, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """(start in a, end in a, diagonal j - i) of all runs of k characters or more, by diagonal, and k, which is `least` or less; None if there are too many places."""
    k, size = 1, len(a)
    if least > 1:
        a, b, k = _grams(a, b, least)
    order = np.argsort(b, kind="stable")
    known = b[order]
    low, high = np.searchsorted(known, a, "left"), np.searchsorted(known, a, "right")
    n = high - low
    if autojunk and len(b) >= LONG:
        n[n > len(b) // FREQUENT + 1] = 0
    total = int(n.sum())
    if total > PLACES:
        return None
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)]
    key = np.sort((j - i + size) * np.int64(size + 1) + i)
    if not total:
        return *(np.empty(0, np.int64),) * 3, k
    first = np.concatenate([[0], np.flatnonzero(key[1:] - key[:-1] != 1) + 1])
    shift, start = np.divmod(key[first], size + 1)
    return start, start + np.append(first[1:], total) - first + k - 1, shift - size, k


def _longest(a: str, b: str, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    """The longest block of two short parts, the first of equals."""
    i, j, size, before = a0, b0, 0, {}
    for x in range(a0, a1):
        now = {}
        for y in range(b0, b1):
            if a[x] == b[y]:
                n = now[y] = before.get(y - 1, 0) + 1
                if n > size:
                    i, j, size = x - n + 1, y - n + 1, n
        before = now
    return i, j, size


def blocks(a: str, b: str, autojunk: bool = True) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the matching blocks, in order, neighbouring ones joined; no closing empty block."""
    if a == b:
        return [(0, 0, len(a))] if a else []
    if not a or not b:
        return []
    junk = autojunk and len(b) >= LONG
    ca, cb = codes(a), codes(b)
    found = _runs(ca, cb, junk, 1 if junk else SEEDS[0])
    out, todo = [], [(0, len(a), 0, len(b), found)]
    while todo:
        a0, a1, b0, b1, found = todo.pop()
        if found is None:
            return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk).get_matching_blocks()[:-1]]
        start, end, shift, k = found
        i, j, size = a0, b0, 0
        if not junk and (a1 - a0) * (b1 - b0) <= SMALL:
            i, j, size = _longest(a, b, a0, a1, b0, b1)
        else:
            if len(start):
                start, end = np.maximum(np.maximum(b0 - shift, a0), start), np.minimum(np.minimum(b1 - shift, a1), end)
                some = np.flatnonzero(end >= start + k)
                if len(some) < len(start):
                    start, end, shift = start[some], end[some], shift[some]
            if len(start):
                length = end - start
                size = int(length.max())
                longest = np.flatnonzero(length == size)
                at = longest[start[longest].argmin()]  # the first in a; runs lie by diagonal, so of equal ones the first in b
                i = int(start[at])
                j = i + int(shift[at])
            elif k > 1:  # whatever is left here is shorter than k
                finer = _runs(ca[a0:a1], cb[b0:b1], False, next((n for n in SEEDS if n < k), 1))
                todo.append((a0, a1, b0, b1, finer and (finer[0] + a0, finer[1] + a0, finer[2] + b0 - a0, finer[3])))
                continue
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            out.append((i, j, size))
            if a0 < i and b0 < j:
                todo.append((a0, i, b0, j, (start, end, shift, k)))
            if i + size < a1 and j + size < b1:
                todo.append((i + size, a1, j + size, b1, (start, end, shift, k)))
    joined: list[tuple[int, int, int]] = []
    for i, j, size in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, size = *joined[-1][:2], joined.pop()[2] + size
        joined.append((i, j, size))
    return joined


def operations(a: str, b: str, autojunk: bool = True) -> list[tuple[str, int, int, int, int]]:
    """(operation, span of a, span of b) that turn a into b: equal, replace, delete or insert."""
    out, i, j = [], 0, 0
    for x, y, size in [*blocks(a, b, autojunk), (len(a), len(b), 0)]:
        if (x, y) != (i, j):
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if size:
            out.append(("equal", x, x + size, y, y + size))
        i, j = x + size, y + size
    return out


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all; 1 for two empty texts."""
    return 2.0 * sum(n for _, _, n in blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """What the ratio of two texts cannot exceed: each character, by its codes, matches as often as it stands in both."""
    if not len(a) or not len(b):
        return 0.0
    known, n = np.unique(a, return_counts=True)
    also, m = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(known, also, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(n[x], m[y]).sum()) / (len(a) + len(b))
