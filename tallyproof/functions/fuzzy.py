"""Similarity of strings by their longest common subsequence.

The subsequence's length comes from bit-parallel arithmetic on whole numbers of
any size, a few operations for each character of the longer string.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyproof.functions.text import match_key_of

# Key lengths from which containment and partial likeness count.
MIN_EXACT, MIN_PARTIAL = 4, 12
#: So few windows are measured, without counting their letters first.
FEW_WINDOWS = 8


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def common(masks: dict[str, int], m: int, b: str) -> int:
    """Length of the longest common subsequence of the masked string and `b`."""
    full = (1 << m) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return m - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common / (len(a) + len(b)); two empty strings are alike."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    # what both begin and end with is common in any case
    least = min(len(a), len(b))
    i = _alike(a, b, least)
    j = _alike(a[i:][::-1], b[i:][::-1], least - i)
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return 200.0 * (i + j + common(_masks(x), len(x), y)) / (len(a) + len(b))


def _alike(a: str, b: str, most: int) -> int:
    """How many letters both begin with, `most` at most; halved, for slices compare fast."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _most_in_common(a: str, b: str, m: int, start: np.ndarray) -> np.ndarray:
    """For each window b[i : i + m] of those that begin at `start`, how many letters of `a`
    it can share at most, counted letter by letter."""
    codes = _codes(b).astype(np.int64)
    n = len(codes)
    lo, hi = np.clip(start, 0, n), np.clip(start + m, 0, n)
    out = np.zeros(len(lo), np.int64)
    for c, times in Counter(a).items():
        total = np.concatenate([[0], np.cumsum(codes == ord(c))])
        out += np.minimum(total[hi] - total[lo], times)
    return out


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The best ratio of the shorter string with any window of its length in the
    longer one, windows that hang over an end included, if it is above `floor` (else
    `floor`). An empty string is like nothing but another. Windows whose letters can't
    beat the best so far are passed over, the most promising come first."""
    if not a or not b:
        return 100.0 if a == b else floor
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    best = floor
    for x, y in ((a, b), (b, a))[: 1 + (len(a) == len(b))]:
        m, n = len(x), len(y)
        start = np.arange(1 - m, n)
        width = np.minimum(start + m, n) - np.maximum(start, 0)
        # windows that are too short anyway aren't even counted
        hopeful = 200.0 * width / (m + width) > best
        start, width = start[hopeful], width[hopeful]
        if len(start) <= FEW_WINDOWS and m <= 2_000:
            best = max([best, *(ratio(x, y[max(i, 0) : i + m]) for i in start.tolist())])
            continue
        most = 200.0 * _most_in_common(x, y, m, start) / (m + width)
        masks = None
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] <= best:
                break
            i = int(start[k])
            masks = masks or _masks(x)
            window = y[max(i, 0) : i + m]
            best = max(best, 200.0 * common(masks, m, window) / (m + len(window)))
    return best


def _within(key: str, claim: str) -> bool:
    """`claim` in `key` with no word character right before or behind it."""
    at, n = key.find(claim), len(claim)
    while at >= 0:
        if not (at and _of_word(key[at - 1])) and not (at + n < len(key) and _of_word(key[at + n])):
            return True
        at = key.find(claim, at + 1)
    return False


def _of_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def _starts(a: str, b: str) -> set[int]:
    """Where in `b` the shorter `a` would begin if a piece of it that stands there stood in
    its place. Alike to 95, they differ in less than a ninth of its letters, so that one of
    one more pieces than that is whole: without a start they aren't."""
    n = len(a) // 9 + 1
    size, found = len(a) // n, set()
    for j in range(n) if size else ():
        piece = a[j * size : (j + 1) * size]
        at = b.find(piece)
        while at >= 0:
            found.add(at - j * size)
            at = b.find(piece, at + 1)
    return found


def _score(claim: str, texts: tuple[str, ...], floor: float) -> float:
    """Short ones are remembered, for they come again; long ones would fill the memory."""
    return (_score_known if len(claim) + sum(map(len, texts)) <= 500 else _score_of)(claim, texts, floor)


def _score_of(claim: str, texts: tuple[str, ...], floor: float) -> float:
    k = match_key_of(claim)
    if not k:
        return 0.0
    best = 0.0
    for key in map(match_key_of, texts):
        if len(k) >= MIN_EXACT and _within(key, k):
            return 100.0
        starts = _starts(*sorted((k, key), key=len)) if floor >= 94.9 else None
        if starts is not None and not starts:
            continue
        if 200.0 * min(len(k), len(key)) > max(best, floor) * (len(k) + len(key)):
            best = max(best, ratio(k, key))
        if len(k) >= MIN_PARTIAL:
            if starts is None or len(k) == len(key):
                best = partial_ratio(k, key, max(best, floor))
            else:
                best = max(best, windows_score(*sorted((k, key), key=len), sorted(starts), floor))
    return best if best > floor else 0.0


_score_known = lru_cache(maxsize=20_000)(_score_of)


@F.pandas_udf(DoubleType())
def claim_score(claim: pd.Series, joined: pd.Series, apart: pd.Series, floor: pd.Series) -> pd.Series:
    """How well cited text bears a claim out; null where the claim is. `apart` is the
    cited text in its other form, or null. Figures that aren't above `floor` are 0: with
    a high one, hardly any window of a long text has to be looked at."""
    rows = zip(claim, joined, apart, floor, strict=True)
    return pd.Series([None if c is None else _score(c, tuple(t for t in (j, a) if t is not None), f) for c, j, a, f in rows], dtype="float64")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def windows_score(a: str, b: str, starts: list[int], least: float = 95.0) -> float:
    """The best ratio of `a` with the windows of its length of `b` that can reach `least`, one of `a`'s pieces
    beginning at a place of `b` that puts `a` at one of `starts`."""
    if a in b:
        return 100.0
    m = len(a)
    room = int(2 * m * (1.000001 - least / 100))
    best, done, masks = 0.0, 1 - m, None
    own = {a[i : i + 4] for i in range(m - 3)}
    for s in starts:
        lo, hi = max(s - 2 * room, done), min(s + room, len(b) - 1)
        if lo > hi:
            continue
        # a letter taken out spoils four runs of four letters at most, one put in three
        part = b[max(lo, 0) : hi + m]
        if len(own.difference([part[i : i + 4] for i in range(len(part) - 3)])) > 4 * room:
            continue
        masks = masks or _masks(a)
        # no window has more of `a` in order than all of them together
        if common(masks, m, part) < least * m / (200 - least) - 1e-3:
            done = hi + 1
            continue
        for i in range(lo, hi + 1):
            window = b[max(i, 0) : i + m]
            if window and 200.0 * min(m, len(window)) / (m + len(window)) > best:
                best = max(best, 200.0 * common(masks, m, window) / (m + len(window)))
        done = hi + 1
    return best
