"""Similarity of two strings by matching blocks, worked out for many pairs at once.

The longest common block is taken (the first one in the first string, then in the second), then the same to
its left and to its right. All open stretches of all pairs take one step together, so the work per step is a
few array operations, not a loop over pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells (stretches times characters) that one step holds.
CELLS = 1 << 21
#: From this length of the second string on, its characters above 1 % open no block, they may only widen one. So few places
#: are left that a pair is matched by itself, by dictionary; a table of all places would be filled in vain.
LONG = 200
#: Bins of the character counts; characters of the runs that are counted besides.
BINS, RUN = 64, 3


class _Texts:
    """Code points of strings, one after another."""

    def __init__(self, texts: Sequence[str]):
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) for t in texts]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.points = np.concatenate([*parts, np.zeros(1, np.int32)])

    def rows(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, fill: int) -> np.ndarray:
        """One row per stretch, filled up where it is shorter than the longest."""
        at = np.arange((high - low).max())
        inside = at < (high - low)[:, None]
        where = np.where(inside, (self.start[text] + low)[:, None] + at, len(self.points) - 1)
        return np.where(inside, self.points[where], fill)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in each row of `a`, start in `b` and size of the longest common block."""
    size, i0, j0 = (np.zeros(len(a), np.int64) for _ in range(3))
    run = np.zeros((len(a), b.shape[1] + 1), np.int64)
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (a[:, i : i + 1] == b)
        at = run.argmax(axis=1)
        top = run[np.arange(len(a)), at]
        more = top > size
        size = np.where(more, top, size)
        i0, j0 = np.where(more, i - top + 1, i0), np.where(more, at - top, j0)
    return i0, j0, size


def matched(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Number of characters in the matching blocks of each pair."""
    long = np.array([len(y) >= LONG for y in second], bool)
    total = np.zeros(len(long), np.int64)
    total[~long] = _matched_short([x for x, k in zip(first, long) if not k], [y for y, k in zip(second, long) if not k])
    for k, plain in _one_by_one(first, second, long):
        total[k] = sum(block.size for block in plain.get_matching_blocks())
    return total


def _one_by_one(first: Sequence[str], second: Sequence[str], which: np.ndarray):
    plain, last = SequenceMatcher(None), None
    for k in sorted(np.flatnonzero(which).tolist(), key=second.__getitem__):
        if second[k] != last:
            last = second[k]
            plain.set_seq2(last)
        plain.set_seq1(first[k])
        yield k, plain


def _reaches(plain: SequenceMatcher, least: int) -> bool:
    """Whether the matching blocks have `least` characters; the longest open stretch is matched next, until this is settled."""
    whole = min(len(plain.a), len(plain.b))
    total, left, open_ = 0, whole, [(-whole, 0, len(plain.a), 0, len(plain.b))]
    while open_ and total < least <= total + left:
        most, alo, ahi, blo, bhi = heapq.heappop(open_)
        i, j, n = plain.find_longest_match(alo, ahi, blo, bhi)
        total, left = total + n, left + most
        for side in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if n else ():
            if (size := min(side[1] - side[0], side[3] - side[2])) > 0:
                heapq.heappush(open_, (-size, *side))
                left += size
    return total >= least


def _matched_short(first: list[str], second: list[str]) -> np.ndarray:
    a, b = _Texts(first), _Texts(second)
    total = np.zeros(len(a.size), np.int64)
    pair = np.flatnonzero((a.size > 0) & (b.size > 0))
    todo = np.stack([pair, np.zeros_like(pair), a.size[pair], np.zeros_like(pair), b.size[pair]])
    while todo.shape[1]:
        todo = todo[:, np.argsort((todo[2] - todo[1]) * (1 << 32) + todo[4] - todo[3])]
        cells = np.maximum.accumulate(todo[4] - todo[3]) * np.arange(1, todo.shape[1] + 1)
        then, low = [], 0
        while low < todo.shape[1]:
            # as many stretches as fit; those of one step are about equally long
            high = max(low + 1, int(np.searchsorted(cells - (cells[low - 1] if low else 0), CELLS)))
            high = min(high, max(low + 1, int(np.searchsorted(todo[2] - todo[1], 2 * (todo[2, low] - todo[1, low]) + 8))))
            k, alo, ahi, blo, bhi = todo[:, low:high]
            i, j, n = _longest(a.rows(k, alo, ahi, -1), b.rows(k, blo, bhi, -2))
            i, j = alo + i, blo + j
            np.add.at(total, k, n)
            for sides in ((k, alo, i, blo, j), (k, i + n, ahi, j + n, bhi)):
                open_ = (n > 0) & (sides[1] < sides[2]) & (sides[3] < sides[4])
                then.append(np.stack(sides)[:, open_])
            low = high
        todo = np.concatenate(then, axis=1)
    return total


def ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Twice the matched characters by all characters; 1 for two empty strings."""
    both = np.array([len(x) + len(y) for x, y in zip(first, second)], np.int64)
    return np.where(both > 0, 2.0 * matched(first, second) / np.maximum(both, 1), 1.0)


def char_counts(texts: Sequence[str]) -> np.ndarray:
    """Characters of each text by bin."""
    if len(texts) > 1 and sum(map(len, texts)) > CELLS:
        half = len(texts) // 2
        return np.concatenate([char_counts(texts[:half]), char_counts(texts[half:])])
    t = _Texts(texts)
    cell = np.repeat(np.arange(len(t.size)), t.size) * BINS + t.points[:-1] % BINS
    return np.bincount(cell, minlength=len(t.size) * BINS).reshape(-1, BINS)


def most_ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """An upper bound of the ratio from character counts, which never rejects a pair wrongly."""
    a, b = char_counts(first), char_counts(second)
    both = a.sum(axis=1) + b.sum(axis=1)
    return np.where(both > 0, 2.0 * np.minimum(a, b).sum(axis=1) / np.maximum(both, 1), 1.0)


def _run_counts(texts: _Texts, which: np.ndarray, bits: int) -> np.ndarray:
    """Runs of `RUN` characters of the texts `which` by bin of their hash."""
    many = np.maximum(texts.size[which] - RUN + 1, 0)
    at = np.repeat(texts.start[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    h = np.zeros(len(at), np.uint64)
    for k in range(RUN):
        h = (h + texts.points[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    cell = (np.repeat(np.arange(len(which)), many) << bits) + (h >> np.uint64(64 - bits)).astype(np.int64)
    found = np.bincount(cell, minlength=len(which) << bits).reshape(-1, 1 << bits)
    return found.astype(np.uint16 if many.max(initial=0) < 1 << 16 else np.int32)


def may_match(first: Sequence[str], second: Sequence[str], least: np.ndarray) -> np.ndarray:
    """Whether strings have runs enough in common to match in `least` characters, in order; never rejects a pair wrongly.

    A character that isn't matched spoils at most `RUN` runs of its own string and parts `RUN` - 1 of the other one.
    """
    code, different = pd.factorize(np.concatenate([np.asarray(first, object), np.asarray(second, object)]))
    texts, x, y = _Texts(different), code[: len(first)], code[len(first) :]
    n, m = texts.size[x], texts.size[y]
    need = (2 * RUN - 1) * np.asarray(least) - (RUN - 1) * (n + m + 1) - 1e-6
    out = need <= np.maximum(np.minimum(n, m) - RUN + 1, 0)
    bits = np.log2(np.maximum(n, m) + 1).astype(np.int64) + 2
    for width in np.unique(bits[out & (need > 0)]):
        open_ = np.flatnonzero(out & (need > 0) & (bits == width))
        step = max(1, CELLS >> int(width) + 1)
        for low in range(0, len(open_), step):
            k = open_[low : low + step]
            which, back = np.unique(np.concatenate([x[k], y[k]]), return_inverse=True)
            counts = _run_counts(texts, which, int(width))
            out[k] = np.minimum(counts[back[: len(k)]], counts[back[len(k) :]]).sum(axis=1, dtype=np.int64) >= need[k]
    return out


def alike(first: Sequence[str], second: Sequence[str], cutoff: float, counted: bool = False) -> np.ndarray:
    """Whether the ratio reaches `cutoff`; the blocks of a pair are sought only if its counts of characters (unless these are
    `counted` before) and of short runs allow it."""
    first, second = np.asarray(first, object), np.asarray(second, object)
    out, both = np.zeros(len(first), bool), np.array([len(a) + len(b) for a, b in zip(first, second)], np.int64)
    open_ = np.arange(len(first)) if counted or not len(first) else np.flatnonzero(most_ratios(first, second) >= cutoff)
    if len(open_):
        open_ = open_[may_match(first[open_], second[open_], cutoff / 2 * both[open_])]
    if not len(open_):
        return out
    # the fewest characters with which the ratio reaches the cutoff
    least = np.floor(cutoff / 2 * both).astype(np.int64) - 1
    for _ in range(3):
        least += 2.0 * least / np.maximum(both, 1) < cutoff
    long = np.array([len(b) >= LONG for b in second[open_]], bool)
    short = open_[~long]
    out[short] = ratios(first[short], second[short]) >= cutoff
    for k, plain in _one_by_one(first, second, np.isin(np.arange(len(first)), open_[long])):
        out[k] = _reaches(plain, int(least[k]))
    return out


def within_edits(first: Sequence[str], second: Sequence[str], edits: int) -> np.ndarray:
    """Whether at most `edits` characters put in, left out or changed make one string the other. Only that band of the
    table is worked out, for many pairs at once; a pair above the bound leaves."""
    first, second = np.asarray(first, object), np.asarray(second, object)
    out = np.zeros(len(first), bool)
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (first, second))
    open_ = np.flatnonzero(np.abs(n - m) <= edits)
    if len(open_):
        open_ = open_[may_match(first[open_], second[open_], np.maximum(n, m)[open_] - edits)]
    open_ = open_[np.argsort(n[open_], kind="stable")]
    low = 0
    while low < len(open_):
        # as many pairs as fit; those of one step are about equally long
        top = n[open_[low:]]
        high = low + max(1, min(int(np.searchsorted(top, 2 * top[0] + 8, "right")), int(np.searchsorted(np.cumsum(top + 1), CELLS >> 2))))
        k = open_[low:high]
        out[k] = _banded(first[k], second[k], edits)
        low = high
    return out


def _banded(first: np.ndarray, second: np.ndarray, edits: int) -> np.ndarray:
    a, b = _Texts(first), _Texts(second)
    out, k = np.zeros(len(first), bool), np.arange(len(first))
    left = a.rows(k, np.zeros_like(k), a.size, -1)
    right = np.pad(b.rows(k, np.zeros_like(k), b.size, -2), ((0, 0), (edits, left.shape[1] + 2 * edits)), constant_values=-2)
    far = 2 * edits + 1
    band = np.tile(np.where(np.arange(far) < edits, far, np.arange(far) - edits), (len(k), 1))
    for i in range(left.shape[1] + 1):
        if i:
            then = band + (left[:, i - 1 : i] != right[:, i - 1 : i - 1 + far])
            then[:, :-1] = np.minimum(then[:, :-1], band[:, 1:] + 1)
            for d in range(1, far):
                then[:, d] = np.minimum(then[:, d], then[:, d - 1] + 1)
            band = then
        done = a.size[k] == i
        out[k[done]] = band[done, (b.size[k] - a.size[k] + edits)[done]] <= edits
        stay = ~done & (band.min(axis=1) <= edits)
        if not stay.all():
            k, left, right, band = k[stay], left[stay], right[stay], band[stay]
        if not len(k):
            break
    return out


def block_ratio(first: Column, second: Column, cutoff: float = 0.0) -> Column:
    """The ratio as a column; null where it stays below `cutoff` or a side is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        x, y = a.to_numpy(object)[known], b.to_numpy(object)[known]
        near = most_ratios(x, y) >= cutoff if len(known) else np.zeros(0, bool)
        if near.any():
            out[known[near]] = ratios(x[near], y[near])
        return pd.Series(out).where(out >= cutoff)

    return run(first, second)
