"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their successor; the
leftmost-smaller (LMS) substrings are sorted by one induction, named, and their
reduced string is sorted the same way, again and again until no name repeats; a
second induction then fills the array from the order of the LMS suffixes.

Over bytes an induction runs through the buckets of the alphabet in turn; inside a
bucket, all suffixes that are ready are taken at once, which makes as many array
steps as the longest run of one symbol.  Names are too many for a step a bucket:
there the L suffixes are ordered from the LMS suffixes that end their runs, and then
the S suffixes from the L suffixes behind theirs, all runs side by side.
"""

from __future__ import annotations

import numpy as np


def _spread(array: np.ndarray, fill: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> None:
    """Put suffixes ``at`` into their symbols' buckets, in order, at the moving ends ``fill``."""
    if len(at) == 0:
        return
    by = np.argsort(symbols, kind="stable")
    s = symbols[by]
    starts = np.flatnonzero(np.diff(s, prepend=-1))
    sizes = np.diff(np.append(starts, len(s)))
    offset = np.arange(len(s)) - np.repeat(starts, sizes)
    array[fill[s] + step * offset] = at[by]
    fill[s[starts]] += step * sizes


def _induce(s: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The array induced from LMS suffixes given in order."""
    n, size = len(s), len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    array = np.full(n, -1, np.int32)
    # LMS suffixes stand at the ends of their buckets, in order.
    fill = ends - 1
    _spread(array, fill, s[seeds[::-1]].astype(np.int16), seeds[::-1], -1)
    lms_from = fill + 1

    def emit(found: np.ndarray, c: int, fill: np.ndarray, step: int, want_s: bool) -> np.ndarray:
        """Predecessors of the type wanted; those in bucket c are returned, the others placed."""
        before = found[found > 0] - 1
        before = before[is_s[before] == want_s]
        symbols = s[before]
        own = symbols == c
        there = before[own]
        if len(there):
            array[fill[c] + step * np.arange(len(there))] = there
            fill[c] += step * len(there)
        rest = ~own
        _spread(array, fill, symbols[rest].astype(np.int16), before[rest], step)
        return there

    fill = begins.copy()
    if n and not is_s[n - 1]:
        array[fill[s[n - 1]]] = n - 1
        fill[s[n - 1]] += 1
    for c in range(size):
        ready = array[begins[c] : fill[c]]
        while len(ready):
            ready = emit(ready, c, fill, 1, False)
        emit(array[lms_from[c] : ends[c]], c, fill, 1, False)
    l_to = fill
    fill = ends - 1
    for c in range(size - 1, -1, -1):
        ready = array[fill[c] + 1 : ends[c]][::-1]
        while len(ready):
            ready = emit(ready, c, fill, -1, True)
        emit(array[begins[c] : l_to[c]][::-1], c, fill, -1, True)
    return array


def _classified(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S, LMS positions): S where the next different symbol is larger; a run at the end is L."""
    change = np.flatnonzero(s[1:] != s[:-1])
    is_s = np.zeros(len(s), bool)
    if len(change):
        is_s[: change[-1] + 1] = np.repeat(s[change] < s[change + 1], np.diff(change, prepend=-1))
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _ranked_runs(at: np.ndarray, key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the positions ``at`` by the keys from each to its ``end``, whose
    own key is settled.  Ranks are places in the order, the first for positions that tie."""
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    group = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, np.arange(len(at)), 0))
    rank = np.zeros(len(end), np.int64)
    rank[order] = group
    length, step = end[at] - at, 1
    while step <= length.max(initial=0):
        tied = np.zeros(len(at) + 1, bool)
        tied[1:-1] = group[1:] == group[:-1]
        open_ = np.flatnonzero(tied[:-1] | tied[1:])
        open_ = open_[end[order[open_]] - order[open_] >= step]
        if not len(open_):
            break
        p = order[open_]
        key = rank[p] * len(end) + rank[np.minimum(p + step, end[p])]
        by = np.argsort(key, kind="stable")
        key = key[by]
        order[open_] = p[by]
        group[open_] = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, open_, 0))
        rank[order[open_]] = group[open_]
        step *= 2
    return order, rank


def _induce_runs(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, lms_rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, induced from the ranks of the LMS suffixes; without
    those, of each position's symbols up to the first symbol of an LMS substring."""
    n = len(s)
    place = np.arange(n)
    bucket = s.astype(np.int64) * 3 + 1 + is_s
    bucket[n - 1] -= 1  # nothing follows: the least of its bucket

    def first(which: np.ndarray) -> np.ndarray:
        """The first position from each on that is in ``which``, or the last of all."""
        return np.minimum.accumulate(np.where(which, place, n - 1)[::-1])[::-1]

    starts = np.zeros(n, np.int64)
    if lms_rank is not None:
        starts[lms] = lms_rank
    part = ~is_s
    part[lms] = True
    at = np.flatnonzero(part)
    _, rank = _ranked_runs(at, bucket[at] * (n + 1) + starts[at], first(is_s))
    return _ranked_runs(place, bucket * (n + 1) + np.where(is_s, 0, rank), first(~is_s))


def _order_of_names(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over any alphabet below its length."""
    is_s, lms = _classified(s)
    order, rank = _induce_runs(s, is_s, lms, None)
    names = rank[lms]
    kinds, names = np.unique(names, return_inverse=True)
    if len(kinds) == len(lms):
        ranks = names
    else:
        ranks = np.empty(len(lms), np.int64)
        ranks[_order_of_names(names)] = np.arange(len(lms))
    order, _ = _induce_runs(s, is_s, lms, ranks)
    return order


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of integers from 0 to ``size`` - 1, at most 255."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    s = s.astype(np.int16)
    counts = np.bincount(s, minlength=size)
    is_s, lms = _classified(s)
    lms = lms.astype(np.int32)
    if not len(lms):
        return _induce(s, is_s, lms, counts)
    first = _induce(s, is_s, lms, counts)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # Name the LMS substrings: equal ones follow one another in the induced order.
    length = np.zeros(n, np.int32)
    length[lms] = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    same = np.zeros(len(ordered), bool)
    a, b = ordered[:-1], ordered[1:]
    could = np.flatnonzero((length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1]))
    k = 0
    while len(could):
        x, y = a[could], b[could]
        going = k < length[x]
        same[could[~going] + 1] = True
        could, x, y = could[going], x[going], y[going]
        could = could[s[x + k] == s[y + k]]
        k += 1
    names = np.empty(n, np.int32)
    names[ordered] = np.cumsum(~same) - 1
    reduced = names[lms]
    if int(names[ordered[-1]]) + 1 < len(lms):
        seeds = lms[_order_of_names(reduced)]
    else:
        seeds = ordered
    return _induce(s, is_s, seeds, counts)


def permuted_lcp(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, PHI): for each position, its longest common prefix with the suffix before
    it in ``order``, and that suffix's position (-1: none).

    Where the symbols before both are equal the value is one less than that of the
    position before; only the other positions are compared, symbol blocks at a time.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    plain = (phi > 0) & (at > 0)
    reducible = np.zeros(n, bool)
    p = np.flatnonzero(plain)
    reducible[p] = s[p - 1] == s[phi[p] - 1]
    start = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int32)
    todo = start[phi[start] >= 0]
    # Eight symbols as one number, at every position.
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = s
    eight = np.ndarray(n, "<u8", padded, strides=(1,))
    while len(todo):
        x, y = todo + value[todo], phi[todo] + value[todo]
        fits = (x + 8 <= n) & (y + 8 <= n)
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        equal = fits & (eight[x] == eight[y])
        value[todo[equal]] += 8
        rest = todo[~equal]
        for _ in range(8):
            x, y = rest + value[rest], phi[rest] + value[rest]
            inside = (x < n) & (y < n)
            rest, x, y = rest[inside], x[inside], y[inside]
            rest = rest[s[x] == s[y]]
            value[rest] += 1
        todo = todo[equal]
    # A reducible value follows from the last compared position before it.
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    value = np.where(reducible, np.maximum(value[source] - (at - source), 0), value)
    return value, phi

