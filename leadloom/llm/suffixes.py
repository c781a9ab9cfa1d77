"""Suffix arrays by induced sorting and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the end counts as smallest of all."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    at = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return (at < n - 1) & (t[at] < t[np.minimum(at + 1, n - 1)])


def _next_other(small: np.ndarray) -> np.ndarray:
    """For each position, how far the next suffix of the other type is; the end counts as one."""
    n = len(small)
    last = np.append(small[1:] != small[:-1], True)
    return np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1] + 1 - np.arange(n)


def _place(places: np.ndarray, at: np.ndarray, far: np.ndarray) -> None:
    """Sort the suffixes `at`, all of one type, by what follows them up to the next of the other type.

    places has for each position the head of the part of the suffix array it is known to lie in: the
    part of its type in its symbol's bucket at first. The next suffix of the other type is in its
    own place already. All buckets are filled at once: the suffixes in one part are parted by the
    places one step ahead, then two, four and so on, as far as the type goes on. Suffixes in
    one part at the end are equal up to and including the place of the next one of the other type.
    """
    wide, step = len(places), 1
    while len(at):
        key = places[at] * wide + places[at + step] + 1
        order = np.argsort(key)
        at, key = at[order], key[order]
        head = places[at]
        index = np.arange(len(at))
        bucket = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), index, 0))
        new = np.append(True, key[1:] != key[:-1])
        group = np.maximum.accumulate(np.where(new, index, 0))
        places[at] = head + group - bucket
        step *= 2
        at = at[~(new & np.append(new[1:], True)) & (far[at] >= step)]


def _induce(heads: np.ndarray, small: np.ndarray, far: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places of all suffixes from those of the leftmost-smaller ones, in `places`.

    First the larger-type suffixes are placed from the heads of their buckets, each by the suffix
    after it, a leftmost-smaller one in the end; then all smaller-type ones, each by the larger-type
    one at the end of its run.
    """
    _place(places, np.flatnonzero(~small), far)
    s = np.flatnonzero(small)
    places[s] = heads[s]
    _place(places, s, far)
    return places


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of t (non-negative integers) in order.

    Suffixes are of larger or smaller type than the one after them. The substrings from each
    leftmost smaller one to the next are sorted by induction from unsorted ones and named by their
    rank; where names repeat, the string of names is sorted in the same way, so the leftmost-smaller
    suffixes are in order, and all others follow by induction.
    """
    t = np.asarray(t, np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _smaller(t)
    far = _next_other(small)
    kind = 2 * t + small
    sizes = np.bincount(kind)
    heads = (np.cumsum(sizes) - sizes)[kind]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    places = np.append(heads, -1)
    if len(lms) > 1:
        found = _induce(heads, small, far, places.copy())[lms]
        order = np.argsort(found)
        names = np.empty(len(lms), np.int64)
        names[order] = np.cumsum(np.append(False, found[order][1:] != found[order][:-1]))
        if names[order[-1]] + 1 < len(lms):
            order = suffix_array(names)
        # Leftmost-smaller suffixes of a bucket stand one after the other from its smaller part's head.
        sorted_heads = heads[lms[order]]
        index = np.arange(len(order))
        bucket = np.maximum.accumulate(np.where(np.append(True, sorted_heads[1:] != sorted_heads[:-1]), index, 0))
        places[lms[order]] = sorted_heads + index - bucket
    places = _induce(heads, small, far, places)
    out = np.empty(n, np.int64)
    out[places[:n]] = np.arange(n)
    return out


def common_prefixes(raw: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position in text order: the bytes it has in common with the suffix before it in `order`.

    No more than `room` (bytes up to the row's end) of either. In text order a common prefix is one
    shorter than the last, unless the two are preceded by different bytes; so only these
    (irreducible) ones are compared, eight bytes at a time, and the others are filled in.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    reducible[1:] &= (before[1:] == before[:-1] + 1) & (raw[:-1] == raw[before[1:] - 1]) & (room[1:] == room[:-1] - 1) & (room[before[1:]] == room[before[:-1]] - 1)
    start = np.flatnonzero(~reducible)
    other = before[start]
    most = np.where(other < 0, 0, np.minimum(room[start], room[other]))
    padded = np.append(raw, np.zeros(16, np.uint8))
    words = np.ndarray((len(raw) + 8,), "<u8", padded.data, 0, (1,))
    length = np.zeros(len(start), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        x = words[start[active] + length[active]] ^ words[other[active] + length[active]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        length[active] += same
        active = active[(same == 8) & (length[active] < most[active])]
    length = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    place = np.empty(n, np.int64)
    place[start] = length
    return np.maximum(place[source] - (at - source), 0)
