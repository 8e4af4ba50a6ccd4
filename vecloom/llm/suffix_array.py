"""Suffix arrays by induced sorting, and permuted common prefixes, with whole-array numpy steps.

Suffixes are of type S (smaller than the next) or L. The leftmost S of each run (LMS) cut the text in
substrings; those are ranked, and their ranks make a shorter text whose suffixes are sorted the same way,
recursively. From the sorted LMS suffixes all others are induced in two passes over the buckets of first
characters, in time linear in the text: the entries of a bucket place those one position to their left, a
wave at a time. A reduced text has too many buckets for that; its suffixes are ranked by the types and
characters up to their next LMS position, ties by that suffix's rank.
"""

from __future__ import annotations

import numpy as np

SMALL = 1 << 10


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The last, a unique smallest character, counts as S."""
    n = len(text)
    s = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(text[:-1] != text[1:])  # the last before the end always does
        at = differs[np.searchsorted(differs, np.arange(n - 1))]
        s[:-1] = text[at] < text[at + 1]
    return s


def rank_runs(symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of substrings, each symbols[begin : begin + length] with no symbol 0: their order, and for each its
    rank, the number of smaller ones. A substring is never the beginning of another."""
    bits = int(symbols.max()).bit_length()
    per = max(1, 63 // bits)
    padded = np.concatenate([symbols, np.zeros(per, symbols.dtype)]).astype(np.int64)

    def key(which: np.ndarray, at: int) -> np.ndarray:
        b, left = begin[which] + at, length[which] - at
        k = np.zeros(len(which), np.int64)
        for j in range(per):
            k = (k << bits) | np.where(left > j, padded[np.minimum(b + j, len(padded) - 1)], 0)
        return k

    n = len(begin)
    k = key(np.arange(n), 0)
    order = np.argsort(k, kind="stable")
    head = np.concatenate([[True], np.diff(k[order]) != 0]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = per
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero((size[rank] > 1) & (length > at))
        if not len(tied):
            return order, rank
        k = key(tied, at)
        by = np.lexsort((k, rank[tied]))
        r, k = rank[tied][by], k[by]
        new = np.concatenate([[True], r[1:] != r[:-1]])
        step = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        offset = np.maximum.accumulate(np.where(step, np.arange(len(r)), 0)) - first
        order[r + np.arange(len(r)) - first] = tied[by]
        rank[tied[by]] = r + offset
        at += per


def lms_order(text: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The LMS suffixes in order (places in the text)."""
    if len(lms) == 1:
        return lms
    symbols = 2 * text.astype(np.int64) + s + 1
    length = np.concatenate([np.diff(lms) + 1, [1]])
    order, rank = rank_runs(symbols, lms, length)
    if (np.bincount(rank, minlength=len(rank)) <= 1).all():
        return lms[order]
    names = np.unique(rank, return_inverse=True)[1]
    return lms[suffix_array(names)]


def by_sorting(text: np.ndarray, s: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """All suffixes from the sorted LMS ones, for a text of many different characters."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[sorted_lms] = np.arange(len(lms))
    next_ = lms[np.minimum(np.searchsorted(lms, np.arange(n), "right"), len(lms) - 1)]
    _, rank = rank_runs(2 * text.astype(np.int64) + s + 1, np.arange(n), next_ - np.arange(n) + 1)
    return np.argsort(rank * len(lms) + place[next_], kind="stable")


def by_buckets(text: np.ndarray, s: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """All suffixes from the sorted LMS ones: L types left to right, then S types right to left."""
    n, sigma = len(text), int(text.max()) + 1
    size = np.bincount(text, minlength=sigma)
    tail = np.cumsum(size)
    head = tail - size
    n_large = np.bincount(text[~s], minlength=sigma)
    sa = np.full(n, -1, np.int64)
    seeds = np.bincount(text[sorted_lms], minlength=sigma)
    seed_end = np.cumsum(seeds)
    at = head.copy()

    def place(found: np.ndarray, large: bool) -> None:
        before = found - 1
        before = before[before >= 0]
        before = before[~s[before]] if large else before[s[before]]
        if not len(before):
            return
        c = text[before]
        by = np.argsort(c, kind="stable")
        c = c[by]
        count = np.bincount(c, minlength=sigma)
        nth = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        if large:
            sa[at[c] + nth] = before[by]
            at[:] += count
        else:
            sa[at[c] - 1 - nth] = before[by]
            at[:] -= count

    for c in np.flatnonzero(size).tolist():
        i = head[c]
        while i < at[c]:
            i, found = at[c], sa[i : at[c]].copy()
            place(found, True)
        if seeds[c]:
            place(sorted_lms[seed_end[c] - seeds[c] : seed_end[c]], True)
    at[:] = tail
    for c in np.flatnonzero(size).tolist()[::-1]:
        i = tail[c]
        if c == text[-1]:
            at[c] -= 1
            sa[at[c]] = n - 1  # the last suffix is before all others
        while i > at[c]:
            i, found = at[c], sa[at[c] : i][::-1].copy()
            place(found, False)
        if n_large[c]:
            place(sa[head[c] : head[c] + n_large[c]][::-1].copy(), False)
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order. The last character must be smaller than all others."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    s = types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):  # one character before the last
        return np.arange(n)[::-1].copy()
    sorted_lms = lms_order(text, s, lms)
    return by_buckets(text, s, sorted_lms) if int(text.max()) < SMALL else by_sorting(text, s, lms, sorted_lms)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By place in the text: how much its suffix has in common with the one before it in order, up to `most`."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    data = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(n + 1, "<u8", data, strides=(1,))
    plcp = np.zeros(n, np.int64)
    here = np.flatnonzero(phi >= 0)
    for k in range(0, most, 8):
        there = phi[here]
        fits = np.maximum(here, there) + k < n
        here, there = here[fits], there[fits]
        x = eight[here + k] ^ eight[there + k]
        same = x == 0
        low = x[~same]
        plcp[here[~same]] = k + (np.bitwise_count((low & -low) - np.uint64(1)) >> 3)
        here = here[same]
        plcp[here] = k + 8
    return np.minimum(plcp, most)
