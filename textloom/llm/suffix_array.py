"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS)
substrings by inducing, names them, sorts the named string recursively and
induces the whole array from the LMS order.  For the small alphabet of the
bytes, inducing scans the buckets in order, a whole bucket by a few numpy calls
(a counting sort of the characters before it keeps the scan's order).  For the
large alphabets of the recursion it follows chains instead: a larger (L)
suffix descends, run of equal characters by run, to the LMS suffix that it is
induced from, and a smaller (S) suffix ascends to an L suffix; all chains are
compared side by side, a run a step, and only those still equal go on.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced a bucket at a time,
SMALL = 1024
#: unless one character runs on for longer than this (a bucket's scan takes a step a position of a run).
RUN = 1000


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type); the sentinel is."""
    d = np.diff(t)
    at = np.where(d != 0, np.arange(len(d)), len(d))
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the character changes
    return np.append(np.append(d, 1)[at] > 0, True)


def _spread(p: np.ndarray, ch: np.ndarray, pending: list[list]) -> None:
    """Append positions to their characters' buckets, in the order given."""
    if len(p):
        order = np.argsort(ch.astype(np.uint16), kind="stable")  # of 16 bits: a counting sort
        ch = ch[order]
        p = p[order]
        cuts = [0, *(np.flatnonzero(ch[1:] != ch[:-1]) + 1).tolist(), len(p)]
        for a, z, c in zip(cuts, cuts[1:], ch[cuts[:-1]].tolist(), strict=False):
            pending[c].append(p[a:z])


def _induce(t: np.ndarray, k: int, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order induced from LMS positions ``lms``, sorted within their buckets."""
    none = np.zeros(0, np.int32)
    starts: list[list] = [[] for _ in range(k)]
    _spread(lms, t[lms], starts)
    large: list[list] = [[] for _ in range(k)]
    for c in range(k):
        cur = np.concatenate(large[c]) if large[c] else none
        own = [cur]
        while True:
            p = cur[cur > 0] - 1
            p = p[~s_type[p]]
            ch = t[p]
            same = ch == c
            _spread(p[~same], ch[~same], large)
            cur = p[same]
            if not len(cur):
                break
            own.append(cur)
        large[c] = np.concatenate(own)
        for part in starts[c]:
            p = part[part > 0] - 1
            _spread(p, t[p], large)
    small: list[list] = [[] for _ in range(k)]
    small[t[-1]].append(np.array([len(t) - 1], np.int32))
    for c in range(k - 1, -1, -1):
        cur = np.concatenate(small[c]) if small[c] else none
        own = [cur]
        while True:
            p = cur[cur > 0] - 1
            p = p[s_type[p]]
            ch = t[p]
            same = ch == c
            _spread(p[~same], ch[~same], small)
            cur = p[same]
            if not len(cur):
                break
            own.append(cur)
        small[c] = np.concatenate(own)[::-1]
        p = large[c][::-1]
        p = p[p > 0] - 1
        p = p[s_type[p]]
        _spread(p, t[p], small)
    return np.concatenate([x for c in range(k) for x in (large[c], small[c])])


def _chains(e: np.ndarray, following: np.ndarray, column: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``e`` in the order of their chains, and the number of each one's class of equals.

    A chain is the columns of a position, of the one ``following`` it, and so
    on up to and with the first of ``ends``.
    """
    order = np.argsort(column[e])
    e = e[order]
    col = column[e]
    new = np.concatenate(([True], col[1:] != col[:-1], [True]))
    at, group = e.copy(), np.cumsum(new[:-1])
    live = np.flatnonzero(~(new[:-1] & new[1:]))
    live = live[~ends[at[live]]]
    shift = int(column.max(initial=0)).bit_length()
    wide = shift + len(e).bit_length() > 63
    while len(live):
        to = following[at[live]]
        col, g = column[to], group[live]
        if wide:
            order = np.lexsort((col, g))
            cut = (g[order][1:] != g[order][:-1]) | (col[order][1:] != col[order][:-1])
        else:
            key = g << shift | col
            order = np.argsort(key)
            key = key[order]
            cut = key[1:] != key[:-1]
        cut = np.concatenate(([True], cut, [True]))
        to = to[order]
        e[live], at[live] = e[live][order], to
        new[live] |= cut[:-1]
        group[live] = live[np.maximum.accumulate(np.where(cut[:-1], np.arange(len(live)), 0))]
        live = live[~(cut[:-1] & cut[1:]) & ~ends[to]]
    return e, np.cumsum(new[:-1]) - 1


class _Chained:
    """Inducing for any alphabet, by chains of runs."""

    def __init__(self, t: np.ndarray, k: int, s_type: np.ndarray):
        n = len(t)
        self.t, self.k, self.s_type, self.bits = t, k, s_type, n.bit_length()
        end = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, n)
        self.following = np.repeat(end, np.diff(end, prepend=0)).astype(np.int32)
        self.run = self.following - np.arange(n)
        self.following[-1] = n - 1

    def order(self, key: np.ndarray):
        """L positions in order, S positions but the last in order, and the latter's classes.

        ``key``: of LMS positions, the rank.  Where two agree up to a character,
        the L suffix comes first, of two L the one with the shorter run, of two
        S the one with the longer.
        """
        flag, base = np.int64(1 << self.bits), self.t.astype(np.int64) << (self.bits + 1)
        large, kind = self._sorted(~self.s_type, base | np.where(self.s_type, flag | key, self.run))
        rank = np.zeros(len(self.t), np.int64)
        rank[large] = kind
        small, kind = self._sorted(self.s_type, base | np.where(self.s_type, flag | (flag - 1 - self.run), rank))
        return large, small, kind

    def _sorted(self, mine: np.ndarray, column: np.ndarray):
        return _chains(np.flatnonzero(mine[:-1]).astype(np.int32), self.following, column, ~mine)

    def named(self, is_lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The LMS positions by their substrings, and the substrings' numbers."""
        _, small, kind = self.order(np.zeros(len(self.t), np.int64))
        on = is_lms[small]
        kind = kind[on]
        return np.append(np.int32(len(self.t) - 1), small[on]), np.cumsum(np.concatenate(([False], kind[:1] >= 0, kind[1:] != kind[:-1])))

    def induced(self, lms: np.ndarray) -> np.ndarray:
        """The array from the sorted LMS positions."""
        n = len(self.t)
        key = np.zeros(n, np.int64)
        key[lms] = np.arange(len(lms))
        large, small, _ = self.order(key)
        small = np.append(np.int32(n - 1), small)
        count = lambda p: np.bincount(self.t[p], minlength=self.k)
        sa, n_small = np.empty(n, np.int32), count(small)
        sa[np.arange(len(large)) + (np.cumsum(n_small) - n_small)[self.t[large]]] = large
        sa[np.arange(len(small)) + np.cumsum(count(large))[self.t[small]]] = small
        return sa


class _Bucketed:
    """Inducing for small alphabets, a bucket at a time."""

    def __init__(self, t: np.ndarray, k: int, s_type: np.ndarray):
        self.t, self.k, self.s_type = t, k, s_type

    def named(self, is_lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t, n = self.t, len(self.t)
        lms = np.flatnonzero(is_lms).astype(np.int32)
        order = _induce(t, self.k, self.s_type, lms)
        order = order[is_lms[order]]
        length = np.zeros(n, np.int32)
        length[lms] = np.append(lms[1:], n - 1) - lms + 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live = np.flatnonzero(same)
        step = 0
        while len(live):
            live = live[length[a[live]] > step]
            differ = t[a[live] + step] != t[b[live] + step]
            same[live[differ]] = False
            live = live[~differ]
            step += 1
        return order, np.concatenate(([0], np.cumsum(~same)))

    def induced(self, lms: np.ndarray) -> np.ndarray:
        return _induce(self.t, self.k, self.s_type, lms)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """``t``: values 0 .. k - 1 whose last is a 0 that occurs nowhere else."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    s_type = _types(t)
    run = int(np.diff(np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))).max())
    by = (_Bucketed if k <= SMALL and run <= RUN else _Chained)(t, k, s_type)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    order, names = by.named(is_lms)
    if names[-1] + 1 < len(order):
        name_at = np.zeros(n, np.int32)
        name_at[order] = names
        lms = np.flatnonzero(is_lms).astype(np.int32)
        order = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
    return by.induced(order)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in ``sa``.

    Only irreducible places are compared, all side by side; elsewhere the
    value is one less than its left neighbour's.
    """
    n = len(t)
    prev = np.full(n, -1, np.int64)
    prev[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = np.where((i > 0) & (prev > 0), t[np.maximum(prev - 1, 0)], -1)
    own = np.concatenate(([-2], t[:-1]))
    irreducible = (before != own) | (prev < 0)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & (prev >= 0))
    # four characters a step, then one by one where the four differ
    for width in (4, 1):
        if width == 4:
            own = np.append(t, np.arange(-8, 0)).astype(np.int64) & 0xFFFF
            four = own[:-3] | own[1:-2] << 16 | own[2:-1] << 32 | own[3:] << 48
            code, rest, step = four, live, 0
            if t.max(initial=0) >= 0xFFF0:
                continue
            done = np.zeros(n, np.int64)
        else:
            code, rest, step = np.append(t, np.arange(-8, 0)), live, 0
            done = out.copy()
        while len(rest):
            p, q = rest + done[rest] + step, prev[rest] + done[rest] + step
            on = (p < n) & (q < n)
            on[on] = code[p[on]] == code[q[on]]
            out[rest[~on]] = done[rest[~on]] + step
            rest = rest[on]
            step += width
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    return np.maximum(out[last] - (i - last), 0)
