"""Suffix arrays of integer sequences, in numpy: prefix doubling over the groups that are still unsorted, and lengths of
common prefixes from the irreducible ones. The last symbol must be unique, so that no comparison passes the end."""

from __future__ import annotations

import numpy as np

#: Symbols compared one at a time for all pairs before the pairs that still agree are compared in slices.
_STEPS = 24


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, isa): suffixes in order, and each suffix's place in it."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    single = np.ones(n, bool)
    single[:-1] = new[1:]
    places = np.flatnonzero(~(new & single))
    h = 1
    while len(places):
        found = sa[places]
        key = rank[found] * n + rank[found + h]
        order = np.argsort(key, kind="stable")
        found, key = found[order], key[order]
        sa[places] = found
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        rank[found] = np.maximum.accumulate(np.where(new, places, 0))
        single = np.ones(len(places), bool)
        single[:-1] = new[1:]
        places = places[~(new & single)]
        h *= 2
    return sa, rank


def agreements(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols from ``a`` and ``b`` on agree, forwards (``step`` 1) or backwards (-1, beginning with the
    symbols at ``a`` and ``b``). Forwards the pairs must differ before the end; backwards the beginning stops them."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for _ in range(_STEPS):
        x, y = a[live] + step * out[live], b[live] + step * out[live]
        inside = np.minimum(x, y) >= 0
        live = live[inside][symbols[x[inside]] == symbols[y[inside]]]
        if not len(live):
            return out
        out[live] += 1
    for i in live.tolist():
        x, y, size = int(a[i] + step * out[i]), int(b[i] + step * out[i]), 4 * _STEPS
        while min(x, y) >= 0:
            if step > 0:
                size = min(size, len(symbols) - max(x, y))
                same = symbols[x : x + size] == symbols[y : y + size]
            else:
                size = min(size, min(x, y) + 1)
                same = (symbols[x + 1 - size : x + 1] == symbols[y + 1 - size : y + 1])[::-1]
            if size <= 0:
                break
            if not same.all():
                out[i] += int(same.argmin())
                break
            out[i] += size
            x, y, size = x + step * size, y + step * size, size * 2
    return out


def lcp_array(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it (0 for the first). A suffix whose predecessor is
    preceded by the same symbol has the length of the suffix one to its left, less one; only the others are compared."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    start = np.arange(n)
    plain = np.zeros(n, bool)
    inner = start[1:][before[1:] > 0]
    plain[inner] = symbols[inner - 1] == symbols[before[inner] - 1]
    lead = np.flatnonzero(~plain & (before >= 0))
    lengths = np.zeros(n, np.int64)
    lengths[lead] = agreements(symbols, lead, before[lead])
    source = np.maximum.accumulate(np.where(plain, 0, start))
    return (lengths[source] - (start - source))[sa]


def nearest_below(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strict, loose): largest k < j with values[k] < values[j], and with values[k] <= values[j], of every
    values[j] >= 1; 0 if there is none. Pointers jump over what doesn't qualify until none moves; equal values with the
    same answer follow each other."""
    n = len(values)
    at = np.arange(-1, n - 1)
    at[0] = 0
    live = 1 + np.flatnonzero(values[1:] >= 1)
    while len(live):
        live = live[(values[at[live]] >= values[live]) & (at[live] > 0)]
        at[live] = at[at[live]]
    order = np.lexsort((values, at))
    loose = at.copy()
    equal = (at[order][1:] == at[order][:-1]) & (values[order][1:] == values[order][:-1])
    loose[order[1:][equal]] = order[:-1][equal]
    return at, loose
