"""Suffix arrays by linear grouping construction.

Phase one sorts suffixes into groups of equal Lyndon prefix. Groups start as
first symbols and are taken in descending order; each suffix of the taken group
finds its previous smaller suffix, the nearest one to its left in a lower
group, whose Lyndon prefix then goes on with the group's. Those found move, by
how often they were found, to new groups just above their own. Every suffix is
handled once and finds one predecessor through a path-halving chain.

Phase two emits the order within the groups from left to right: once a suffix
is placed, the suffixes whose Lyndon prefix ends where it starts follow in
their groups' next free places; they are its predecessor and the chain of
previous smaller pointers from there, up to the first that is placed already.
No group is ever renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``symbols`` (integers) in ascending order."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(len(first)), sizes)
    sa, isa, gid = order.tolist(), place.tolist(), group.tolist()
    start, end = first.tolist(), (first + sizes).tolist()
    left = list(range(-1, n - 1))  # nearest position to the left that is not taken yet, as far as known
    taken = bytearray(n + 1)  # the last cell stands for position -1
    prev = [-1] * n

    top = n
    while top:
        g = gid[sa[top - 1]]
        low = start[g]
        members = sa[low:top]
        for i in members:
            taken[i] = 1
        found: dict[int, int] = {}
        for i in members:
            p = left[i]
            while taken[p] and p >= 0:
                up = left[p]
                if up >= 0 and taken[up]:
                    left[p] = up = left[up]
                p = up
            left[i] = prev[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        top = low
        movers = list(found)
        times = 1
        while movers:
            # those found so many times leave their groups for new ones above
            moved: dict[int, int] = {}
            for p in movers:
                a = gid[p]
                e = end[a] - 1
                if e > start[a] or a in moved:
                    k = moved.get(a, 0)
                    at, to = isa[p], e - k
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    isa[p], isa[other] = to, at
                    moved[a] = k + 1
            for a, k in moved.items():
                if k < end[a] - start[a]:
                    new = len(start)
                    start.append(end[a] - k)
                    end.append(end[a])
                    for x in sa[end[a] - k : end[a]]:
                        gid[x] = new
                    end[a] -= k
            times += 1
            movers = [p for p in movers if found[p] >= times]

    free = start
    out = [0] * n
    placed = bytearray(n + 1)
    j = n - 1
    while j >= 0 and not placed[j]:
        g = gid[j]
        out[free[g]] = j
        free[g] += 1
        placed[j] = 1
        j = prev[j]
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = gid[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out, np.int64)
