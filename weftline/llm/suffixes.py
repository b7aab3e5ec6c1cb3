"""Suffix order of a text in time linear in its length, by Lyndon-prefix groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


_OPEN = -2


def _by_symbol(symbols: Sequence[int]) -> list[int]:
    """Places in order of their symbols, then of place: a count of each symbol, made into first slots."""
    numbers = np.asarray(symbols, dtype=np.int64)
    count = np.bincount(numbers)
    free = (np.cumsum(count) - count).tolist()
    slots = [0] * len(numbers)
    for i, x in enumerate(numbers.tolist()):
        slots[free[x]] = i
        free[x] += 1
    return slots


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of `text` (integers >= 0) in ascending order.

    The text is closed with an end mark below every symbol. Phase one sorts the
    suffixes into groups by their longest Lyndon prefix: groups are visited from the
    highest down, each suffix finds the nearest suffix before it that stands in a
    lower group (its previous-smaller pointer), and the suffixes so pointed at grow
    their prefix by as many copies of the visited group's prefix as point at them, so
    they leave their group for a higher one. Phase two walks the order from the
    lowest suffix up: the suffix before the one just read, and those its pointers
    lead to, are each the least left of their group.
    """
    n = len(text) + 1
    if n == 1:
        return []
    symbols = [x + 1 for x in text] + [0]
    slots = _by_symbol(symbols)
    where = [0] * n  # slot of a suffix
    first = [0] * n  # first slot of a suffix's group
    start = 0
    for k, i in enumerate(slots):
        where[i] = k
        if k and symbols[slots[k - 1]] != symbols[i]:
            start = k
        first[i] = start
    size = [0] * n  # by first slot
    for i in range(n):
        size[first[i]] += 1

    before = [_OPEN] * n
    come = list(range(-1, n - 1))  # how far the search for a suffix's pointer has come
    hits = [0] * n
    high = n - 1
    while high >= 0:
        low = first[slots[high]]
        pointed = []
        for i in slots[low : high + 1]:
            open_ = [i] if before[i] == _OPEN else []
            while open_:  # a pointer may lead over others of the group, which are then found first
                j = open_[-1]
                p = come[j]
                while p >= 0 and first[p] >= low:
                    if before[p] == _OPEN:
                        break
                    p = before[p]
                come[j] = p
                if p >= 0 and first[p] >= low:
                    open_.append(p)
                    continue
                before[j] = p
                open_.pop()
                if p >= 0:
                    if not hits[p]:
                        pointed.append(p)
                    hits[p] += 1
        if pointed:
            by_hits: dict[int, list[int]] = {}
            for p in pointed:
                by_hits.setdefault(hits[p], []).append(p)
                hits[p] = 0
            for k in sorted(by_hits, reverse=True):  # more copies stand higher; k numbers take k * k / 2 suffixes at least, so this is linear too
                taken: dict[int, int] = {}
                for p in by_hits[k]:
                    g = first[p]
                    taken[g] = out = taken.get(g, 0) + 1
                    last, at = g + size[g] - out, where[p]
                    other = slots[last]
                    slots[last], slots[at] = p, other
                    where[p], where[other] = last, at
                for g, out in taken.items():
                    size[g] -= out
                    if size[g]:
                        new = g + size[g]
                        size[new] = out
                        for s in range(new, new + out):
                            first[slots[s]] = new
                    else:
                        size[g] = out
        high = low - 1

    order = [-1] * n
    order[0] = n - 1
    free = list(range(n))  # next slot of the group that starts here
    placed = [False] * n
    placed[n - 1] = True
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            g = first[i]
            order[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = before[i]
    return order[1:]
