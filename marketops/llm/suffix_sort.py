"""Suffix sorting in linear time by grouping, without recursion or renaming.

First pass: suffixes start in one group per first symbol. Groups are processed from the largest down. For
each suffix of a group, the previous-smaller pointer finds the suffix to its left whose prefix it
completes; that one moves behind its group, as its prefix has become a longer Lyndon word. In the
end a group holds the suffixes with one longest Lyndon prefix. Second pass: from the smallest suffix up,
each finished suffix puts those whose Lyndon prefix ends where it starts at the front of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> list[int]:
    """Starts of all suffixes of ``symbols`` in ascending order (a suffix precedes its extensions)."""
    text = np.asarray(symbols, np.int64)
    n = len(text) + 1
    if n == 1:
        return []
    text = np.r_[text - text.min() + 1, 0]  # the end is smaller than all symbols
    order = np.argsort(text, kind="stable")
    head = np.r_[True, text[order][1:] != text[order][:-1]]
    heads = np.flatnonzero(head)
    first = heads[np.cumsum(head) - 1]
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], group[order] = np.arange(n), first
    stop = np.zeros(n + 1, np.int64)
    stop[heads] = np.r_[heads[1:], n]
    order, place, group, stop = order.tolist(), place.tolist(), group.tolist(), stop.tolist()
    smaller = [-1] * n

    high = n
    while high > 0:
        low = group[order[high - 1]]
        if high - low == 1:
            i = order[low]
            j = i - 1
            while j >= 0 and group[j] > low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                e = stop[g] - 1
                if e != g:
                    other, at = order[e], place[j]
                    order[e], order[at] = j, other
                    place[j], place[other] = e, at
                    stop[g], stop[e], group[j] = e, e + 1, e
        else:
            repeats: dict[int, int] = {}
            root: dict[int, int] = {}
            for i in sorted(order[low:high]):
                j = i - 1
                while j >= 0 and group[j] > low:
                    j = smaller[j]
                if j >= 0 and group[j] == low:  # the same Lyndon word once more
                    r = root[j]
                    root[i] = r
                    repeats[r] += 1
                    smaller[i] = smaller[r]
                else:
                    root[i] = i
                    repeats[i] = 1
                    smaller[i] = j
            by_count: dict[int, list[int]] = {}
            for r, k in repeats.items():
                if smaller[r] >= 0:
                    by_count.setdefault(k, []).append(smaller[r])
            for k in sorted(by_count, reverse=True):
                ends: dict[int, int] = {}
                moved = by_count[k]
                for j in moved:
                    g = group[j]
                    e = stop[g]
                    if g not in ends:
                        ends[g] = e
                    e -= 1
                    stop[g] = e
                    other, at = order[e], place[j]
                    order[e], order[at] = j, other
                    place[j], place[other] = e, at
                starts = {g: stop[g] for g in ends}
                for j in moved:
                    group[j] = starts[group[j]]
                for g, e in ends.items():
                    stop[starts[g]] = e
        high = low

    out = [-1] * n
    front = list(range(n + 1))  # the next free place of each group
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = front[g]
            out[at] = j
            front[g] = at + 1
            done[j] = True
            j = smaller[j]
    return out[1:]
