"""Suffix arrays by linear grouping, and their longest common prefixes.

Suffixes are first put in groups of equal Lyndon prefix. Groups are processed in descending order: each of their
suffixes finds its previous smaller suffix (the nearest one to the left in a lower group, found by following the
pointers of those already processed), and the suffixes found move to new groups, right above their old ones; those
that are found more often go higher. A second pass emits the order inside each group: suffixes are placed in rising
order of what follows their Lyndon prefix, read off along the same pointers. Nothing is renamed or recursed into.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(start of the group of each suffix, previous smaller pointer of each suffix) of a text of whole numbers.

    The end of the text counts as smaller than anything. A group is named by the first place that it has in the
    suffix array, so names compare as groups do.
    """
    n = len(text)
    members: dict[int, list[int]] = {}
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, size, start_of_end, at = [0] * n, {}, [0] * n, 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = at
        members[at], size[at] = own, len(own)
        start_of_end[at + len(own) - 1] = at
        at += len(own)
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        g = start_of_end[end]
        found: list[int] = []  # previous smaller suffixes, rising; each with how often it was found
        times: list[int] = []
        for s in members.pop(g):
            if group[s] != g:
                continue  # has moved on
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                if found and found[-1] == p:
                    times[-1] += 1
                else:
                    found.append(p)
                    times.append(1)
        if found:
            buckets: dict[int, list[int]] = {}
            for p, k in zip(found, times, strict=True):
                buckets.setdefault(k, []).append(p)
            for k in sorted(buckets, reverse=True):
                moving: dict[int, list[int]] = {}
                for p in buckets[k]:
                    moving.setdefault(group[p], []).append(p)
                for old, some in moving.items():
                    left = size[old] - len(some)
                    if not left:
                        continue  # the whole group moves: it stays where it is
                    new = old + left
                    members[new], size[new], size[old] = some, len(some), left
                    start_of_end[new + len(some) - 1] = new
                    start_of_end[new - 1] = old
                    for p in some:
                        group[p] = new
        end = g - 1
    return group, previous


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of a text of whole numbers, in rising order of suffixes."""
    n = len(text)
    group, previous = lyndon_groups(text)
    order, placed, fill = [-1] * n, [False] * n, {}

    def follow(j: int) -> None:
        """Place the suffixes whose Lyndon prefix ends right before ``j``."""
        s = j - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            at = fill.get(g, g)
            order[at], fill[g], placed[s] = s, at + 1, True
            s = previous[s]

    follow(n)
    for i in range(n):
        follow(order[i])
    return order


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the longest common prefix of each suffix in ``order`` and the one before it; 0 for the first."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for i, s in enumerate(order):
        rank[s] = i
    for s in range(n):
        r = rank[s]
        if not r:
            h = 0
            continue
        t = order[r - 1]
        top = n - max(s, t)
        while h < top and text[s + h] == text[t + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
