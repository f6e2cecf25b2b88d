"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group's order is emitted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The start of every suffix in ascending order; symbols are integers.

    First part: groups lie side by side in ``order``, a group is named by its first
    place. They are visited from the highest down. Each suffix of the visited group
    points at the nearest one before it that is in a lower group; the suffixes pointed
    at continue with the group's prefix, as often as they are pointed at, so they
    leave for new groups right above their own, the most often pointed at highest.
    Second part: from each suffix in its final place, the one before it and the chain
    of its pointers take the first free places of their groups.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    group, order, size, where = _first_groups(text)
    before = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:  # most groups: one suffix, which moves one at most
            s, end = order[start], start
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0 and size[g := group[p]] > 1:
                size[g] -= 1
                last, here = g + size[g], where[p]
                other = order[last]
                order[last], order[here] = p, other
                where[p], where[other] = last, here
                group[p], size[last] = last, 1
            continue
        members = order[start:end]
        end = start
        members.sort()
        pointed = []
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed.append(p)
        if len(pointed) == 1:
            _leave(pointed, group, order, size, where)
        elif len(set(pointed)) == len(pointed):
            if pointed:
                _leave(pointed, group, order, size, where)
        else:
            classes: dict[int, list[int]] = {}
            for p, k in Counter(pointed).items():
                classes.setdefault(k, []).append(p)
            for k in sorted(classes, reverse=True):
                _leave(classes[k], group, order, size, where)
    return _emitted(n, group, before)


def _first_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups by first symbol: name of each suffix's group, suffixes group by group, sizes by name, places."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size, where = [0] * n, [0] * n, [0] * n
    name, symbol = 0, text[order[0]]
    for place, s in enumerate(order):
        if text[s] != symbol:
            name, symbol = place, text[s]
        group[s], where[s] = name, place
        size[name] += 1
    return group, order, size, where


def _leave(movers: list[int], group: list[int], order: list[int], size: list[int], where: list[int]) -> None:
    """Move suffixes to the ends of their groups; those that leave one group together are a new group."""
    old = [group[p] for p in movers]
    for p, g in zip(movers, old):
        size[g] -= 1
        last, here = g + size[g], where[p]
        other = order[last]
        order[last], order[here] = p, other
        where[p], where[other] = last, here
    for p, g in zip(movers, old):
        name = g + size[g]
        group[p] = name
        size[name] += name != g
    for g in set(old):
        if size[g] == 0:  # all have left: the group goes on under its name
            size[g] = sum(1 for x in old if x == g)


def _emitted(n: int, group: list[int], before: list[int]) -> list[int]:
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    s = n - 1  # after the end stands what is lower than all
    for turn in range(-1, n):
        if turn >= 0:
            s = out[turn] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = before[s]
    return out
