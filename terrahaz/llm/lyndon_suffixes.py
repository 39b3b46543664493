"""Suffix sorting by Lyndon groups, for one short sequence of symbols inside a task.

Phase one sorts suffixes into groups that share their longest Lyndon prefix.
Groups are taken in descending order; every member looks up the closest
position before it that is not yet taken, its previous smaller suffix, and those
positions move into new groups right above their own, by how many members they
were found from.  Phase two emits the order inside the groups from left to
right along the same pointers.  There is no recursion and no renaming.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order (a suffix precedes what it is a prefix of)."""
    n = len(symbols)
    values, first = np.unique(symbols, return_inverse=True)
    group = first.tolist()
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]  # without those that moved on
    below = list(range(-1, len(values) - 1))
    above = list(range(1, len(values))) + [-1]
    previous, taken, descending = [-1] * n, [False] * n, []

    def move(old: int, own: list[int]) -> None:
        if size[old] == len(own):  # nobody stays, so the group is its own successor
            return
        new, up = len(members), above[old]
        members.append(own)
        size.append(len(own))
        size[old] -= len(own)
        below.append(old)
        above.append(up)
        above[old] = new
        if up >= 0:
            below[up] = new
        for p in own:
            group[p] = new

    g = len(values) - 1
    while g >= 0:
        own = members[g]
        if size[g] < len(own):
            own = [i for i in own if group[i] == g]
        if len(own) == 1:
            i = own[0]
            p = i - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[i] = p
            taken[i] = True
            descending.append(g)
            members[g] = own
            if p >= 0:
                move(group[p], [p])
        elif own:
            own.sort()
            found: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and taken[p]:
                    p = previous[p]
                previous[i] = p
                taken[i] = True
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            descending.append(g)
            members[g] = own
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in found.items():
                moved.setdefault((times, group[p]), []).append(p)
            for times, old in sorted(moved, reverse=True):
                move(old, moved[times, old])
        g = below[g]
    room, at = {}, 0
    for g in reversed(descending):
        room[g] = at
        at += len(members[g])
    order, placed = [0] * n, [False] * n

    def place(s: int) -> None:
        while s >= 0 and not placed[s]:
            placed[s] = True
            order[room[group[s]]] = s
            room[group[s]] += 1
            s = previous[s]

    place(n - 1)
    for i in range(n):
        place(order[i] - 1)
    return np.array(order, np.int64)
