"""Suffix arrays by linear grouping (after Baier 2016).

Phase 1 sorts suffixes into groups that share their longest Lyndon prefix. Groups start as one per symbol and are
processed in descending order. For each suffix of the group in hand its previous-smaller pointer leads to the suffix
that this one extends; what it extends moves into a new group just above its old one, the farther up the more often it
is extended. Phase 2 walks the order from its smallest suffix: each placed suffix lets the one before it, and then
whatever previous-smaller pointers lead to, take the next place of its group. No names are recomputed, nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of text's suffixes in ascending order (a prefix of another suffix comes first)."""
    n = len(text)
    if not n:
        return []
    symbols = sorted(set(text))
    rank = {s: i for i, s in enumerate(symbols)}
    counts = [0] * len(symbols)
    codes = [rank[s] for s in text]
    for c in codes:
        counts[c] += 1
    # positions 1..n; position n + 1 is the end, smaller than all; groups are intervals of `order`, named by their start
    start, starts = 1, []
    for c in counts:
        starts.append(start)
        start += c
    order = [0] * (n + 1)
    place = [0] * (n + 2)
    group = [0] * (n + 2)
    fill = starts[:]
    for i, c in enumerate(codes, 1):
        order[fill[c]] = i
        place[i] = fill[c]
        group[i] = starts[c]
        fill[c] += 1
    size = [0] * (n + 2)
    for s, c in zip(starts, counts):
        size[s] = c
    before = [0] * (n + 2)
    final = []  # the groups as they were when processed, from the greatest
    end = n
    while end >= 1:
        g = group[order[end]]
        members = order[g : end + 1]
        final.append(g)
        # the nearest place to the left whose group is smaller; greater groups are done, so their pointers lead on
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j and group[j] > g:
                j = before[j]
            before[i] = j
            if j:
                moved = ((j, 1),)
            else:
                moved = ()
        else:
            members.sort()
            times: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j:
                    times[j] = times.get(j, 0) + 1
            moved = times.items()
        end = g - 1
        if not moved:
            continue
        if len(moved) == 1:
            for j, _ in moved:
                _split(order, place, group, size, [j])
            continue
        by: dict[int, list[int]] = {}
        for j, t in moved:
            by.setdefault(t, []).append(j)
        for t in sorted(by, reverse=True):
            _split(order, place, group, size, by[t])
    # phase 2
    out = [0] * (n + 1)
    nxt = {g: g for g in final}
    done = bytearray(n + 2)
    j = n
    at = 0
    while True:
        while j and not done[j]:
            done[j] = 1
            g = group[j]
            out[nxt[g]] = j
            nxt[g] += 1
            j = before[j]
        at += 1
        if at > n:
            break
        j = out[at] - 1
    return [i - 1 for i in out[1:]]


def _split(order: list[int], place: list[int], group: list[int], size: list[int], chosen: list[int]) -> None:
    """Move the chosen suffixes, group by group, into a new group just above their old one."""
    if len(chosen) == 1:
        j = chosen[0]
        g = group[j]
        if size[g] == 1:
            return
        last = g + size[g] - 1
        p, other = place[j], order[last]
        order[p], order[last] = other, j
        place[other], place[j] = p, last
        size[g] -= 1
        size[last] = 1
        group[j] = last
        return
    by: dict[int, list[int]] = {}
    for j in chosen:
        by.setdefault(group[j], []).append(j)
    for g, own in by.items():
        m = len(own)
        if m == size[g]:
            continue
        last = g + size[g] - 1
        for j in own:
            p, other = place[j], order[last]
            order[p], order[last] = other, j
            place[other], place[j] = p, last
            last -= 1
        last += 1
        size[g] -= m
        size[last] = m
        for j in own:
            group[j] = last
