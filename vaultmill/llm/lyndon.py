"""Suffix sorting by linear grouping.

Every suffix starts with a longest Lyndon word; suffixes sort by that word first. Phase 1 finds the
groups of suffixes with equal words and their order: groups start as the first letters and are
taken in descending order. When a group is taken its words are final, and each member's previous
smaller pointer - the nearest position to the left whose group is lower - is set. A suffix that is
pointed at by l members is followed by that group's word l times, so its own word grows: it moves
to a new group right above the rest of its old one, higher for more repeats. Phase 2 walks the
suffixes in ascending order; each one places, at the front of their groups, the suffixes whose word
ends where it starts, found along the previous-smaller pointers. No recursion, no renaming; every
position is moved a bounded number of times over all, so both phases are linear.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in order. The last symbol must be the only smallest one."""
    n = len(text)
    members: list[list[int]] = []
    group = [0] * n
    ids: dict[int, int] = {}
    for c in sorted(set(text)):
        ids[c] = len(members)
        members.append([])
    for i, c in enumerate(text):
        g = ids[c]
        group[i] = g
        members[g].append(i)
    below = [g - 1 for g in range(len(members))]  # the next lower group, and the next higher one
    above = [g + 1 for g in range(len(members))]
    above[-1] = -1
    unset = -2
    prev = [unset] * n
    g = len(members) - 1
    while g >= 0:
        kept = [i for i in members[g] if group[i] == g]
        members[g] = kept
        moved: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for i in kept:
            j = i - 1
            while j >= 0 and prev[j] != unset:
                j = prev[j]
            prev[i] = j
            if j == last:
                times += 1
                continue
            if last >= 0:
                key = (group[last], times)
                if key in moved:
                    moved[key].append(last)
                else:
                    moved[key] = [last]
            last, times = j, 1
        if last >= 0:
            key = (group[last], times)
            if key in moved:
                moved[key].append(last)
            else:
                moved[key] = [last]
        for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            old, who = key[0], moved[key]
            new = len(members)
            members.append(who)
            for j in who:
                group[j] = new
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    front = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = above[g]
    order = [0] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[front[g]] = i
            front[g] += 1
            placed[i] = 1
            i = prev[i]
    return order
