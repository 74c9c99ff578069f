"""Linear suffix sorting by Lyndon-prefix groups, for one array of numbers inside a task."""

from __future__ import annotations

from collections.abc import Sequence


class _Group:
    """Suffixes with the same known part of their Lyndon prefix, in a list ordered by that part."""

    __slots__ = ("members", "after", "before", "live", "start")

    def __init__(self, members: list[int]):
        self.members = members
        self.after: _Group | None = None
        self.before: _Group | None = None
        self.live = len(members)
        self.start = 0


def _move(subset: list[int], group_of: list[_Group]) -> None:
    """Put some members of a group into a new one right after it."""
    home = group_of[subset[0]]
    home.live -= len(subset)
    fresh = _Group(subset)
    fresh.before, fresh.after = home, home.after
    if home.after is not None:
        home.after.before = fresh
    home.after = fresh
    for p in subset:
        group_of[p] = fresh


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; a suffix comes after its own prefixes.

    First the groups are visited from the greatest down. The previous smaller pointer of a
    suffix leads to the nearest earlier one in a lower group, whose Lyndon prefix goes on
    with this group's; suffixes that are pointed to equally often leave their group for a new
    one right after it. At the end each group has exactly the suffixes with one Lyndon prefix.
    Then suffixes are read off in order: each sets the one before it, and those along its
    pointers, to the next free place of their groups. Nothing is renamed or sorted again.
    """
    n = len(symbols)
    if n == 0:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        by_symbol.setdefault(symbol, []).append(i)
    groups = [_Group(by_symbol[s]) for s in sorted(by_symbol)]
    group_of: list[_Group] = [groups[0]] * n
    for low, high in zip(groups, groups[1:]):
        low.after, high.before = high, low
    for group in groups:
        for i in group.members:
            group_of[i] = group
    smaller = [-1] * n
    done = bytearray(n)

    group: _Group | None = groups[-1]
    while group is not None:
        members = group.members
        if group.live != len(members):
            # Members that moved on are still in the list.
            members = [i for i in members if group_of[i] is group]
        if len(members) > 1:
            # In ascending order, pointers of earlier ones are known.
            members.sort()
        group.members = members
        for i in members:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            # A suffix that is alone in its group already stays there.
            if group_of[p].live > 1:
                _move([p], group_of)
        elif pointed:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in pointed.items():
                moved.setdefault((times, id(group_of[p])), []).append(p)
            # More repeats make a greater prefix, so they are put in first and end up further on.
            for _, subset in sorted(moved.items(), key=lambda item: -item[0][0]) if len(moved) > 1 else moved.items():
                if group_of[subset[0]].live > len(subset):
                    _move(subset, group_of)
        first, group = group, group.before

    place = 0
    walk: _Group | None = first
    while walk is not None:
        walk.start = place
        place += len(walk.members)
        walk = walk.after
    order = [-1] * n
    placed = [False] * n
    at = -1
    suffix = n
    while True:
        s = suffix - 1
        while s >= 0 and not placed[s]:
            home = group_of[s]
            order[home.start] = s
            home.start += 1
            placed[s] = True
            s = smaller[s]
        at += 1
        if at == n:
            return order
        suffix = order[at]


def common_prefixes(symbols: Sequence[int], order: Sequence[int], stop: int) -> list[int]:
    """For each place in ``order``, symbols shared with the suffix before it, up to the symbol ``stop``."""
    n = len(symbols)
    place = [0] * n
    for at, i in enumerate(order):
        place[i] = at
    shared = [0] * n
    ended = [*symbols, stop]
    k = 0
    for i in range(n):
        at = place[i]
        if at == 0:
            k = 0
            continue
        j = order[at - 1]
        while ended[i + k] == ended[j + k] != stop:
            k += 1
        shared[at] = k
        if k:
            k -= 1
    return shared
