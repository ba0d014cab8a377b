"""Suffix sorting by linear grouping.

First phase: suffixes start in groups by first symbol. Groups are processed from the
greatest down. Each suffix of the group points to the nearest suffix before it in a
smaller group; suffixes that are pointed at l times move to a new group right behind
their own, greater l further behind. In the end a group holds the suffixes with one
Lyndon prefix. Second phase: from the smallest suffix on, the suffixes whose next
smaller suffix it is, found along the same pointers, take the next place of their
groups. Nothing is renamed or sorted recursively.

``suffix_array`` does so for one text; ``suffix_arrays`` for many short texts side by
side: each step takes the greatest open group of every text.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose last symbol is smaller than all others."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    starts = np.repeat(heads, np.diff(np.concatenate([heads, [n]])))
    first = np.empty(n, np.int64)
    first[order] = starts
    at = order.tolist()  # suffixes by group
    group = first.tolist()  # where a suffix's group starts in at
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    end = dict(zip(heads.tolist(), np.concatenate([heads[1:], [n]]).tolist(), strict=True))
    before = [-1] * n
    top = n
    while top > 0:
        low = group[at[top - 1]]
        if top - low == 1:
            i = at[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                _move(j, group, at, place, end)
        else:
            counts: dict[int, int] = {}
            for i in sorted(at[low:top]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, c in counts.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                _regroup(by_count[c], group, at, place, end)
        top = low
    return _emit(group, before, n)


def _move(j: int, group: list[int], at: list[int], place: list[int], end: dict[int, int]) -> None:
    """Puts one suffix into a group of its own behind its group."""
    g = group[j]
    e = end[g] - 1
    if e == g:
        return
    k, other = place[j], at[e]
    at[k], at[e] = other, j
    place[other], place[j] = k, e
    end[g] = e
    end[e] = e + 1
    group[j] = e


def _regroup(moved: list[int], group: list[int], at: list[int], place: list[int], end: dict[int, int]) -> None:
    """Puts suffixes of each group among these into one new group behind it."""
    if len(moved) == 1:
        return _move(moved[0], group, at, place, end)
    old: dict[int, int] = {}
    for j in moved:
        g = group[j]
        e = end[g] - 1
        k, other = place[j], at[e]
        at[k], at[e] = other, j
        place[other], place[j] = k, e
        end[g] = e
        old[g] = old.get(g, 0) + 1
    for g, count in old.items():
        e = end[g]
        if e == g:  # the whole group moved: it stays what it was
            end[g] = g + count
            continue
        end[e] = e + count
        for k in range(e, e + count):
            group[at[k]] = e
    return None


def _emit(group: list[int], before: list[int], n: int) -> np.ndarray:
    """Places every suffix in its group in the order of its next smaller suffix."""
    out = [-1] * n
    free = list(range(n))
    out[0] = n - 1
    open_ = bytearray(b"\1") * n
    open_[n - 1] = 0
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and open_[j]:
            g = group[j]
            f = free[g]
            out[f] = j
            free[g] = f + 1
            open_[j] = 0
            j = before[j]
    return np.array(out, np.int64)


#: Texts side by side from which a step over all of them costs less than one text after the other.
SIDE_BY_SIDE = 25


def suffix_arrays(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix arrays of texts that follow each other, one after the other; the last symbol of each is its smallest."""
    sizes = np.diff(first)
    if not len(sizes):
        return np.zeros(0, np.int64)
    if len(text) < SIDE_BY_SIDE * int(sizes.max()):
        return np.concatenate([suffix_array(text[a:b]) + a for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    group, before = _groups(text, first)
    return _emit_all(group, before, first)


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each size, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)


def _groups(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First phase for all texts: the group and the pointer of each suffix."""
    n = len(text)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = owner * (int(text.max()) + 1) + text
    at = np.argsort(key, kind="stable")
    ranked = key[at]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([heads, [n]]))
    group, place, end = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    group[at] = np.repeat(heads, size)
    place[at] = np.arange(n)
    end[heads] = heads + size
    before = np.full(n, -1)
    marked = np.zeros(n, bool)
    begin, top = first[:-1], first[1:].copy()
    while True:
        live = top > begin
        begin, top = begin[live], top[live]
        if not len(top):
            return group, before
        low = group[at[top - 1]]
        size = top - low
        i = at[_ranges(low, size)]
        least, start = np.repeat(low, size), np.repeat(begin, size)
        j = i - 1
        j[j < start] = -1
        open_ = np.flatnonzero(j >= 0)
        open_ = open_[group[j[open_]] > least[open_]]
        while len(open_):  # along the pointers of greater groups
            to = before[j[open_]]
            j[open_] = to
            on = to >= 0
            on[on] = group[to[on]] > least[open_[on]]
            open_ = open_[on]
        before[i] = j
        open_ = np.flatnonzero(j >= 0)
        open_ = open_[group[j[open_]] == least[open_]]
        while len(open_):  # and over those of the group itself
            to = before[j[open_]]
            j[open_] = to
            before[i[open_]] = to
            on = to >= 0
            on[on] = group[to[on]] == least[open_[on]]
            open_ = open_[on]
        moved, count = np.unique(j[j >= 0], return_counts=True)
        if len(moved):
            _regroup_all(moved, count, group, at, place, end, marked)
        top = low


def _regroup_all(moved: np.ndarray, count: np.ndarray, group: np.ndarray, at: np.ndarray, place: np.ndarray, end: np.ndarray, marked: np.ndarray) -> None:
    """Puts these suffixes behind the rest of their groups, a new group for each count, greater counts further behind."""
    order = np.lexsort((count, group[moved]))
    moved, count = moved[order], count[order]
    old = group[moved]
    new_old = np.concatenate([[True], old[1:] != old[:-1]])
    head = np.flatnonzero(new_old)
    many = np.diff(np.concatenate([head, [len(old)]]))
    cut = end[old[head]] - many  # where the moved ones begin
    to = _ranges(cut, many)
    was = place[moved]
    marked[moved] = True
    held = at[to]
    held = held[~marked[held]]
    marked[moved] = False
    free = was[was < np.repeat(cut, many)]
    at[free], place[held] = held, free
    at[to], place[moved] = moved, to
    end[old[head]] = cut
    run = np.flatnonzero(new_old | np.concatenate([[True], count[1:] != count[:-1]]))
    length = np.diff(np.concatenate([run, [len(old)]]))
    end[to[run]] = to[run] + length
    group[moved] = np.repeat(to[run], length)


def _emit_all(group: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Second phase for all texts, place by place."""
    n = len(group)
    out, free = np.full(n, -1), np.arange(n)
    open_ = np.ones(n, bool)
    order = np.argsort(-np.diff(first), kind="stable")
    begin, size = first[:-1][order], np.diff(first)[order]
    out[begin] = begin + size - 1
    open_[begin + size - 1] = False
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size, -k, side="left"))
        start = begin[:live]
        j = out[start + k] - 1
        while True:
            on = j >= start
            on[on] = open_[j[on]]
            j, start = j[on], start[on]
            if not len(j):
                break
            g = group[j]
            f = free[g]
            out[f] = j
            free[g] = f + 1
            open_[j] = False
            j = before[j]
    return out
