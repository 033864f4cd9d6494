"""Searches in rows that are sorted by group and number, inside pandas functions."""

from __future__ import annotations

import numpy as np


def first_at_least(groups: np.ndarray, at: np.ndarray, wanted_groups: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted (group, number) the first row of that group whose number is at least the wanted one, -1 if there is none.

    Rows are sorted by group, then number. Groups and numbers are compared as they are, so their products can't overflow.
    """
    n, m = len(at), len(wanted)
    # Merged in order, wanted ones before equal rows: the rows in front of a wanted one are those that are too small.
    order = np.lexsort((
        np.repeat(np.array([1, 0], dtype=np.int8), (n, m)), np.concatenate([at, wanted]), np.concatenate([groups, wanted_groups]),
    ))
    rows_before = np.cumsum(order < n)
    found = np.empty(m, dtype=np.int64)
    asked = order >= n
    found[order[asked] - n] = rows_before[asked]
    inside = found < n
    inside[inside] = groups[found[inside]] == wanted_groups[inside]
    return np.where(inside, found, -1)


def window_starts(groups: np.ndarray, at: np.ndarray, opened: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
    """Start of the window of each row; a window opens at the first row at least ``width`` after the last start.

    ``opened`` holds, for each group number, the window that is open before its first row, if ``known`` says so. Rows are sorted by group and number.
    """
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    codes = groups[first]
    front = np.where(known[codes], first_at_least(groups, at, codes, opened[codes] + width), first)
    front = front[front >= 0]
    after = first_at_least(groups, at, groups, at + width)
    begins = np.zeros(len(at), dtype=bool)
    while len(front):  # all groups move on by one window
        begins[front] = True
        front = after[front]
        front = front[front >= 0]
    owner = np.maximum.accumulate(np.where(begins, np.arange(len(at)), -1))
    own = owner >= 0
    own[own] = groups[owner[own]] == groups[own]
    return np.where(own, at[np.maximum(owner, 0)], opened[groups])
