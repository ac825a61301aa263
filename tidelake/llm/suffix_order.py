"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, over many strings at once, in numpy."""

from __future__ import annotations

import numpy as np

_FIRST = 7  # bytes that one initial key holds, at 9 bits each (0: past the end)


def suffix_array(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of the strings that stand one after another in
    ``text``; ``left[i]`` is how many bytes the string of position i has from there on.
    Equal suffixes have equal ranks and stand in the order of their positions.

    Suffixes are first sorted by seven bytes.  Then only groups not yet told apart
    are sorted again, by the rank of what follows, at twice the depth each time."""
    n = len(text)
    key = text.astype(np.uint64) + np.uint64(1)
    for have, more in ((1, 1), (2, 2), (4, 3)):  # to two, four and seven bytes, each from what the position after has
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - have, 0)] = key[have:] >> np.uint64(9 * (have - more))
        key = (key << np.uint64(9 * more)) | np.where(left > have, ahead, np.uint64(0))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    known = _FIRST
    depth = int(left.max(initial=0))
    while known < depth:
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        rows = order[places]
        ahead = np.where(left[rows] > known, rank[np.minimum(rows + known, n - 1)] + 1, 0)
        joint = rank[rows] * (n + 1) + ahead
        by = np.argsort(joint, kind="stable")
        rows, joint = rows[by], joint[by]
        order[places] = rows
        split = np.ones(len(rows), bool)
        split[1:] = joint[1:] != joint[:-1]
        fresh[places] = split
        rank[rows] = places[np.maximum.accumulate(np.where(split, np.arange(len(rows)), 0))]
        known *= 2
    return order, rank


def common_prefixes(text: np.ndarray, starts: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix, at most ``most``, that each suffix of ``order`` shares with the one before it.

    Kasai's rule: a suffix shares one byte less with its neighbour than the suffix
    that begins one byte earlier did, or more.  All strings advance together, one
    byte a step, each with its own count."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    at, shared = starts.copy(), np.zeros(len(starts), np.int64)
    remaining = left[starts].copy()
    while len(at):
        here = place[at]
        before = order[np.maximum(here - 1, 0)]
        limit = np.minimum(np.minimum(left[at], left[before]), most)
        limit[here == 0] = 0
        shared = np.minimum(shared, limit)
        open_ = np.flatnonzero(shared < limit)
        while len(open_):
            same = text[at[open_] + shared[open_]] == text[before[open_] + shared[open_]]
            open_ = open_[same]
            shared[open_] += 1
            open_ = open_[shared[open_] < limit[open_]]
        out[here] = shared
        remaining -= 1
        on = remaining > 0
        at, shared, remaining = at[on] + 1, np.maximum(shared[on] - 1, 0), remaining[on]
    return out
