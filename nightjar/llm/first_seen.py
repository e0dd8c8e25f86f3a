"""Skew-proof "who had this key first" over a corpus.

A map task first settles a key among the rows of its own slice: only the
slice's first holder goes into the shuffle under the key, every later holder
is settled on the spot and travels under a spread key of its own.  So a key
held by a third of all documents costs one row per slice, and the reducer
streams sorted rows holding one row of state.
"""

from __future__ import annotations

import numpy as np

#: Ids that are null take part as this one id, after all others.
NULL_ID = (1 << 63) - 1


def leaders(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the index of the first row (by ``order``) with the same
    keys, and the number of rows with the same keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    leader, size = np.empty(n, np.int64), np.empty(n, np.int64)
    leader[by] = by[np.flatnonzero(new)][group]
    size[by] = np.bincount(group)[group]
    return leader, size


class GroupStream:
    """Groups of rows sorted by ``keys``, batch after batch.

    ``feed`` takes a batch's columns and returns (columns, leader, follower,
    second): columns with the open group's first row put in front, for each
    row the index of its group's first row, whether it is a follower, and
    whether it is the first follower of its group."""

    def __init__(self, keys: list[str]):
        self.keys, self.front, self.followed = keys, None, False

    def feed(self, columns: dict[str, np.ndarray]):
        fronted = self.front is not None
        if fronted:
            columns = {k: np.concatenate([self.front[k], v]) for k, v in columns.items()}
        n = len(columns[self.keys[0]])
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in self.keys], axis=0)
        starts = np.flatnonzero(new)
        leader = starts[np.cumsum(new) - 1]
        index = np.arange(n)
        follower = index != leader
        second = index == leader + 1
        if fronted and self.followed and n > 1:
            second[1] &= leader[1] != 0
        last = leader[-1]
        self.followed = bool(follower[-1] or (last == 0 and fronted and self.followed))
        self.front = {k: v[last:last + 1] for k, v in columns.items()}
        return columns, leader, follower, second
