"""Sorted suffixes of a sequence: the work of one shard or subtree, in numpy.

``suffix_array`` is Larsson-Sadakane refinement: suffixes sorted by their first units,
then groups that are still equal are split by the rank of the suffix ``h`` further on,
``h`` doubling; groups of one are left alone. ``common_prefixes`` is Kasai's bound in
vector form: where the units before two neighbours are equal, their common prefix is
one less than that of the suffixes one unit earlier, so only the other positions are
compared unit by unit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of sorted keys, the index of the first entry of its group, and the entries that are not alone in theirs."""
    new = np.concatenate(([True], keys[1:] != keys[:-1], [True]))
    first = np.maximum.accumulate(np.where(new[:-1], np.arange(len(keys), dtype=np.int32), np.int32(0)))
    return first, np.flatnonzero(~(new[:-1] & new[1:])).astype(np.int32)


def suffix_array(keys: np.ndarray, h: int) -> np.ndarray:
    """Positions in the order of their suffixes; ``keys`` orders the first ``h`` units of each. Up to 2**31 units."""
    n = len(keys)
    order = np.argsort(keys).astype(np.int32)
    first, active = _groups(keys[order])
    rank = np.zeros(n + 1, np.int32)  # the last entry, 0, is the empty suffix
    rank[order] = first + 1
    while len(active) and h < 2 * n:
        at = order[active]
        key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at.astype(np.int64) + h, n)]
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[active] = at
        first, shared = _groups(key)
        rank[at] = active[first] + 1
        active = active[shared]
        h *= 2
    return order


def common_prefixes(units: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each entry of ``order``, the length of the common prefix with the entry before (0 for the first)."""
    n = len(units)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    known = before > 0
    known[0] = False
    known[1:] &= units[:-1] == units[before[1:] - 1]
    a = np.flatnonzero(~known & (before >= 0)).astype(np.int32)
    b = before[a]
    start = np.full(n, -n, np.int32)  # its place plus its length; where known, from the left
    start[~known] = np.flatnonzero(~known)
    length = 0
    while len(a):
        inside = (a < n - length) & (b < n - length)
        same = np.zeros(len(a), bool)
        same[inside] = units[a[inside] + length] == units[b[inside] + length]
        start[a[~same]] = a[~same] + length
        a, b = a[same], b[same]
        length += 1
    plcp = np.maximum.accumulate(start)
    plcp -= np.arange(n, dtype=np.int32)
    np.maximum(plcp, 0, out=plcp)
    plcp[before < 0] = 0
    return plcp[order]


@dataclass
class Nodes:
    """Deep internal nodes of the suffix tree: the interval of leaves and the depth of each."""

    leaves: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    depth: np.ndarray


def deep_nodes(units: np.ndarray, keys: np.ndarray, h: int, whole: np.ndarray, depth: int) -> Nodes:
    """The shallowest nodes of depth ``depth`` or more over the suffixes marked in ``whole``.

    Leaves are positions in suffix order. A node is a longest run of leaves whose
    neighbours share at least ``depth`` units; all its leaves start one repeat.
    """
    order = suffix_array(keys, h)
    shared = common_prefixes(units, order)
    kept = np.flatnonzero(whole[order])
    if len(kept) < 2:
        return Nodes(order[:0], *(np.zeros(0, np.int64) for _ in range(3)))
    # The common prefix of two kept neighbours is the least between them.
    between = np.minimum.reduceat(shared[: kept[-1] + 1], kept[:-1] + 1)
    leaves = order[kept]
    deep = np.concatenate(([False], between >= depth, [False]))
    first = np.flatnonzero(~deep[:-1] & deep[1:])
    stop = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    depths = np.array([], np.int64) if not len(first) else np.minimum.reduceat(np.append(between, 0), np.column_stack((first, stop - 1)).ravel())[::2]
    return Nodes(leaves, first, stop, depths)
