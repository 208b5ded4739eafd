"""A forest of BK-trees over 64-bit fingerprints, held in arrays.

Every shard is one tree. A child hangs under its parent by an edge that carries
their Hamming distance; all trees of a block grow a level at a time, and all
queries of a block descend a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGES = 65  # distances 0..64
FRONTIER = 2_000_000


class Forest:
    """Trees over `values` (uint64, distinct within a tree); `root[i]` is the index of the first value of i's tree."""

    def __init__(self, values: np.ndarray, root: np.ndarray):
        self.values = values
        at = root.astype(np.int64).copy()
        pending = np.flatnonzero(at != np.arange(len(at)))
        edges, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(pending):
            distance = np.bitwise_count(values[pending] ^ values[at[pending]]).astype(np.int64)
            edge = at[pending] * EDGES + distance
            unique, first, back = np.unique(edge, return_index=True, return_inverse=True)
            child = pending[first]
            edges.append(unique)
            children.append(child)
            at[pending] = child[back]
            pending = pending[at[pending] != pending]
        edge = np.concatenate(edges)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], np.concatenate(children)[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, value index) at most `radius` apart, following only edges that can lead there."""
        who, node = np.arange(len(queries)), roots.astype(np.int64)
        while len(who):
            distance = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            yield who[near], node[near]
            low = np.searchsorted(self.edge, node * EDGES + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edge, node * EDGES + np.minimum(distance + radius, EDGES - 1), "right")
            n = high - low
            who = np.repeat(who, n)
            node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def linked(values: np.ndarray, shard: np.ndarray, member: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest index of a row that it is linked to through its shard's tree.

    Rows of a shard stand together. Members are in the tree and query it; others
    only query it.
    """
    count = len(values)
    label = np.arange(count)
    nodes = np.flatnonzero(member)
    if not len(nodes):
        return label
    first = np.flatnonzero(np.r_[True, shard[nodes][1:] != shard[nodes][:-1]])
    tree = np.repeat(first, np.diff(np.r_[first, len(nodes)]))
    forest = Forest(values[nodes], tree)
    place = np.searchsorted(shard[nodes][first], shard)
    place = np.minimum(place, len(first) - 1)
    asks = np.flatnonzero(shard[nodes][first][place] == shard)
    roots = first[place[asks]]
    size = np.bincount(tree, minlength=len(nodes))[roots]
    cut = np.searchsorted(np.cumsum(size), np.arange(FRONTIER, size.sum() + FRONTIER, FRONTIER), "right")
    start = 0
    for end in dict.fromkeys([*cut.tolist(), len(asks)]):
        end = max(end, start + 1)
        part = asks[start:end]
        for who, node in forest.within(values[part], roots[start:end], radius):
            join(label, part[who], nodes[node])
        start = end
        if start >= len(asks):
            break
    return flat(label)


def flat(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label[:] = up


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]."""
    while True:
        flat(label)
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
