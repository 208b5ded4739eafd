"""Phrase counts in a HAT-trie: hash containers under a shallow trie of word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Entries at which a container bursts into a trie node with one container for each next id.
BURST = 4096


class Node:
    """A burst container: one subtree for each next id."""

    __slots__ = ("below",)

    def __init__(self) -> None:
        self.below: dict[int, Node | dict[bytes, int]] = {}


class HatTrie:
    """Counts of id sequences of one length.

    A container maps what is left of a sequence, four bytes an id, to its count.
    The root starts as a container; one that grows beyond `burst` becomes a node,
    unless a single id is left.
    """

    def __init__(self, length: int, burst: int = BURST) -> None:
        self.length, self.burst, self.entries = length, burst, 0
        self.root: Node | dict[bytes, int] = {}

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct sequences, one a row, sorted."""
        self.root = self._put(self.root, np.ascontiguousarray(rows, "<i4"), counts)

    def _put(self, held: Node | dict[bytes, int], rows: np.ndarray, counts: np.ndarray) -> Node | dict[bytes, int]:
        if isinstance(held, Node):
            cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]).tolist()
            for a, b in zip(cut, [*cut[1:], len(rows)], strict=True):
                first = int(rows[a, 0])
                held.below[first] = self._put(held.below.get(first, {}), np.ascontiguousarray(rows[a:b, 1:]), counts[a:b])
            return held
        before, keys = len(held), rows.view(f"V{4 * rows.shape[1]}")[:, 0].tolist()
        if held:
            for key, n in zip(keys, counts.tolist(), strict=True):
                held[key] = held.get(key, 0) + n
        else:
            held.update(zip(keys, counts.tolist(), strict=True))
        self.entries += len(held) - before
        return self._burst(held, rows.shape[1]) if len(held) > self.burst and rows.shape[1] > 1 else held

    def _burst(self, held: dict[bytes, int], left: int) -> Node:
        keys = np.frombuffer(b"".join(held), "<i4").reshape(-1, left)
        order = np.argsort(keys[:, 0], kind="stable")
        self.entries -= len(held)
        node = Node()
        self._put(node, keys[order], np.fromiter(held.values(), np.int64, len(held))[order])
        return node

    def _containers(self) -> Iterator[tuple[tuple[int, ...], dict[bytes, int], Node | None]]:
        waiting: list[tuple[tuple[int, ...], Node | dict[bytes, int], Node | None]] = [((), self.root, None)]
        while waiting:
            path, held, above = waiting.pop()
            if isinstance(held, Node):
                waiting += [((*path, first), below, held) for first, below in held.below.items()]
            else:
                yield path, held, above

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, largest container first, until at most `keep` entries are left: each as rows and counts."""
        for path, held, above in sorted(self._containers(), key=lambda c: -len(c[1])):
            if self.entries <= keep or not held:
                return
            left = np.frombuffer(b"".join(held), "<i4").reshape(len(held), -1)
            rows = np.hstack([np.tile(np.array(path, np.int32), (len(held), 1)), left]) if path else left
            counts = np.fromiter(held.values(), np.int64, len(held))
            self.entries -= len(held)
            if above is None:
                self.root = {}
            else:
                del above.below[path[-1]]
            yield rows, counts
