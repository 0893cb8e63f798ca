"""Counts of phrases in a burst trie: a shallow trie over word ids whose leaves are hash containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bits of a word id; a phrase's ids after the first, packed, must fit 63 bits.
BITS = 21
WORD = (1 << BITS) - 1
#: Entries of a container from which it bursts into one for each next word.
BURST = 8192


class Branch(dict):
    """An inner node: from the next word's id to a container (a plain dict) or a further branch."""


class HatTrie:
    """Counts of phrases of ``order`` word ids, from two to four.

    Below the root, which parts by the first id, a container counts the rests of its
    phrases under their packed ids. One that grows over BURST entries becomes a branch with a container for each next id,
    as long as its phrases have more than one word left. Subtrees of one first id are counted, so that the largest go
    first when room is needed, each as one sorted run."""

    def __init__(self, order: int, burst: int = BURST):
        self.order, self.burst = order, burst
        self.root: dict = {}
        self.sizes: dict[int, int] = {}
        self.size = 0

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Count phrases given in order of (first, rest), each once."""
        edges = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True]))).tolist() if len(first) else [0]
        heads, rests, counts = first.tolist(), rest.tolist(), counts.tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            key = heads[a]
            node = self.root.get(key)
            if node is None:
                node = self.root[key] = {}
            node, more = self._put(node, self.order - 1, rests[a:b], counts[a:b])
            self.root[key] = node
            self.sizes[key] = self.sizes.get(key, 0) + more
            self.size += more

    def _put(self, node: dict, left: int, rests: list[int], counts: list[int]) -> tuple[dict, int]:
        """The node with the entries added, ``left`` words each, and how many of them are new."""
        if not isinstance(node, Branch):
            before, get = len(node), node.get
            for r, c in zip(rests, counts):
                node[r] = get(r, 0) + c
            more = len(node) - before
            return (self._burst(node, left) if left > 1 and len(node) > self.burst else node), more
        shift, more, a = BITS * (left - 1), 0, 0
        mask = (1 << shift) - 1
        while a < len(rests):
            key, b = rests[a] >> shift, a
            while b < len(rests) and rests[b] >> shift == key:
                b += 1
            node[key], new = self._put(node.get(key, {}), left - 1, [r & mask for r in rests[a:b]], counts[a:b])
            more, a = more + new, b
        return node, more

    def _burst(self, box: dict, left: int) -> Branch:
        shift, out = BITS * (left - 1), Branch()
        mask = (1 << shift) - 1
        for r, c in box.items():
            out.setdefault(r >> shift, {})[r & mask] = c
        return out

    def _leaves(self, node: dict, left: int, above: int) -> Iterator[tuple[int, dict]]:
        """Each container below ``node``, with the packed ids above it."""
        if isinstance(node, Branch):
            for key, below in node.items():
                yield from self._leaves(below, left - 1, above | key << BITS * (left - 1))
        else:
            yield above, node

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, rest, count) of whole subtrees, the largest first, until at most ``keep`` entries stay; each is sorted."""
        gone, sizes, rest, counts, above, leaves = [], [], [], [], [], []
        for key in sorted(self.sizes, key=lambda k: (-self.sizes[k], k)):
            if self.size <= keep:
                break
            for high, box in self._leaves(self.root.pop(key), self.order - 1, 0):
                rest.extend(box.keys())
                counts.extend(box.values())
                above.append(high)
                leaves.append(len(box))
            gone.append(key)
            sizes.append(self.sizes.pop(key))
            self.size -= sizes[-1]
        rest = np.array(rest, np.int64) | np.repeat(np.array(above, np.int64), leaves)
        order = np.lexsort((rest, np.repeat(np.arange(len(gone)), sizes)))
        return np.repeat(np.array(gone, np.int64), sizes), rest[order], np.array(counts, np.int64)[order]

    def words(self, first: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """The ids of each word of the phrases."""
        return [first, *(rest >> BITS * (self.order - 2 - j) & WORD for j in range(self.order - 1))]

