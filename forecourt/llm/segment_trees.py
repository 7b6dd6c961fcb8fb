"""Hash-consed segment trees over runs of term ids, and their simultaneous traversal.

A tree stands for the counts of one group over the terms of a block. Equal counts share a leaf and
equal pairs of children share a node, across all groups of the forest, so a node is its number and
equal subtrees are equal numbers.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """The trees of the rows of `counts` (groups, terms); terms that fill up to a power of two have none."""

    def __init__(self, counts: np.ndarray):
        groups, terms = counts.shape
        width = 1 << max(0, int(terms - 1).bit_length())
        full = np.full((groups, width), -1, np.int64)
        full[:, :terms] = counts
        self.leaves, nodes = np.unique(full, return_inverse=True)
        nodes, size = nodes.reshape(groups, width), len(self.leaves)
        self.left: list[np.ndarray] = []  # by level from below: the left child of each node
        self.right: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            both, above = np.unique(nodes[:, ::2].astype(np.int64) * size + nodes[:, 1::2], return_inverse=True)
            nodes = above.reshape(groups, -1)
            self.left.append(both // size)
            self.right.append(both % size)
            size = len(both)
        self.roots = nodes[:, 0]

    def price(self, a: int, b: int, total_a: int, total_b: int, kept: int) -> tuple[int, int]:
        """The divergences of the tree a from b and of b from a; a pair of nodes is priced once.

        Goes down both trees at once, level by level, with each pair of nodes only once, prices
        the pairs of leaves and adds the prices up on the way back.
        """
        pair_a, pair_b = np.array([a]), np.array([b])
        met = []
        for left, right in zip(reversed(self.left), reversed(self.right), strict=True):
            size = int(max(left.max(), right.max())) + 1
            below = np.concatenate([left[pair_a] * size + left[pair_b], right[pair_a] * size + right[pair_b]])
            below, at = np.unique(below, return_inverse=True)
            met.append(at)
            pair_a, pair_b = below // size, below % size
        count_a, count_b = self.leaves[pair_a], self.leaves[pair_b]
        p, q = shares(count_a, total_a, kept), shares(count_b, total_b, kept)
        gap = np.where(count_a < 0, 0, (p - q) ** 2)
        there, back = gap // q, gap // p
        for at in reversed(met):
            half = len(at) // 2
            there = there[at[:half]] + there[at[half:]]
            back = back[at[:half]] + back[at[half:]]
        return int(there[0]), int(back[0])


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(1000000000 * (count + 1) / (total + kept)), in two steps of a long division that fit 64 bits."""
    whole = max(1, total + kept)
    high, rest = np.divmod((counts + 1) * 100_000, whole)
    return 1 + high * 10_000 + rest * 10_000 // whole
