"""Signature trees: bitmaps of token sets, joined by levels, and the dual traversal that finds pairs of sets that may be similar.

A set's signature has a bit for each token hash, at one to two times as many places as tokens.  Tokens that fall on one bit are its excess: a set's
tokens in a range of bits are as many as its bits there and its excess at most.  A node of the tree holds the OR of its sets' signatures,
the smallest size, the largest overlap that a set of it can have (its size, or less where more is known), the largest
excess, and the group of its sets, if they are of one group.  So two nodes' sets share at most
min(bits that both have + the smaller excess, both largest overlaps) tokens; where that is too few for the
smallest sizes, or all sets are of one group, no pair below needs a look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lodeworks.llm.common import mix64

FAN = 8
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Bytes of signatures that a step of the traversal compares at once.
STEP_BYTES = 4 << 20


def signature(tokens: np.ndarray) -> np.ndarray:
    """The signature of a set of 64-bit hashes; its length is a power of two, so that signatures fold onto shorter ones."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length())) if len(tokens) else LEAST_BITS
    on = np.zeros(bits, bool)
    on[(mix64(tokens) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


def folded(signatures: np.ndarray, words: int) -> np.ndarray:
    """Rows of signatures as signatures of fewer words."""
    return np.bitwise_or.reduce(signatures.reshape(len(signatures), -1, words), axis=1)


def enough(overlap, size_a, size_b, num: int, den: int):
    """Whether so many common tokens give sets of these sizes a Jaccard similarity of num / den."""
    return (den + num) * overlap >= num * (size_a + size_b)


def may_link(sig_a: np.ndarray, sig_b: np.ndarray, size_a: int, size_b: int, num: int, den: int) -> bool:
    """Whether the signatures of two sets allow the similarity."""
    words = min(len(sig_a), len(sig_b))
    a, b = folded(sig_a[None], words)[0], folded(sig_b[None], words)[0]
    on = lambda x: int(np.bitwise_count(x).sum())
    return bool(enough(min(on(a & b) + min(size_a - on(a), size_b - on(b)), size_a, size_b), size_a, size_b, num, den))


class SignatureTree:
    """Levels of nodes; level 0 has the sets, each other one the nodes of FAN neighbours below."""

    def __init__(self, signatures: np.ndarray, size: np.ndarray, overlap: np.ndarray, group: np.ndarray):
        excess = size - np.bitwise_count(signatures).sum(axis=1, dtype=np.int64)
        self.levels = [(signatures, size, overlap, excess, group, group)]
        while len(self.levels[-1][0]) > FAN:
            below = self.levels[-1]
            cuts = np.arange(0, len(below[0]), FAN)
            joined = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, cuts, axis=0) for f, x in zip(joined, below)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _pairs(nodes_a: int, nodes_b: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    a, b = (x.ravel() for x in np.meshgrid(np.arange(nodes_a), np.arange(nodes_b), indexing="ij"))
    return (a[a <= b], b[a <= b]) if same else (a, b)


def _children(tree: SignatureTree, k: int, nodes: np.ndarray) -> np.ndarray:
    """The nodes of level k below nodes of level k + 1, FAN columns, -1 where there is none; a tree of fewer levels stays where it is."""
    count = len(tree.level(k)[0])
    if k >= len(tree.levels) - 1:
        return np.concatenate([nodes[:, None], np.full((len(nodes), FAN - 1), -1)], axis=1)
    below = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(below < count, below, -1)


def dual_traversal(x: SignatureTree, y: SignatureTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (places in x, places in y) of different groups that may be similar; of one tree with itself, each pair once.

    Depth first: what is held is bounded by the height, not by the number of pairs.
    """
    same = x is y
    top = max(len(x.levels), len(y.levels)) - 1
    step = max(64, STEP_BYTES // max(1, 8 * x.levels[0][0].shape[1]))
    a, b = _pairs(len(x.level(top)[0]), len(y.level(top)[0]), same)
    stack = [(top, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
    while stack:
        k, a, b = stack.pop()
        if k == 0 and same:
            a, b = a[a != b], b[a != b]
        (bits_a, low_a, most_a, excess_a, first_a, last_a), (bits_b, low_b, most_b, excess_b, first_b, last_b) = x.level(k), y.level(k)
        keep = (np.minimum(first_a[a], first_b[b]) != np.maximum(last_a[a], last_b[b])) & enough(np.minimum(most_a[a], most_b[b]), low_a[a], low_b[b], num, den)
        a, b = a[keep], b[keep]
        common = np.bitwise_count(bits_a[a] & bits_b[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess_a[a], excess_b[b])
        keep = enough(common, low_a[a], low_b[b], num, den)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if k == 0:
            yield a, b
            continue
        below_a, below_b = np.repeat(_children(x, k - 1, a), FAN, axis=1).ravel(), np.tile(_children(y, k - 1, b), (1, FAN)).ravel()
        real = (below_a >= 0) & (below_b >= 0)
        if same:
            real &= below_a <= below_b
        below_a, below_b = below_a[real], below_b[real]
        stack += [(k - 1, below_a[i : i + step], below_b[i : i + step]) for i in range(0, len(below_a), step)]


def tree_join(signatures: list[bytes], size: np.ndarray, overlap: np.ndarray, group: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different groups that may be similar: all pairs, or, if side has two values, those between the two.

    Rows of one length of signature are a tree, in order of group and size; trees of different lengths meet on the shorter one.
    """
    sides = np.unique(side).tolist()
    words = np.array([len(s) // 8 for s in signatures])
    trees = []
    for s in sides:
        for w in np.unique(words[side == s]).tolist():
            rows = np.flatnonzero((side == s) & (words == w))
            rows = rows[np.lexsort((size[rows], group[rows]))]
            trees.append((s, w, rows, np.stack([np.frombuffer(signatures[i], np.uint64) for i in rows.tolist()])))
    grown: dict[tuple[int, int], SignatureTree] = {}

    def tree(k: int, w: int) -> SignatureTree:
        if (k, w) not in grown:
            _, _, rows, bits = trees[k]
            grown[k, w] = SignatureTree(folded(bits, w), size[rows], overlap[rows], group[rows])
        return grown[k, w]

    for i in range(len(trees)):
        for j in range(i, len(trees)):
            if len(sides) > 1 and trees[i][0] == trees[j][0]:
                continue
            small, large = sorted((size[trees[k][2]] for k in (i, j)), key=np.max)
            if den * small.max() < num * large.min():
                continue
            w = min(trees[i][1], trees[j][1])
            for a, b in dual_traversal(tree(i, w), tree(j, w), num, den):
                yield trees[i][2][a], trees[j][2][b]
