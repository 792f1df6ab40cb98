"""Deep-shallow sorting of fixed-width strings.

Shallow: multikey quicksort by 8-byte words down to a given depth; the ternary splits of all groups of one
depth are made together, as one sort by (group, word). Deep: each group that still agrees there is ordered
by a blind trie, whose inner nodes hold only a depth and a branch byte per child; a string goes down
without comparing, is compared once with the leaf it meets, and is hung in where the two part.
"""

from __future__ import annotations

import numpy as np

WORD = 8


class BlindTrie:
    """Orders strings of one width; equal strings share a leaf."""

    def __init__(self, width: int):
        self.width = width
        self.root: list | None = None  # inner: [depth, {byte: child}]; leaf: [None, string, number, members]

    def insert(self, string: bytes, member: int) -> None:
        number = int.from_bytes(string, "big")
        node = self.root
        if node is None:
            self.root = [None, string, number, [member]]
            return
        while node[0] is not None:  # blind: a missing branch is as good as any
            below = node[1].get(string[node[0]])
            node = below if below is not None else next(iter(node[1].values()))
        part = number ^ node[2]
        if not part:
            node[3].append(member)
            return
        depth = self.width - (part.bit_length() + 7) // 8  # common bytes with the leaf
        other = node[1][depth]
        leaf = [None, string, number, [member]]
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        if node[0] == depth:
            node[1][string[depth]] = leaf
            return
        split = [depth, {other: node, string[depth]: leaf}]
        if above is None:
            self.root = split
        else:
            above[1][string[above[0]]] = split

    def order(self) -> list[int]:
        out: list[int] = []
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                out += node[3]
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, shallow: int) -> np.ndarray:
    """Order of ``rows`` (n x width bytes), by content; ``shallow``: bytes that quicksort compares."""
    n, width = rows.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the places in the order
    for at in range(0, min(shallow, width), WORD):
        word = np.zeros((n, WORD), np.uint8)
        part = rows[:, at:min(at + WORD, width)]
        word[:, :part.shape[1]] = part
        key = word.view(">u8").ravel().astype(np.uint64)[order]
        again = np.lexsort((key, group))
        order, key, group = order[again], key[again], group[again]
        if n:
            new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
            group = np.cumsum(new) - 1
    if n < 2 or shallow >= width:
        return order
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], n]
    tail = np.ascontiguousarray(rows[:, shallow:])
    raw, size = tail.tobytes(), width - shallow
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a < 2:
            continue
        trie = BlindTrie(size)
        for i in order[a:b].tolist():
            trie.insert(raw[i * size:(i + 1) * size], i)
        order[a:b] = trie.order()
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes of each row in the order with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        apart = rows[order[1:]] != rows[order[:-1]]
        out[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return out
