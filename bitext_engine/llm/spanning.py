"""Links that connect a group, collected without spelling out its pairs; for use inside tasks."""

from __future__ import annotations

import numpy as np


class Links:
    """What is connected so far, and the links that connect it: at most one fewer than its nodes."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.get(node, node)) != node:
            parent[node] = node = parent.get(up, up)
        return node

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.root, nodes.tolist()), np.int64, len(nodes))

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((max(a, b), min(a, b)))

    def connect(self, x: int, nodes: np.ndarray, roots: np.ndarray, near: np.ndarray) -> None:
        """Link x with nodes[near], one link a root; `roots` of all nodes are kept up to date."""
        was, met = self.root(x), np.unique(roots[near])
        for root in met[met != was].tolist():
            self.join(x, root)
        if len(met):
            roots[np.isin(roots, np.append(met, was))] = self.root(x)


def runs(batches, columns: list[str]):
    """(key, part of a batch, whole) for every run of rows with equal `columns`, in batches sorted by them.

    A run that may go on in another batch is not `whole`.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        first = np.append(0, np.flatnonzero(change) + 1)
        last = np.append(first[1:], batch.num_rows)
        yield batch, [(tuple(k[a].item() for k in keys), a, b, 0 < i < len(first) - 1) for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True))]
