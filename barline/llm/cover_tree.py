"""Cover trees of unit vectors and their dual traversal, inside one task."""

from __future__ import annotations

import numpy as np

LEAF = 64
SLACK = 1e-9  # rounding of distances; only whole nodes are decided with it
ROWS_AT_ONCE = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Node:
    """Points within radius of a centre; the children's radii are at most half the level above."""

    __slots__ = ("centre", "radius", "points", "children", "centres", "radii")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int):
        away = distances(x[points], x[centre][None])[:, 0]
        self.centre, self.radius, self.points, self.children = centre, float(away.max()), points, []
        if len(points) > LEAF and self.radius > 1e-7:
            half = 2.0 ** (np.ceil(np.log2(self.radius)) - 1)
            left, at = points, centre
            while len(left):
                near = distances(x[left], x[at][None])[:, 0] <= half
                near[left == at] = True
                self.children.append(Node(x, left[near], at))
                left = left[~near]
                at = left[0] if len(left) else -1
            self.centres = x[[c.centre for c in self.children]]
            self.radii = np.array([c.radius for c in self.children])


class Links:
    """Numbers of linked vectors and groups of connected points."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.counts = np.zeros(len(weights), np.int64)
        self.parent = np.arange(len(weights))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def add(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> None:
        """Links of points a and b by a matrix; its diagonal counts for nothing when they are the same."""
        if same:
            linked = linked & ~np.eye(len(a), dtype=bool)
        if not linked.any():
            return
        self.counts[a] += linked @ self.weights[b]
        if not same:
            self.counts[b] += self.weights[a] @ linked
        roots_a, roots_b = (np.array([self.root(i) for i in side]) for side in (a, b))
        i, j = np.nonzero(linked)
        for one, two in {(p, q) for p, q in zip(roots_a[i].tolist(), roots_b[j].tolist()) if p != q}:
            self.join(one, two)

    def add_all(self, a: Node, b: Node) -> None:
        """Every point of a with every point of b."""
        if a is b:
            self.counts[a.points] += self.weights[a.points].sum() - self.weights[a.points]
        else:
            self.counts[a.points] += self.weights[b.points].sum()
            self.counts[b.points] += self.weights[a.points].sum()
        if len(a.points) > 1 or a is not b:
            for i in np.concatenate([a.points, b.points]):
                self.join(int(i), a.centre)


def traverse(x: np.ndarray, first: Node, second: Node, similarity: float, links: Links) -> None:
    """All links between the points of two trees, or within one tree given twice.

    A pair of nodes is left when even its nearest points are too far apart, counted as a whole
    when even its farthest are near enough, and else opened.  Points are compared exactly.
    """
    reach = float(np.sqrt(2.0 - 2.0 * similarity))
    open_pairs = [(first, second)]
    while open_pairs:
        a, b = open_pairs.pop()
        if a is b and 2 * a.radius <= reach - SLACK:
            links.add_all(a, a)
            continue
        if not a.children and not b.children:
            links.add(a.points, b.points, x[a.points] @ x[b.points].T >= similarity, a is b)
            continue
        split_a = bool(a.children) and (a is b or not b.children or a.radius >= b.radius / 4)
        split_b = bool(b.children) and (a is b or not a.children or b.radius >= a.radius / 4)
        own, other = a.children if split_a else [a], b.children if split_b else [b]
        right, right_radii = (b.centres, b.radii) if split_b else (x[b.centre][None], np.array([b.radius]))
        left, left_radii = (a.centres, a.radii) if split_a else (x[a.centre][None], np.array([a.radius]))
        for start in range(0, len(own), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            bound = left_radii[part, None] + right_radii[None]
            away = distances(left[part], right)
            for i, j in zip(*np.nonzero(away <= bound + reach + SLACK)):
                p, q = own[start + i], other[j]
                if a is b and start + i > j:
                    continue
                if p is not q and away[i, j] + bound[i, j] <= reach - SLACK:
                    links.add_all(p, q)
                else:
                    open_pairs.append((p, q))
