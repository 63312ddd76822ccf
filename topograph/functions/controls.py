"""Matched random subgraphs from an adjacency that fits in memory.

Choices are hash values of (seed, group, control, attempt, step, node), the same that plans/experiments.py computes in
joins, so both routes grow the same candidates.
"""

from __future__ import annotations

import numpy as np
import xxhash


def hashed(*key: object) -> int:
    """Spark's xxhash64 of the parts joined by |, as an unsigned number in the order of the signed one."""
    return xxhash.xxh64_intdigest("|".join(map(str, key)).encode(), 42) ^ (1 << 63)


def uniform(*key: object) -> float:
    """In [0, 1)."""
    return ((hashed(*key) ^ (1 << 63)) >> 11) / 2.0**53


class Adjacency:
    """Neighbours, weights and degrees of a graph, by node number in the order of names."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = ends[: len(a)], ends[len(a) :]
        source, target, weight = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
        order = np.argsort(source, kind="stable")
        self.target, self.weight = target[order], np.where(np.isnan(weight), 1.0, weight)[order]
        self.start = np.searchsorted(source[order], np.arange(len(self.names) + 1))
        self.degree = np.diff(self.start)
        self.words = self.names.tolist()
        self.number = {n: k for k, n in enumerate(self.words)}

    def near(self, v: int) -> np.ndarray:
        return self.target[self.start[v] : self.start[v + 1]]

    def facts(self, nodes: list[int]) -> tuple[float, float, float]:
        """Density and mean strength inside, mean degree in the whole graph."""
        inside, n = set(nodes), len(nodes)
        edges, strength = 0, 0.0
        for v in nodes:
            for u, w in zip(self.near(v).tolist(), self.weight[self.start[v] : self.start[v + 1]].tolist()):
                if u in inside and u != v:
                    edges, strength = edges + 1, strength + w
        return (edges / (n * (n - 1)) if n > 1 else 0.0), strength / max(n, 1), float(self.degree[nodes].mean()) if n else 0.0


def grow(graph: Adjacency, size: int, banned: set[int], restart: float, seed: int, key: tuple, filter_frontier: bool = False) -> list[int]:
    """A connected candidate: walks to the frontier node of least hash, or restarts at the next free node from a hashed place on."""
    n, chosen, frontier = len(graph.words), {}, set()
    prefix = "|".join(map(str, key))

    def fresh(step: int) -> int | None:
        at = int(uniform(seed, prefix, step) * n)
        return next((v for v in ((at + o) % n for o in range(min(n, size + len(banned) + 1))) if v not in banned and v not in chosen), None)

    for step in range(size):
        v = None
        if step and frontier and uniform(seed + 1, prefix, step) > restart:
            v = min(frontier, key=lambda u: (hashed(seed, prefix, step, graph.words[u]), u))  # noqa: B023
        elif (v := fresh(step)) is None and frontier:
            v = min(frontier, key=lambda u: (hashed(seed, prefix, step, graph.words[u]), u))  # noqa: B023
        if v is None:
            break
        chosen[v] = None
        frontier.discard(v)
        frontier.update(u for u in graph.near(v).tolist() if u not in chosen and not (filter_frontier and u in banned))
    return list(chosen)


def match(graph: Adjacency, members: list[int], attempts: int, restart: float, tolerance: float, degree_tolerance: float, seed: int, key: tuple) -> tuple[list[int], float, tuple[float, float, float]]:
    """The first candidate that matches the members closely, else the best: nodes, score, the members' density, degree and strength."""
    density, strength, degree = graph.facts(members)
    best, best_score = [], float("inf")
    for attempt in range(attempts):
        nodes = grow(graph, len(members), set(members), restart, seed, (*key, attempt))
        d, s, g = graph.facts(nodes)
        off, far = abs(d - density), abs(g - degree) / max(degree, 1.0)
        score = off + far + abs(s - strength) / max(strength, 1.0)
        if off <= tolerance and far <= degree_tolerance:
            return nodes, score, (density, degree, strength)
        if score < best_score:
            best, best_score = nodes, score
    return best, best_score, (density, degree, strength)
