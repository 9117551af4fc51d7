"""Query patterns: small connected labelled graphs, kept on the driver."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """Labels of the vertices 0..n-1 and undirected edges (a, b) with a < b, in order.

    Loops and repeated edges are dropped. A pattern without vertices, with an edge to a vertex it
    doesn't have, or one that isn't connected raises ``ValueError``.
    """

    labels: tuple[int, ...]
    edges: tuple[tuple[int, int], ...]
    adjacent: tuple[frozenset[int], ...] = field(init=False, compare=False)

    def __init__(self, labels: Iterable[int], edges: Iterable[tuple[int, int]]):
        labels = tuple(int(x) for x in labels)
        clean = tuple(sorted({(min(a, b), max(a, b)) for a, b in edges if a != b}))
        if not labels:
            raise ValueError("a pattern needs a vertex")
        if any(not 0 <= a < b < len(labels) for a, b in clean):
            raise ValueError("an edge names a vertex that the pattern doesn't have")
        near: list[set[int]] = [set() for _ in labels]
        for a, b in clean:
            near[a].add(b)
            near[b].add(a)
        object.__setattr__(self, "labels", labels)
        object.__setattr__(self, "edges", clean)
        object.__setattr__(self, "adjacent", tuple(map(frozenset, near)))
        if len(self.reach({0})) != len(labels):
            raise ValueError("the pattern isn't connected")

    @property
    def n(self) -> int:
        return len(self.labels)

    def degree(self, u: int) -> int:
        return len(self.adjacent[u])

    def nlf(self, u: int) -> Counter:
        """Labels of u's neighbours and how often each occurs."""
        return Counter(self.labels[v] for v in self.adjacent[u])

    def reach(self, start: set[int]) -> set[int]:
        seen, todo = set(start), list(start)
        while todo:
            for v in self.adjacent[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    def core_numbers(self) -> list[int]:
        """k-core number of each vertex: its degree when the vertex of least degree is removed, again and again."""
        degree = {u: self.degree(u) for u in range(self.n)}
        core, level = [0] * self.n, 0
        while degree:
            u = min(degree, key=lambda x: (degree[x], x))
            level = max(level, degree[u])
            core[u] = level
            for v in self.adjacent[u]:
                if v in degree and v != u:
                    degree[v] -= 1
            del degree[u]
        return core

    def degeneracy_order(self) -> list[int]:
        """Vertices as they are peeled, the least degree first."""
        degree = {u: self.degree(u) for u in range(self.n)}
        order = []
        while degree:
            u = min(degree, key=lambda x: (degree[x], x))
            order.append(u)
            del degree[u]
            for v in self.adjacent[u]:
                if v in degree:
                    degree[v] -= 1
        return order

    def edge_kind(self, a: int, b: int) -> str:
        """core: both ends in the 2-core; leaf: an end of degree 1; else tree."""
        core = self.core_numbers()
        if core[a] > 1 and core[b] > 1:
            return "core"
        return "leaf" if 1 in (self.degree(a), self.degree(b)) else "tree"

    @classmethod
    def from_text(cls, text: str) -> Pattern:
        """A pattern of the text format: ``t N M``, ``v id label [degree]``, ``e a b`` lines."""
        labels: dict[int, int] = {}
        edges = []
        for line in text.splitlines():
            part = line.split()
            if part[:1] == ["v"]:
                labels[int(part[1])] = int(part[2])
            elif part[:1] == ["e"]:
                edges.append((int(part[1]), int(part[2])))
        if sorted(labels) != list(range(len(labels))):
            raise ValueError("vertex numbers must be 0 to n - 1")
        return cls([labels[k] for k in range(len(labels))], edges)
