"""Execution plans: a list of operators, bushy or one node, as objects and as JSON.

Operator types: 0 a hash join of two children on shared vertices, 1 a vertex-at-a-time join of a
sub-pattern, with an optional child as its prefix. The JSON has the fields that plan files have; in
such files the field "Operator type" stands before each node and again in it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftgraph.operators.relations import hash_join
from weftgraph.pattern import Pattern
from weftgraph.plans.extend import extend, injective
from weftgraph.plans.orders import Sizes, check
from weftgraph.plans.reduce import Relations

HASH_JOIN, WCOJ = 0, 1
_NAME = {HASH_JOIN: "No Partition Hash Join", WCOJ: "Leap Frog Trie Join"}


@dataclass
class Node:
    kind: int
    id: int
    vertices: list[int]
    parent: int = -1
    child: int = -1
    child_vertices: list[int] = field(default_factory=list)
    left: int = -1
    left_vertices: list[int] = field(default_factory=list)
    left_keys: list[int] = field(default_factory=list)
    right: int = -1
    right_vertices: list[int] = field(default_factory=list)
    right_keys: list[int] = field(default_factory=list)
    ratio: float = 1.0

    def fields(self) -> dict:
        head = {"Operator type": self.kind}
        if self.kind == WCOJ:
            return head | {"Id": self.id, "Parent": self.parent, "Vertices": self.vertices, "Child": self.child, "Child vertices": self.child_vertices}
        return head | {
            "Hash table size ratio": self.ratio,
            "Id": self.id,
            "Parent": self.parent,
            "Vertices": self.vertices,
            "Left child": self.left,
            "Left child vertices": self.left_vertices,
            "Left child key position": self.left_keys,
            "Right child": self.right,
            "Right child vertices": self.right_vertices,
            "Right child key position": self.right_keys,
        }

    @classmethod
    def of(cls, f: dict) -> Node:
        kind = f["Operator type"]
        if kind == WCOJ:
            return cls(kind, f["Id"], list(f["Vertices"]), f["Parent"], f["Child"], list(f["Child vertices"]))
        return cls(
            kind, f["Id"], list(f["Vertices"]), f["Parent"], left=f["Left child"], left_vertices=list(f["Left child vertices"]), left_keys=list(f["Left child key position"]),
            right=f["Right child"], right_vertices=list(f["Right child vertices"]), right_keys=list(f["Right child key position"]), ratio=f.get("Hash table size ratio", 1.0),
        )


@dataclass
class Plan:
    """Nodes in the order in which they run; the last is the result."""

    nodes: list[Node]

    @classmethod
    def single(cls, order: list[int]) -> Plan:
        return cls([Node(WCOJ, 0, list(order))])

    @classmethod
    def bushy(cls, left: list[int], right: list[int]) -> Plan:
        """Two sub-patterns by their orders, hash-joined on the one or two vertices that they share."""
        shared = [u for u in left if u in right]
        if not 1 <= len(shared) <= 2:
            raise ValueError("a hash join has one or two shared vertices")
        vertices = [*left, *[u for u in right if u not in shared]]
        join = Node(HASH_JOIN, 2, vertices, left=0, left_vertices=list(left), left_keys=[left.index(u) for u in shared], right=1, right_vertices=list(right), right_keys=[right.index(u) for u in shared])
        return cls([Node(WCOJ, 0, list(left), parent=2), Node(WCOJ, 1, list(right), parent=2), join])

    def to_json(self) -> str:
        lines = [f'    "Num of Operators": {len(self.nodes)}']
        for n in self.nodes:
            lines.append(f'    "Operator type": {n.kind}')
            lines.append(f'    "{_NAME[n.kind]}": {json.dumps(n.fields())}')
        return "{\n" + ",\n".join(lines) + "\n}"

    @classmethod
    def from_json(cls, text: str) -> Plan:
        names = set(_NAME.values())
        top = json.loads(text, object_pairs_hook=lambda pairs: dict(pairs) if not any(k in names for k, _ in pairs) else pairs)
        if isinstance(top, dict):
            raise ValueError("the plan has no operators")
        nodes = [Node.of(v) for k, v in top if k in names]
        if dict(top).get("Num of Operators", len(nodes)) != len(nodes):
            raise ValueError("the plan's number of operators doesn't match")
        return cls(nodes)

    def describe(self) -> str:
        return "\n".join(f"{n.id}: {_NAME[n.kind]} {n.vertices}" + (f" of {n.left} and {n.right}" if n.kind == HASH_JOIN else f" on {n.child}" * (n.child >= 0)) for n in self.nodes)

    def frame(self, pattern: Pattern, relations: Relations, injection: bool, how: str = "semi", sizes: Sizes | None = None) -> DataFrame:
        """The plan as one DataFrame with a column for each pattern vertex.

        Edges between the sides of a hash join that neither side has are checked after it.
        """
        done: dict[int, tuple[DataFrame, list[int]]] = {}
        for n in self.nodes:
            if n.kind == WCOJ:
                done[n.id] = self._extended(n, done, pattern, relations, injection, how, sizes), n.vertices
            else:
                done[n.id] = self._joined(n, done, pattern, relations, injection), n.vertices
        df, vertices = done[self.nodes[-1].id]
        check(pattern, vertices) if self.nodes[-1].kind == WCOJ else None
        if sorted(vertices) != list(range(pattern.n)):
            raise ValueError("the last operator doesn't hold all vertices of the pattern")
        return df.select(*[f"u{u}" for u in range(pattern.n)])

    def _extended(self, n: Node, done, pattern, relations, injection, how, sizes) -> DataFrame:
        prefix = None
        if n.child >= 0:
            prefix = done[n.child][0].select(*[f"u{u}" for u in n.child_vertices])
        return extend(pattern, relations, n.vertices, injection, how, sizes, prefix)

    def _joined(self, n: Node, done, pattern, relations, injection) -> DataFrame:
        left, right = done[n.left][0], done[n.right][0]
        keys = [n.left_vertices[i] for i in n.left_keys]
        if len(keys) > 2 or keys != [n.right_vertices[i] for i in n.right_keys]:
            raise ValueError("a hash join has one or two keys, the same vertices on both sides")
        df = hash_join(left, right, [f"u{u}" for u in keys], [f"u{u}" for u in keys])
        ls, rs = [u for u in n.left_vertices if u not in keys], [u for u in n.right_vertices if u not in keys]
        if injection:
            for u in rs:
                rule = injective(pattern, ls, u)
                df = df if rule is None else df.where(rule)
        for a, b in pattern.edges:
            if (a in ls and b in rs) or (b in ls and a in rs):
                df = df.join(relations[a, b], [f"u{a}", f"u{b}"], "left_semi")
        return df.select(*[f"u{u}" for u in n.vertices])
