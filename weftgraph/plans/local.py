"""Depth-first enumeration over broadcast relations, for graphs whose relevant part is small.

Only used under a checked size: all directed edges between the pattern's labels, at most
``LOCAL_EDGES``. Start vertices are dealt to partitions; each is searched with intersections of
neighbour sets, early exit on empty ones, and failing sets (injective matches only): when no
match below a vertex failed because of its choice, its other choices are skipped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.pattern import Pattern
from weftgraph.plans.orders import backward

LOCAL_EDGES = 250_000


def pairs_of(pattern: Pattern) -> list[tuple[int, int]]:
    """Ordered label pairs of the pattern's edges, both ways."""
    return sorted({p for a, b in pattern.edges for p in ((pattern.labels[a], pattern.labels[b]), (pattern.labels[b], pattern.labels[a]))})


def relevant(graph: PropertyGraph, pattern: Pattern) -> DataFrame:
    """The edges between labels that the pattern joins."""
    return graph.between(pairs_of(pattern))


class Adjacency:
    """Neighbour sets by (vertex, label), and vertices by label, of a part of a graph."""

    def __init__(self, table: pa.Table):
        self.near: dict[tuple[int, int], set[int]] = {}
        self.by_label: dict[int, set[int]] = {}
        near, by_label = self.near, self.by_label
        for s, d, a, b in zip(*(table.column(c).to_pylist() for c in ("src", "dst", "sl", "dl"))):
            near.setdefault((s, b), set()).add(d)
            by_label.setdefault(a, set()).add(s)

    def candidates(self, pattern: Pattern, injection: bool) -> list[set[int]]:
        """Vertices of each label with the needed neighbour labels (their number too, if injective), reduced edge by edge, twice."""
        out = []
        for u in range(pattern.n):
            need: Counter = pattern.nlf(u)
            out.append({v for v in self.by_label.get(pattern.labels[u], ()) if all(len(self.near.get((v, x), ())) >= (k if injection else 1) for x, k in need.items())})
        for _ in range(2):
            for u in range(pattern.n):
                for w in pattern.adjacent[u]:
                    x = pattern.labels[w]
                    out[u] = {v for v in out[u] if not self.near[v, x].isdisjoint(out[w])}
        return out


class Search:
    """Matches below a start vertex, as lists in the order's sequence."""

    def __init__(self, pattern: Pattern, order: list[int], adjacency: Adjacency, candidates: list[set[int]], injection: bool):
        self.order, self.near, self.candidates, self.injection = order, adjacency.near, candidates, injection
        place = {u: i for i, u in enumerate(order)}
        self.labels = [pattern.labels[u] for u in order]
        self.before = [[place[v] for v in vs] for vs in backward(pattern, order).values()]
        self.ancestors: list[frozenset[int]] = []
        for i, before in enumerate(self.before):
            self.ancestors.append(frozenset([i]).union(*[self.ancestors[j] for j in before]))
        self.failing = injection

    def below(self, start: int) -> Iterator[list[int]]:
        yield from self._from([start], {start: 0})

    def _choices(self, path: list[int]) -> list[int]:
        i = len(path)
        sets = sorted((self.near.get((path[j], self.labels[i]), set()) for j in self.before[i]), key=len)
        found = set(self.candidates[self.order[i]])
        for s in sets:
            found &= s
            if not found:
                break
        return sorted(found)

    def _from(self, path: list[int], used: dict[int, int]) -> Iterator[list[int]]:
        """An explicit stack: per level the choices left, and the places that its failures depend on (None: all)."""
        n = len(self.order)
        if len(path) == n:
            yield list(path)
            return
        levels: list[list] = [[iter(self._choices(path)), set(self.ancestors[len(path)]), False]]  # choices, failing places, matched below
        base = len(path)
        while levels:
            choices, fails, matched = levels[-1]
            i = base + len(levels) - 1
            v = next(choices, None)
            if v is None:
                levels.pop()
                if not levels:
                    return
                self._leave(levels, fails, matched, path, used, i - 1)
                continue
            if self.injection and v in used:
                fails.update(self.ancestors[i] | self.ancestors[used[v]])
                continue
            path.append(v)
            if i + 1 == n:
                yield list(path)
                levels[-1][2] = True
                path.pop()
                continue
            used.setdefault(v, i)
            levels.append([iter(self._choices(path)), set(self.ancestors[i + 1]), False])

    def _leave(self, levels: list, fails: set, matched: bool, path: list[int], used: dict[int, int], i: int) -> None:
        """Back to place i, whose choice has been searched."""
        v = path.pop()
        if used.get(v) == i:
            del used[v]
        above = levels[-1]
        if matched:
            above[2] = True
        elif self.failing and i not in fails and not above[2]:
            above[0], above[1] = iter(()), set(fails)  # no other choice at i can mend it
        else:
            above[1].update(fails)


def match_local(spark: SparkSession, graph: PropertyGraph, pattern: Pattern, order: list[int], injection: bool, limit: int | None = None, table: pa.Table | None = None) -> DataFrame:
    """Rows u0..; the caller has checked that the relevant edges are few. A limit stops each partition early."""
    table = relevant(graph, pattern).select("src", "dst", "sl", "dl").toArrow() if table is None else table
    adjacency = Adjacency(table)
    candidates = adjacency.candidates(pattern, injection)
    shared = spark.sparkContext.broadcast((pattern, order, adjacency, candidates))
    names = [f"u{u}" for u in range(pattern.n)]
    roots = sorted(candidates[order[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, o, adj, cand = shared.value
        search = Search(p, o, adj, cand, injection)
        rows: list[list[int]] = []
        made = 0

        def batch():
            columns = list(zip(*rows))
            at = {u: i for i, u in enumerate(o)}
            return pa.RecordBatch.from_arrays([pa.array(columns[at[u]], pa.int64()) for u in range(p.n)], names=names)

        for b in batches:
            for root in b.column(0).to_pylist():
                for row in search.below(root):
                    rows.append(row)
                    made += 1
                    if len(rows) == 10_000:
                        yield batch()
                        rows = []
                    if limit is not None and made >= limit:
                        break
                if limit is not None and made >= limit:
                    break
            if limit is not None and made >= limit:
                break
        if rows:
            yield batch()

    parts = max(1, min(spark.sparkContext.defaultParallelism, len(roots) // 64))
    start = spark.createDataFrame(pa.table({"r": pa.array(roots, pa.int64())})).repartition(parts)
    return start.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
