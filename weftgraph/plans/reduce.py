"""Candidate sets and semi-join reduction of a pattern's relations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.operators.relations import label_degree_nlf, semi_join
from weftgraph.pattern import Pattern

Relations = dict[tuple[int, int], DataFrame]
Cut = Callable[[DataFrame], DataFrame]


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def scan(graph: PropertyGraph, pattern: Pattern) -> Relations:
    """The relation of each pattern edge (a, b): columns ua, ub."""
    return {(a, b): graph.relation(pattern.labels[a], pattern.labels[b]).toDF(f"u{a}", f"u{b}") for a, b in pattern.edges}


def nlf_filter(graph: PropertyGraph, pattern: Pattern, relations: Relations, cut: Cut = _as_it_is) -> Relations:
    """Every relation, less the vertices that fail label, degree or neighbour labels; for injective matches only.

    ``cut`` may write a vertex's candidates, which several relations need.
    """
    out = dict(relations)
    for u in range(pattern.n):
        if pattern.degree(u) < 2:
            continue  # the relation itself says as much
        good = cut(label_degree_nlf(graph, pattern, u).withColumnRenamed("vid", f"u{u}"))
        for e in [e for e in out if u in e]:
            out[e] = semi_join(out[e], good, f"u{u}")
    return out


def candidates(relations: Relations, u: int) -> DataFrame:
    """Values of u that are in all of its relations."""
    sides = [r.select(f"u{u}").distinct() for e, r in relations.items() if u in e]
    return reduce(lambda a, b: a.join(b, f"u{u}", "left_semi"), sides)


def star_reduce(relations: Relations, u: int, cut: Cut = _as_it_is) -> Relations:
    """The relations of u, reduced by one another on u: forwards, then backwards."""
    own = [e for e in relations if u in e]
    out = dict(relations)
    for a, b in [*zip(own, own[1:]), *zip(own[::-1], own[-2::-1])]:
        out[b] = cut(semi_join(out[b], out[a], f"u{u}"))
    return out


def semi_join_program(pattern: Pattern, relations: Relations, cut: Cut = _as_it_is) -> Relations:
    """Tree parts upwards, stars of the core in degeneracy order and back, tree parts downwards; a pure tree's root too.

    Each step's result goes through ``cut``, which may write it; else a cycle's last steps run all those before them
    again for each relation that they read.
    """
    order = pattern.degeneracy_order()
    place = {u: i for i, u in enumerate(order)}
    core = {u for u, k in enumerate(pattern.core_numbers()) if k > 1}
    key = lambda a, b: (min(a, b), max(a, b))
    # a tree vertex's parent is the neighbour that is peeled after it
    parent = {u: max(pattern.adjacent[u], key=place.__getitem__) for u in order if u not in core and any(place[v] > place[u] for v in pattern.adjacent[u])}
    out = dict(relations)
    for u in order:
        v = parent.get(u)
        if v is not None and v in parent:
            up = key(v, parent[v])
            out[up] = cut(semi_join(out[up], out[key(u, v)], f"u{v}"))
    for u in [*[u for u in order if u in core], *[u for u in order[::-1] if u in core]]:
        out = star_reduce(out, u, cut)
    for u in [u for u in order if u not in core and u not in parent]:
        out = star_reduce(out, u, cut)
    for u in order[::-1]:
        if u in parent:
            for w in [w for w, v in parent.items() if v == u]:
                out[key(u, w)] = cut(semi_join(out[key(u, w)], out[key(u, parent[u])], f"u{u}"))
    return out


def sizes(relations: Relations) -> dict[tuple[int, int], dict[str, int]]:
    """Rows, and distinct values of both ends, of all relations in one job."""
    parts = [r.agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(f"u{a}").alias("da"), F.approx_count_distinct(f"u{b}").alias("db")) for (a, b), r in relations.items()]
    if not parts:
        return {}
    return {(r.a, r.b): {"rows": r.n, "left": r.da, "right": r.db} for r in reduce(DataFrame.union, parts).collect()}


def sizes_of_scans(graph: PropertyGraph, pattern: Pattern, relations: Relations) -> dict[tuple[int, int], dict[str, int]]:
    """As ``sizes``, of relations as they are scanned: found out once for each pair of labels of a graph."""
    pair = {e: (pattern.labels[e[0]], pattern.labels[e[1]]) for e in relations}
    first = {p: e for e, p in pair.items() if p not in graph.sizes}
    found = sizes({e: relations[e] for e in first.values()})
    graph.sizes.update({pair[e]: s for e, s in found.items()})
    return {e: graph.sizes[p] for e, p in pair.items()}
