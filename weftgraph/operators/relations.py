"""Primitives over edge relations: projection, filters, semi-joins, hash joins, intersections, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.pattern import Pattern


def project(relation: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column; order is for sinks."""
    return relation.select(column).distinct()


def semi_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key is in right."""
    return left.join(right.select(on), on, "left_semi").select(*left.columns)


def key_count(relation: DataFrame, column: str) -> DataFrame:
    """One row: the number of distinct keys."""
    return relation.agg(F.countDistinct(column).alias("keys"))


def hash_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Inner equi-join on any number of keys: left's columns, then right's without its keys.

    Columns are matched by place, so the sides may share names. Spark broadcasts a side only if its
    size is known to be small.
    """
    rest = [c for c in right.columns if c not in right_keys]
    r = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(right_keys)], *[F.col(c).alias(f"__r{i}") for i, c in enumerate(rest)])
    on = [left[a] == F.col(f"__k{i}") for i, a in enumerate(left_keys)]
    names = [c if c not in left.columns else f"{c}_right" for c in rest]
    return left.join(r, on).select(*[left[c] for c in left.columns], *[F.col(f"__r{i}").alias(n) for i, n in enumerate(names)])


def label_degree_nlf(graph: PropertyGraph, pattern: Pattern, u: int) -> DataFrame:
    """vid of the data vertices that u may map to: same label, degree, and each neighbour label often enough.

    Conditional sums over the edges of the label, in one aggregation.
    """
    if not pattern.adjacent[u]:
        return graph.with_label(pattern.labels[u])
    need = pattern.nlf(u)
    counts = [F.sum(F.when(F.col("dl") == label, 1).otherwise(0)).alias(f"n{label}") for label in sorted(need)]
    enough = F.lit(True)
    for label, k in sorted(need.items()):
        enough = enough & (F.col(f"n{label}") >= k)
    e = graph.between([(pattern.labels[u], x) for x in sorted(need)])
    return e.groupBy(F.col("src").alias("vid")).agg(*counts).where(enough).select("vid")


def degree_filter(graph: PropertyGraph, label: int, least: int) -> DataFrame:
    """vid, degree of the vertices of a label with at least so many neighbours."""
    d = graph.edges.where(F.col("sl") == label).groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    return d.where(F.col("degree") >= least)


def as_lists(relation: DataFrame, key: str, value: str) -> DataFrame:
    """key, nbrs (sorted), degree: the layout of hash and trie relations."""
    return relation.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("nbrs"), F.count(F.lit(1)).alias("degree"))


def encoded(relation: DataFrame, key: str, value: str, keys: DataFrame, values: DataFrame) -> DataFrame:
    """As ``as_lists``, less what isn't in the candidate sets (vid) of both ends."""
    kept = semi_join(relation, keys.select(F.col("vid").alias(key)), key)
    return as_lists(semi_join(kept, values.select(F.col("vid").alias(value)), value), key, value)


def as_bitmaps(relation: DataFrame, key: str, value: str) -> DataFrame:
    """key, base, state: the neighbours of a key as 64-bit bitmaps by base (vid div 64)."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({value}, 64) AS INT))")
    return relation.groupBy(key, F.floor(F.col(value) / 64).alias("base")).agg(F.bit_or(bit).alias("state"))


def from_bitmaps(bitmaps: DataFrame, key: str, value: str) -> DataFrame:
    """The relation of its bitmaps."""
    places = F.expr("filter(sequence(0, 63), i -> getbit(state, i) = 1)")
    return bitmaps.select(key, "base", F.explode(places).alias("i")).select(key, (F.col("base") * 64 + F.col("i")).alias(value))


def intersect_bitmaps(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, base, state: common neighbours of each pair as bitmaps, by bitmaps (x, base, state) and (y, base, state)."""
    left = a.select("x", "base", F.col("state").alias("__a"))
    right = b.select("y", "base", F.col("state").alias("__b"))
    state = F.col("__a").bitwiseAND(F.col("__b"))
    return pairs.join(left, "x").join(right, ["y", "base"]).select("x", "y", "base", state.alias("state")).where("state != 0")


def intersect_neighbours(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """x, y, common: sorted common neighbours of each pair, by sorted lists (x, nbrs) and (y, nbrs)."""
    left, right = a.select("x", F.col("nbrs").alias("__a")), b.select("y", F.col("nbrs").alias("__b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", F.array_sort(F.array_intersect("__a", "__b")).alias("common"))
