"""Data preparation: new labels and samples of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph, both_ways

_M, _A, _B, _C = 1_000_003, 7_919, 104_729, 1_000_003


def relabel_hash(vertices: DataFrame, labels: int) -> DataFrame:
    """vid, label: a label of 0 to labels - 1 from the vertex number, by arithmetic that any engine repeats."""
    return vertices.select("vid", (((F.col("vid") % _M) * _A + _B) % _C % labels).cast("int").alias("label"))


def random_labels(vertices: DataFrame, labels: int, seed: int) -> DataFrame:
    """vid, label: uniform, and the same for the same seed however the table is partitioned."""
    return vertices.select("vid", F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(labels)).cast("int").alias("label"))


def relabelled(graph: PropertyGraph, labels: DataFrame) -> PropertyGraph:
    """The graph with other labels (vid, label)."""
    return PropertyGraph.of(labels, graph.edges.where("src < dst").select("src", "dst"))


def sample_edges_hash(edges: DataFrame, per_mille: int) -> DataFrame:
    """src < dst of about so many of a thousand edges, by arithmetic that any engine repeats."""
    h = ((F.col("src") % _M) * _A + (F.col("dst") % _M) * _B) % _C
    return edges.where("src < dst").where(h % 1000 < per_mille).select("src", "dst")


def sample_edges(graph: PropertyGraph, share: float, seed: int) -> PropertyGraph:
    """The graph with each undirected edge kept with a probability; the vertices stay."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "src", "dst"), 11) / F.lit(float(1 << 53))
    return PropertyGraph(graph.vertices, both_ways(graph.edges.where("src < dst").where(u < share)))
