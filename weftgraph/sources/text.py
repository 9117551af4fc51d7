"""Text formats: graphs (``t``, ``v``, ``e`` lines) and edge lists (``a b``, ``#`` comments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.pattern import Pattern


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph file; degrees are counted anew, loops and repeated edges dropped, lines may come in any order."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(part.alias("p"))
    v = lines.where(F.col("p")[0] == "v").select(F.col("p")[1].cast("bigint").alias("vid"), F.col("p")[2].cast("int").alias("label"))
    e = lines.where(F.col("p")[0] == "e").select(F.col("p")[1].cast("bigint").alias("src"), F.col("p")[2].cast("bigint").alias("dst"))
    return PropertyGraph.of(v, e)


def read_pattern(path: str) -> Pattern:
    """A pattern file on the driver's own disk; patterns have a few lines."""
    with open(path) as f:
        return Pattern.from_text(f.read())


def write_graph(graph: PropertyGraph, path: str) -> None:
    """Lines of the text format; vertices before edges, in number order. For graphs that a text file suits."""
    n, m = graph.vertices.count(), graph.edges.where("src < dst").count()
    head = graph.vertices.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(f"t {n} {m}").alias("value"))
    v = graph.degrees().join(graph.vertices, "vid").select(F.lit(1).alias("k"), F.col("vid").alias("a"), F.lit(0).cast("bigint").alias("b"), F.concat_ws(" ", F.lit("v"), "vid", "label", "degree").alias("value"))
    e = graph.edges.where("src < dst").select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    head.union(v).union(e).orderBy("k", "a", "b").select("value").write.text(path)


def clean_edges(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """src < dst of raw pairs: one direction, no loops, no repetitions."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src < dst of an edge list; comments and blank lines are skipped, a last line needs no end."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    part = F.split("line", r"\s+")
    return clean_edges(lines.select(part[0].cast("bigint").alias("a"), part[1].cast("bigint").alias("b")))
