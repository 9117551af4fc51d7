"""Data graphs: vertices and edges as DataFrames, and the statistics that plans need."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = "src bigint, dst bigint, sl int, dl int"


class PropertyGraph:
    """An undirected graph with a label on each vertex.

    ``vertices``: vid, label. ``edges``: src, dst, sl, dl: every edge in both directions, once, no
    loops, with its ends' labels beside it, so that the relation of a query edge is a filter that
    the scan takes. Vertex numbers are any 64-bit numbers.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges
        #: By pair of labels, what ``plans.reduce.sizes`` found out about its relation.
        self.sizes: dict[tuple[int, int], dict[str, int]] = {}

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From vid, label and src, dst: made symmetric, loops and repetitions dropped, labels joined.

        Edges whose ends are not among the vertices are dropped; of repeated vertices the smallest label counts.
        """
        v = vertices.groupBy(F.col("vid").cast("bigint").alias("vid")).agg(F.min(F.col("label").cast("int")).alias("label"))
        low, high = F.least("src", "dst").cast("bigint"), F.greatest("src", "dst").cast("bigint")
        once = edges.where("src <> dst").select(low.alias("src"), high.alias("dst")).distinct()
        a, b = v.select(F.col("vid").alias("src"), F.col("label").alias("sl")), v.select(F.col("vid").alias("dst"), F.col("label").alias("dl"))
        return cls(v, both_ways(once.join(a, "src").join(b, "dst").select("src", "dst", "sl", "dl")))

    @classmethod
    def of_labelled(cls, edges: DataFrame) -> PropertyGraph:
        """From src, sl, dst, dl, each undirected edge once or more, in any direction; vertices are the edges' ends."""
        once = edges.where("src <> dst").select(
            F.least("src", "dst").alias("src"),
            F.greatest("src", "dst").alias("dst"),
            F.when(F.col("src") < F.col("dst"), F.col("sl")).otherwise(F.col("dl")).alias("sl"),
            F.when(F.col("src") < F.col("dst"), F.col("dl")).otherwise(F.col("sl")).alias("dl"),
        )
        both = both_ways(once.distinct())
        return cls(both.select(F.col("src").alias("vid"), F.col("sl").alias("label")).distinct(), both)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    # -- scans -------------------------------------------------------------------------------------
    def between(self, pairs: Iterable[tuple[int, int]]) -> DataFrame:
        """The edges between the pairs of labels (source, target)."""
        keep = F.lit(False)
        for a, b in pairs:
            keep = keep | ((F.col("sl") == a) & (F.col("dl") == b))
        return self.edges.where(keep)

    def relation(self, source_label: int, target_label: int) -> DataFrame:
        """src, dst of all edges between two labels; empty if there are none."""
        return self.between([(source_label, target_label)]).select("src", "dst")

    def with_label(self, label: int) -> DataFrame:
        return self.vertices.where(F.col("label") == label).select("vid")

    def neighbours(self, label: int | None = None) -> DataFrame:
        """vid, nbrs: each vertex's sorted neighbours, of one label if it is given."""
        e = self.edges if label is None else self.edges.where(F.col("dl") == label)
        return e.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))

    def has_edges(self, pairs: DataFrame, label: int | None = None) -> DataFrame:
        """The pairs (src, dst) that are edges; to vertices of one label if it is given."""
        e = self.edges if label is None else self.edges.where(F.col("dl") == label)
        return pairs.join(e.select("src", "dst"), ["src", "dst"], "left_semi")

    def edges_between(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """src, dst of the edges from one candidate set (vid) to another."""
        e = self.edges.select("src", "dst")
        return e.join(sources.select(F.col("vid").alias("src")), "src", "left_semi").join(targets.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst")

    # -- statistics --------------------------------------------------------------------------------
    def degrees(self) -> DataFrame:
        """vid, degree; vertices without edges have 0."""
        d = self.edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("vid").join(d, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))

    def label_frequency(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("frequency"))

    def nlf(self) -> DataFrame:
        """vid, nbr_label, cnt: how many neighbours of each label a vertex has."""
        return self.edges.groupBy(F.col("src").alias("vid"), F.col("dl").alias("nbr_label")).agg(F.count(F.lit(1)).alias("cnt"))

    def label_pair_cardinality(self) -> DataFrame:
        return self.edges.groupBy("sl", "dl").agg(F.count(F.lit(1)).alias("cardinality"))

    def max_degrees(self) -> DataFrame:
        """sl, dl, max_degree: the largest number of neighbours with label dl that a vertex with label sl has."""
        per = self.edges.groupBy("sl", "dl", "src").agg(F.count(F.lit(1)).alias("d"))
        return per.groupBy("sl", "dl").agg(F.max("d").alias("max_degree"))

    def metadata(self) -> DataFrame:
        """One row: n_vertices, n_edges, n_labels, max_degree, max_label_frequency."""
        v = self.vertices.agg(F.count(F.lit(1)).alias("n_vertices"), F.countDistinct("label").alias("n_labels"))
        e = self.edges.agg(F.count(F.lit(1)).alias("n"))
        d = self.degrees().agg(F.max("degree").alias("max_degree"))
        f = self.label_frequency().agg(F.max("frequency").alias("max_label_frequency"))
        # four tables of one row each
        out = v.join(e, F.lit(True)).join(d, F.lit(True)).join(f, F.lit(True))
        return out.select("n_vertices", F.floor(F.col("n") / 2).cast("bigint").alias("n_edges"), "n_labels", "max_degree", "max_label_frequency")

    def triangles_per_edge(self) -> DataFrame:
        """a, b (a < b), triangles: of edges that are in a triangle.

        Edges point from the end of lower degree, so that a hub's neighbours are not paired.
        """
        d = self.degrees()
        e = self.edges.where("src < dst").select("src", "dst")
        e = e.join(d.select(F.col("vid").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("vid").alias("dst"), F.col("degree").alias("dd")), "dst")
        forward = F.struct("ds", "src") < F.struct("dd", "dst")
        e = e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("y"))
        xy, xz = e, e.select("x", F.col("y").alias("z"))
        wedge = xy.join(xz, "x").where("y < z")
        closed = e.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
        triangle = wedge.join(closed, ["y", "z"], "left_semi")
        sides = triangle.select(F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("x", "y"), ("x", "z"), ("y", "z"))])).alias("s"))
        return sides.groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("triangles"))

    def k_core(self, k: int) -> DataFrame:
        """vid of the k-core: vertices of degree under k are peeled until none is left.

        Each round keeps the edges whose ends both have enough of them; every few rounds the edges
        are written.
        """
        from weftgraph.store import written

        e, count, rounds = self.edges.select("src", "dst"), -1, 0
        while True:
            enough = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select("src")
            e = e.join(enough, "src", "left_semi").join(enough.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
            rounds += 1
            e = written(e, "core")
            now = e.count()
            if now == count:
                break
            count = now
        found = e.select(F.col("src").alias("vid")).distinct()
        return found if k > 0 else self.vertices.select("vid")

    def core_numbers(self) -> DataFrame:
        """vid, core: the largest k whose core holds the vertex."""
        out, k = self.vertices.select("vid", F.lit(0).alias("core")), 1
        rest = self
        while True:
            found = rest.k_core(k)
            if found.isEmpty():
                return out
            out = out.join(found.select("vid", F.lit(k).alias("k")), "vid", "left").select("vid", F.coalesce("k", "core").alias("core"))
            ids = found.select("vid")
            inside = rest.edges.join(ids.select(F.col("vid").alias("src")), "src", "left_semi").join(ids.select(F.col("vid").alias("dst")), "dst", "left_semi")
            rest, k = PropertyGraph(found, inside), k + 1

    # -- at rest -----------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        """Parquet; edges in a folder for each pair of labels, so that a relation reads its folder only, and in one direction.

        The rows of a pair of labels go together, and those of a large one are split among files of about even size.
        """
        store(self.vertices, self.edges.where("src < dst").hint("rebalance", "sl", "dl"), path)

    @classmethod
    def load(cls, spark, path: str) -> PropertyGraph:
        return cls(load_vertices(spark, path), load_edges(spark, path))


def load_vertices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vid long, label int").parquet(f"{path}/vertices")


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """The stored edges in both directions."""
    once = spark.read.schema(EDGE).parquet(f"{path}/edges").select("src", "dst", "sl", "dl")
    # two scans, and of a relation the one that its folder isn't for reads nothing
    back = once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dl").alias("sl"), F.col("sl").alias("dl"))
    return once.union(back)


def store_vertices(vertices: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def store_edges(once: DataFrame, path: str) -> None:
    """once: each edge in one direction. Folders of other pairs of labels stay; what a broken attempt left of the same ones goes."""
    from weftgraph.store import shuffles_dropped

    with shuffles_dropped(once.sparkSession):
        once.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("sl", "dl").parquet(f"{path}/edges")


def store(vertices: DataFrame, once: DataFrame, path: str) -> None:
    """The files that ``PropertyGraph.load`` reads; a folder that has some already is an error."""
    from weftgraph.store import exists

    if any(exists(once.sparkSession, f"{path}/{part}") for part in ("vertices", "edges")):
        raise FileExistsError(path)
    store_vertices(vertices, path)
    store_edges(once, path)


def both_ways(once: DataFrame) -> DataFrame:
    """Each edge in both directions, by one pass over the input."""
    there = F.struct("src", "dst", "sl", "dl")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dl").alias("sl"), F.col("sl").alias("dl"))
    return once.select(F.explode(F.array(there, back)).alias("e")).select("e.*")
