"""A labelled graph over star-schema tables: label is the table, edges are foreign keys."""

from __future__ import annotations

import copy
import threading
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import EDGE, PropertyGraph, load_edges, load_vertices, store_edges, store_vertices
from weftgraph.store import exists, shared_dir

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)
#: A vertex number is its label times this, plus its key.
STEP = 1_000_000_000
#: table, its key, label
_VERTICES = (
    ("region", "r_regionkey", REGION),
    ("nation", "n_nationkey", NATION),
    ("customer", "c_custkey", CUSTOMER),
    ("supplier", "s_suppkey", SUPPLIER),
    ("part", "p_partkey", PART),
    ("orders", "o_orderkey", ORDER),
)
#: table, key and label of one end, key and label of the other
_EDGES = (
    ("nation", "n_nationkey", NATION, "n_regionkey", REGION),
    ("customer", "c_custkey", CUSTOMER, "c_nationkey", NATION),
    ("supplier", "s_suppkey", SUPPLIER, "s_nationkey", NATION),
    ("orders", "o_orderkey", ORDER, "o_custkey", CUSTOMER),
    ("lineitem", "l_orderkey", ORDER, "l_partkey", PART),
    ("lineitem", "l_orderkey", ORDER, "l_suppkey", SUPPLIER),
    ("lineitem", "l_partkey", PART, "l_suppkey", SUPPLIER),
)
#: Keys of 32 bits; the others have 64.
_INTS = {"r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey"}


def _vid(key: str, label: int):
    return (F.lit(label * STEP) + F.col(key).cast("bigint")).cast("bigint")


def _tables(spark: SparkSession, sf_dir: str):
    keys: dict[str, set[str]] = {}
    for t, *columns in [(t, k) for t, k, _ in _VERTICES] + [(t, a, b) for t, a, _, b, _ in _EDGES]:
        keys.setdefault(t, set()).update(columns)
    # with the schema of the keys at hand, no job looks into the files before the query runs
    return {t: spark.read.schema(", ".join(f"{c} {'int' if c in _INTS else 'bigint'}" for c in sorted(cs))).parquet(f"{sf_dir}/{t}.parquet") for t, cs in keys.items()}


def _parts(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[tuple[DataFrame, int, int]]]:
    """The vertices of each table; src, dst of each kind of edge, once, with the labels of its ends."""
    tables = _tables(spark, sf_dir)
    vertices = [tables[t].select(_vid(k, x).alias("vid"), F.lit(x).alias("label")) for t, k, x in _VERTICES]
    edges = []
    for t, a, x, b, y in _EDGES:
        pairs = tables[t].where(F.col(a).isNotNull() & F.col(b).isNotNull())
        edges.append((pairs.select(_vid(a, x).alias("src"), _vid(b, y).alias("dst")).distinct(), x, y))
    return vertices, edges


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables in a folder.

    Each kind of edge is a branch of a union with literal labels, so that the scan of a relation is
    pruned to its own table and two columns.
    """
    vertices, once = _parts(spark, sf_dir)
    edges: list[DataFrame] = []
    for pairs, x, y in once:
        edges.append(pairs.select("src", "dst", F.lit(x).alias("sl"), F.lit(y).alias("dl")))
        edges.append(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(y).alias("sl"), F.lit(x).alias("dl")))
    return PropertyGraph(reduce(DataFrame.union, vertices), reduce(DataFrame.union, edges))


class StoredGraph(PropertyGraph):
    """The graph of the tables, of which a relation is written to a folder when it is first read, and the vertices too."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        self._spark, self._sf_dir, self.path = spark, sf_dir, path
        self.sizes: dict[tuple[int, int], dict[str, int]] = {}
        #: Pairs of labels that are written, each in the direction of ``_EDGES``; with ``None``, the vertices are.
        self._written: set[tuple[int, int] | None] = set()
        self._lock = threading.RLock()

    def seen_from(self, spark: SparkSession) -> StoredGraph:
        """The same graph for another session of the application."""
        out = copy.copy(self)
        out._spark = spark
        return out

    def is_there(self) -> bool:
        """Whether the folders that were written still are."""
        folders = (["vertices"] if None in self._written else []) + (["edges"] if self._written - {None} else [])
        return all(exists(self._spark, f"{self.path}/{x}") for x in folders)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def vertices(self) -> DataFrame:
        with self._lock:
            if None not in self._written:
                store_vertices(reduce(DataFrame.union, _parts(self._spark, self._sf_dir)[0]), self.path)
                self._written.add(None)
        return load_vertices(self._spark, self.path)

    @property
    def edges(self) -> DataFrame:
        self._write({(x, y) for _, _, x, _, y in _EDGES})
        return load_edges(self._spark, self.path)

    def between(self, pairs: Iterable[tuple[int, int]]) -> DataFrame:
        pairs = list(pairs)
        known = {(x, y) for _, _, x, _, y in _EDGES if (x, y) in pairs or (y, x) in pairs}
        self._write(known)
        edges = load_edges(self._spark, self.path) if known else self._spark.createDataFrame([], EDGE)
        return PropertyGraph(None, edges).between(pairs)

    def _write(self, pairs: set[tuple[int, int]]) -> None:
        with self._lock:
            missing = pairs - self._written
            if missing:
                parts = [e for e in _parts(self._spark, self._sf_dir)[1] if e[1:] in missing]
                # a task has edges of one pair of labels, as they come from the distinct of their kind
                store_edges(reduce(DataFrame.union, [e.select("src", "dst", F.lit(x).alias("sl"), F.lit(y).alias("dl")) for e, x, y in parts]), self.path)
                self._written |= missing


#: Folders of stored graphs, by Spark application and folder of tables, and the graphs by their folder.
_stored: dict[tuple[str, str], str] = {}
_graphs: dict[str, StoredGraph] = {}


def lazy_graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """The graph of the tables in a folder; what is read of it is written to the shared folder once in a Spark application and read from there.

    Relations are read as they are stored, distinct and by pair of labels, in place of a distinct over lineitem in every query.
    Those that no query reads take no disk. Tables that change while the application runs are not read again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not _graphs[_stored[key]].seen_from(spark).is_there():
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        _stored[key], _graphs[path] = path, StoredGraph(spark, sf_dir, path)
    return _graphs[_stored[key]].seen_from(spark)


def stored_graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """As ``lazy_graph``, with all of the graph written."""
    graph = lazy_graph(spark, sf_dir)
    assert graph.edges is not None and graph.vertices is not None
    return graph
