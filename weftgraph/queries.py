"""Registered subgraph queries over the star-schema graph, and their SQL.

Each takes (spark, sf_dir). The SQL builds the same graph: ``v`` (vid, label), ``e0`` (each edge once),
``e`` (both directions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import engine
from weftgraph.functions import prep
from weftgraph.graph import PropertyGraph
from weftgraph.operators import relations as ops
from weftgraph.pattern import Pattern
from weftgraph.plans import extend as steps
from weftgraph.plans.nucleus import density_tree, describe
from weftgraph.plans.orders import nd_orders, spectrum, constrained_order, utility
from weftgraph.plans.reduce import candidates, nlf_filter, scan, semi_join_program
from weftgraph.plans.tree import Plan
from weftgraph.sources.tables import CUSTOMER, NATION, ORDER, PART, SUPPLIER, lazy_graph
from weftgraph.sources.text import clean_edges
from weftgraph.store import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_V = """v AS (
  SELECT CAST(r_regionkey AS BIGINT) AS vid, 0 AS label FROM region
  UNION ALL SELECT 1000000000 + CAST(n_nationkey AS BIGINT), 1 FROM nation
  UNION ALL SELECT 2000000000 + CAST(c_custkey AS BIGINT), 2 FROM customer
  UNION ALL SELECT 3000000000 + CAST(s_suppkey AS BIGINT), 3 FROM supplier
  UNION ALL SELECT 4000000000 + CAST(p_partkey AS BIGINT), 4 FROM part
  UNION ALL SELECT 5000000000 + CAST(o_orderkey AS BIGINT), 5 FROM orders)"""
_E0 = """e0 AS (SELECT DISTINCT src, sl, dst, dl FROM (
  SELECT 1000000000 + CAST(n_nationkey AS BIGINT) AS src, 1 AS sl, CAST(n_regionkey AS BIGINT) AS dst, 0 AS dl FROM nation
  UNION ALL SELECT 2000000000 + CAST(c_custkey AS BIGINT), 2, 1000000000 + CAST(c_nationkey AS BIGINT), 1 FROM customer
  UNION ALL SELECT 3000000000 + CAST(s_suppkey AS BIGINT), 3, 1000000000 + CAST(s_nationkey AS BIGINT), 1 FROM supplier
  UNION ALL SELECT 5000000000 + CAST(o_orderkey AS BIGINT), 5, 2000000000 + CAST(o_custkey AS BIGINT), 2 FROM orders
  UNION ALL SELECT 5000000000 + CAST(l_orderkey AS BIGINT), 5, 4000000000 + CAST(l_partkey AS BIGINT), 4 FROM lineitem
  UNION ALL SELECT 5000000000 + CAST(l_orderkey AS BIGINT), 5, 3000000000 + CAST(l_suppkey AS BIGINT), 3 FROM lineitem
  UNION ALL SELECT 4000000000 + CAST(l_partkey AS BIGINT), 4, 3000000000 + CAST(l_suppkey AS BIGINT), 3 FROM lineitem) t)"""
_E = """e AS (SELECT src, sl, dst, dl FROM e0 UNION ALL SELECT dst, dl, src, sl FROM e0)"""
_WITH = f"WITH {_V}, {_E0}, {_E} "


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers a query of (graph, spark, sf_dir); sql is prefixed with the graph's tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lazy_graph(spark, sf_dir) if graph else sf_dir, spark)
        if sql is not None:
            ORACLES[name] = (_WITH if graph else "") + sql
        return f

    return add


def pattern_sql(pattern: Pattern, iso: bool, select: str) -> str:
    """SQL of a pattern's matches as a join of one e for each pattern edge; u0.. are the matches."""
    tables, where, at = [], [], {}
    for i, (a, b) in enumerate(pattern.edges):
        tables.append(f"e r{i}")
        where.append(f"r{i}.sl = {pattern.labels[a]} AND r{i}.dl = {pattern.labels[b]}")
        for u, c in ((a, "src"), (b, "dst")):
            if u in at:
                where.append(f"{at[u]} = r{i}.{c}")
            else:
                at[u] = f"r{i}.{c}"
    if iso:
        where += [f"{at[u]} <> {at[w]}" for u in at for w in at if u < w and pattern.labels[u] == pattern.labels[w]]
    cols = ", ".join(f"{at[u]} AS u{u}" for u in sorted(at))
    return f"SELECT {select} FROM (SELECT {cols} FROM {', '.join(tables)} WHERE {' AND '.join(where)}) m"


PATTERNS = {
    "path3": Pattern([CUSTOMER, ORDER, PART], [(0, 1), (1, 2)]),
    "star3": Pattern([ORDER, CUSTOMER, PART, SUPPLIER], [(0, 1), (0, 2), (0, 3)]),
    "wedge": Pattern([ORDER, CUSTOMER, ORDER], [(0, 1), (1, 2)]),
    "triangle": Pattern([ORDER, PART, SUPPLIER], [(0, 1), (0, 2), (1, 2)]),
    "cycle4": Pattern([CUSTOMER, ORDER, SUPPLIER, NATION], [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "butterfly": Pattern([ORDER, PART, ORDER, PART], [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "triangle_tail": Pattern([ORDER, PART, SUPPLIER, CUSTOMER], [(0, 1), (0, 2), (1, 2), (0, 3)]),
    "edge": Pattern([NATION, 0], [(0, 1)]),
    # order, part and supplier in a triangle, with the customer and the nation that close a second cycle
    "house": Pattern([ORDER, PART, SUPPLIER, CUSTOMER, NATION], [(0, 1), (0, 2), (1, 2), (0, 3), (3, 4), (2, 4)]),
}
_ALL = "*"
_COUNT = "CAST(count(*) AS BIGINT) AS embeddings"


def _matches(name: str, pattern: str, mode: str, **options) -> None:
    p = PATTERNS[pattern]
    query(name, pattern_sql(p, mode == "iso", _ALL))(lambda g, spark: engine.match(g, p, mode, **options))


def _counts(name: str, pattern: str, mode: str, **options) -> None:
    p = PATTERNS[pattern]
    query(name, pattern_sql(p, mode == "iso", _COUNT))(lambda g, spark: engine.count(g, p, mode, **options))


# -- sources and scans -----------------------------------------------------------------------------
query("graph_vertices", "SELECT vid, label FROM v")(lambda g, spark: g.vertices)
query("graph_edges", "SELECT src, dst, sl, dl FROM e")(lambda g, spark: g.edges)
query("label_scan", "SELECT vid FROM v WHERE label = 3")(lambda g, spark: g.with_label(SUPPLIER))
query("edge_scan_label_pair", "SELECT src, dst FROM e WHERE sl = 5 AND dl = 4")(lambda g, spark: g.relation(ORDER, PART))
query("edge_scan_no_index", "SELECT src, dst FROM e WHERE src IN (SELECT vid FROM v WHERE label = 3) AND dst IN (SELECT vid FROM v WHERE label = 1)")(
    lambda g, spark: g.edges_between(g.with_label(SUPPLIER), g.with_label(NATION))
)
query("neighbors", "SELECT src AS vid, count(*) AS degree, min(dst) AS first, max(dst) AS last FROM e GROUP BY src")(
    lambda g, spark: g.neighbours().select("vid", F.size("nbrs").cast("bigint").alias("degree"), F.element_at("nbrs", 1).alias("first"), F.element_at("nbrs", -1).alias("last"))
)
query("neighbors_by_label", "SELECT src AS vid, count(*) AS degree, min(dst) AS first, max(dst) AS last FROM e WHERE dl = 4 GROUP BY src")(
    lambda g, spark: g.neighbours(PART).select("vid", F.size("nbrs").cast("bigint").alias("degree"), F.element_at("nbrs", 1).alias("first"), F.element_at("nbrs", -1).alias("last"))
)


@query("edge_scan_candidates", "SELECT src, dst FROM e WHERE sl = 5 AND dl = 3 AND src IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 8) AND dst IN (SELECT src FROM e GROUP BY src HAVING count(*) >= 8)")
def _(g: PropertyGraph, spark):
    busy = g.degrees().where("degree >= 8")
    return g.edges_between(ops.semi_join(g.with_label(ORDER), busy, "vid"), ops.semi_join(g.with_label(SUPPLIER), busy, "vid"))


@query("edge_exists", "SELECT DISTINCT p.src, p.dst FROM (SELECT 2000000000 + k AS src, 1000000000 + k % 25 AS dst FROM (SELECT c_custkey AS k FROM customer) t) p JOIN e ON e.src = p.src AND e.dst = p.dst")
def _(g: PropertyGraph, spark):
    pairs = g.with_label(CUSTOMER).select(F.col("vid").alias("src"), (F.lit(1_000_000_000) + (F.col("vid") - 2_000_000_000) % 25).alias("dst"))
    return g.has_edges(pairs)


@query("edge_list_clean", "SELECT DISTINCT least(l_orderkey, l_partkey) AS src, greatest(l_orderkey, l_partkey) AS dst FROM lineitem WHERE l_orderkey <> l_partkey", graph=False)
def _(sf_dir: str, spark):
    return clean_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")))


# -- filters ---------------------------------------------------------------------------------------
query("project_distinct", "SELECT DISTINCT dst FROM e WHERE sl = 5 AND dl = 3")(lambda g, spark: ops.project(g.relation(ORDER, SUPPLIER), "dst"))
query("degree_filter", "SELECT src AS vid, count(*) AS degree FROM e WHERE sl = 5 GROUP BY src HAVING count(*) >= 6")(lambda g, spark: ops.degree_filter(g, ORDER, 6))
query("nlf_profile", "SELECT src AS vid, dl AS nbr_label, count(*) AS cnt FROM e GROUP BY src, dl")(lambda g, spark: g.nlf())

_BUTTERFLY_NLF = "SELECT src AS vid FROM e WHERE sl = 5 GROUP BY src HAVING sum(CASE WHEN dl = 4 THEN 1 ELSE 0 END) >= 2"
query("nlf_filter", _BUTTERFLY_NLF)(lambda g, spark: ops.label_degree_nlf(g, PATTERNS["butterfly"], 0))


@query("nlf_filter_relation", f"SELECT src AS u0, dst AS u1 FROM e WHERE sl = 5 AND dl = 4 AND src IN ({_BUTTERFLY_NLF}) AND dst IN (SELECT src FROM e WHERE sl = 4 GROUP BY src HAVING sum(CASE WHEN dl = 5 THEN 1 ELSE 0 END) >= 2)")
def _(g: PropertyGraph, spark):
    p = PATTERNS["butterfly"]
    return nlf_filter(g, p, scan(g, p))[0, 1]


@query("candidates", "SELECT src AS u2 FROM e WHERE sl = 3 AND dl = 5 INTERSECT SELECT src FROM e WHERE sl = 3 AND dl = 1")
def _(g: PropertyGraph, spark):
    return candidates(scan(g, PATTERNS["cycle4"]), 2)


# -- joins -----------------------------------------------------------------------------------------
@query("semi_join", "SELECT src AS o, dst AS p FROM e WHERE sl = 5 AND dl = 4 AND dst IN (SELECT src FROM e WHERE sl = 4 AND dl = 3 AND dst % 2 = 0)")
def _(g: PropertyGraph, spark):
    right = g.relation(PART, SUPPLIER).where("dst % 2 = 0").toDF("p", "s")
    return ops.semi_join(g.relation(ORDER, PART).toDF("o", "p"), right, "p")


query("key_count", "SELECT count(DISTINCT dst) AS keys FROM e WHERE sl = 5 AND dl = 3")(lambda g, spark: ops.key_count(g.relation(ORDER, SUPPLIER), "dst"))


@query(
    "semi_join_reduce_path",
    """SELECT src AS u0, dst AS u1 FROM e WHERE sl = 2 AND dl = 5 AND dst IN (SELECT src FROM e WHERE sl = 5 AND dl = 4)""",
)
def _(g: PropertyGraph, spark):
    p = PATTERNS["path3"]
    return semi_join_program(p, scan(g, p))[0, 1]


@query("hash_join_1key", "SELECT a.src AS o, a.dst AS p, b.dst AS s FROM e a JOIN e b ON a.dst = b.src WHERE a.sl = 5 AND a.dl = 4 AND b.sl = 4 AND b.dl = 3")
def _(g: PropertyGraph, spark):
    return ops.hash_join(g.relation(ORDER, PART).toDF("o", "p"), g.relation(PART, SUPPLIER).toDF("p2", "s"), ["p"], ["p2"])


@query("hash_join_2key", "SELECT a.src AS o, a.dst AS p, c.dst AS s FROM e a JOIN e b ON a.src = b.src JOIN e c ON c.src = a.dst AND c.dst = b.dst WHERE a.sl = 5 AND a.dl = 4 AND b.sl = 5 AND b.dl = 3 AND c.sl = 4 AND c.dl = 3")
def _(g: PropertyGraph, spark):
    left = ops.hash_join(g.relation(ORDER, PART).toDF("o", "p"), g.relation(ORDER, SUPPLIER).toDF("o2", "s"), ["o"], ["o2"])
    return ops.hash_join(left, g.relation(PART, SUPPLIER).toDF("a", "b"), ["p", "s"], ["a", "b"])


# the sides share the order, which has one customer and nation; the supplier's nation closes the second cycle
@query("bushy_join", pattern_sql(PATTERNS["house"], True, _ALL))
def _(g: PropertyGraph, spark):
    return engine.run_plan(g, PATTERNS["house"], Plan.bushy([0, 1, 2], [0, 3, 4]))


@query("intersect_common_neighbors", "SELECT a.src AS x, a.dst AS y, count(*) AS n FROM e a JOIN e b ON b.src = a.src AND b.dl = 3 JOIN e c ON c.src = a.dst AND c.dst = b.dst WHERE a.sl = 5 AND a.dl = 4 GROUP BY a.src, a.dst")
def _(g: PropertyGraph, spark):
    pairs = g.relation(ORDER, PART).toDF("x", "y")
    a = ops.as_lists(g.relation(ORDER, SUPPLIER), "src", "dst").withColumnRenamed("src", "x")
    b = ops.as_lists(g.relation(PART, SUPPLIER), "src", "dst").withColumnRenamed("src", "y")
    return ops.intersect_neighbours(pairs, a, b).where(F.size("common") > 0).select("x", "y", F.size("common").cast("bigint").alias("n"))


@query("intersection_cache", pattern_sql(PATTERNS["triangle_tail"], True, _ALL))
def _(g: PropertyGraph, spark):
    p = PATTERNS["triangle_tail"]
    r = scan(g, p)
    pair = steps.extend(p, r, [0, 1], True)
    with_supplier = steps.cached_intersections(pair, r, 2, [0, 1])
    return steps.extend(p, r, [0, 1, 2, 3], True, prefix=with_supplier).select("u0", "u1", "u2", "u3")


# -- layouts ---------------------------------------------------------------------------------------
@query("relation_lists", "SELECT src AS p, count(*) AS degree, CAST(sum(dst) AS BIGINT) AS total FROM e WHERE sl = 4 AND dl = 3 GROUP BY src")
def _(g: PropertyGraph, spark):
    lists = ops.as_lists(g.relation(PART, SUPPLIER).toDF("p", "s"), "p", "s")
    return lists.select("p", "degree", F.aggregate("nbrs", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("relation_encoded", "SELECT src AS p, count(*) AS degree FROM e WHERE sl = 4 AND dl = 3 AND src IN (SELECT dst FROM e WHERE sl = 5 AND dl = 4) AND dst IN (SELECT src FROM e WHERE sl = 3 AND dl = 1 AND dst % 2 = 0) GROUP BY src")
def _(g: PropertyGraph, spark):
    keys = ops.project(g.relation(ORDER, PART), "dst").withColumnRenamed("dst", "vid")
    values = ops.project(g.relation(SUPPLIER, NATION).where("dst % 2 = 0"), "src").withColumnRenamed("src", "vid")
    return ops.encoded(g.relation(PART, SUPPLIER).toDF("p", "s"), "p", "s", keys, values).select("p", "degree")


@query("relation_bitmaps", "SELECT src AS p, dst AS s FROM e WHERE sl = 4 AND dl = 3")
def _(g: PropertyGraph, spark):
    return ops.from_bitmaps(ops.as_bitmaps(g.relation(PART, SUPPLIER).toDF("p", "s"), "p", "s"), "p", "s")


@query("intersect_bitmaps", "SELECT a.src AS o, count(*) AS common FROM e a JOIN e b ON b.src = a.src AND b.sl = 5 AND b.dl = 3 JOIN e c ON c.src = a.dst AND c.dst = b.dst AND c.sl = 4 AND c.dl = 3 WHERE a.sl = 5 AND a.dl = 4 GROUP BY a.src")
def _(g: PropertyGraph, spark):
    of_orders = ops.as_bitmaps(g.relation(ORDER, SUPPLIER).toDF("x", "s"), "x", "s")
    of_parts = ops.as_bitmaps(g.relation(PART, SUPPLIER).toDF("y", "s"), "y", "s")
    both = ops.intersect_bitmaps(g.relation(ORDER, PART).toDF("x", "y"), of_orders, of_parts)
    return both.groupBy(F.col("x").alias("o")).agg(F.sum(F.bit_count("state")).cast("bigint").alias("common"))


@query("edge_exists_label", "SELECT src, dst FROM e WHERE sl = 5 AND dl = 4 AND dst % 2 = 0")
def _(g: PropertyGraph, spark):
    pairs = g.relation(ORDER, PART).toDF("src", "dst").union(g.relation(ORDER, SUPPLIER).toDF("src", "dst")).where("dst % 2 = 0")
    return g.has_edges(pairs, PART)


# -- matching --------------------------------------------------------------------------------------
_matches("match_path3", "path3", "iso", strategy="semi")
_matches("match_star3", "star3", "iso", strategy="semi")
_counts("match_wedge_iso", "wedge", "iso", strategy="semi")
_counts("match_wedge_hom", "wedge", "hom", strategy="semi")
_matches("match_triangle", "triangle", "iso", strategy="semi")
_matches("match_triangle_array", "triangle", "iso", strategy="array")
_matches("match_cycle4", "cycle4", "iso", strategy="auto")
_counts("match_cycle4_q5", "cycle4", "iso", strategy="semi")
_matches("match_cycle4_reduced", "cycle4", "iso", strategy="semi", preprocess=True)
_matches("match_butterfly_iso", "butterfly", "iso", strategy="semi")
_counts("match_butterfly_hom", "butterfly", "hom", strategy="semi")
_matches("match_triangle_tail", "triangle_tail", "iso", strategy="semi")
_matches("match_edge", "edge", "iso", strategy="auto")
_matches("match_house", "house", "iso", strategy="semi")
_counts("match_count", "triangle", "iso", strategy="semi")
_counts("match_factorised_count", "star3", "iso", strategy="semi")
_counts("match_factorised_hom", "triangle_tail", "hom", strategy="semi")
_matches("match_test_order", "cycle4", "iso", strategy="semi", order="test")
_matches("match_input_order", "cycle4", "iso", strategy="semi", order="input", input_order=[3, 2, 1, 0])


@query("match_limit", f"SELECT CAST(least(1000, embeddings) AS BIGINT) AS embeddings FROM ({pattern_sql(PATTERNS['path3'], True, _COUNT)}) t")
def _(g: PropertyGraph, spark):
    return engine.count(g, PATTERNS["path3"], limit=1000, strategy="semi")


@query("match_vertex", "SELECT vid AS u0 FROM v WHERE label = 3")
def _(g: PropertyGraph, spark):
    return engine.match(g, Pattern([SUPPLIER], []))


@query("match_unknown_label", "SELECT vid AS u0, vid AS u1 FROM v WHERE label = 99")
def _(g: PropertyGraph, spark):
    return engine.match(g, Pattern([99, ORDER], [(0, 1)]), strategy="semi")


@query("match_spectrum", f"SELECT t.k, m.embeddings FROM ({pattern_sql(PATTERNS['cycle4'], True, _COUNT)}) m, (SELECT unnest([0, 1, 2]) AS k) t")
def _(g: PropertyGraph, spark):
    p = PATTERNS["cycle4"]
    out = None
    for k, order in zip(range(3), spectrum(p)):
        # one by one: the shuffle files of an order go before the next is joined
        row = written(engine.count(g, p, strategy="semi", order="input", input_order=order).select(F.lit(k).alias("k"), "embeddings"), "spectrum")
        out = row if out is None else out.union(row)
    return out


@query("plan_import", pattern_sql(PATTERNS["cycle4"], True, _ALL))
def _(g: PropertyGraph, spark):
    text = Plan.single([0, 1, 2, 3]).to_json()
    return engine.run_plan(g, PATTERNS["cycle4"], text)


@query("embedding_table", pattern_sql(PATTERNS["triangle"], True, "u0, u1, u2"))
def _(g: PropertyGraph, spark):
    return written(engine.match(g, PATTERNS["triangle"], strategy="semi"), "embeddings")


# -- aggregates ------------------------------------------------------------------------------------
query("label_frequency", "SELECT label, count(*) AS frequency FROM v GROUP BY label")(lambda g, spark: g.label_frequency())
query("degree_stats", "SELECT count(*) AS n, max(d) AS max_degree, CAST(sum(d) AS BIGINT) AS total FROM (SELECT v.vid, count(e.src) AS d FROM v LEFT JOIN e ON e.src = v.vid GROUP BY v.vid) t")(
    lambda g, spark: g.degrees().agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("max_degree"), F.sum("degree").alias("total"))
)
query("label_pair_cardinality", "SELECT sl, dl, count(*) AS cardinality FROM e GROUP BY sl, dl")(lambda g, spark: g.label_pair_cardinality())
query("relation_max_degree", "SELECT sl, dl, max(d) AS max_degree FROM (SELECT sl, dl, src, count(*) AS d FROM e GROUP BY sl, dl, src) t GROUP BY sl, dl")(lambda g, spark: g.max_degrees())
query(
    "triangles_per_edge",
    """SELECT a.src AS a, a.dst AS b, count(*) AS triangles FROM e a JOIN e b ON b.src = a.src JOIN e c ON c.src = a.dst AND c.dst = b.dst
    WHERE a.src < a.dst GROUP BY a.src, a.dst""",
)(lambda g, spark: g.triangles_per_edge())
query(
    "graph_metadata",
    """SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e0) AS n_edges, (SELECT count(DISTINCT label) FROM v) AS n_labels,
    (SELECT max(d) FROM (SELECT count(*) AS d FROM e GROUP BY src) t) AS max_degree, (SELECT max(f) FROM (SELECT count(*) AS f FROM v GROUP BY label) t) AS max_label_frequency""",
)(lambda g, spark: g.metadata())
_CATALOG = """SELECT {a} AS a, {b} AS b, '{kind}' AS kind, (SELECT count(*) FROM e WHERE sl = {la} AND dl = {lb}) AS scanned, count(*) AS reduced,
    (SELECT max(d) FROM (SELECT count(*) AS d FROM {r} GROUP BY x) t) AS max_degree_a, (SELECT max(d) FROM (SELECT count(*) AS d FROM {r} GROUP BY y) t) AS max_degree_b FROM {r}"""
ORACLES["catalog_info"] = (
    f"WITH {_V}, {_E0}, {_E}, r01 AS (SELECT src AS x, dst AS y FROM e WHERE sl = 2 AND dl = 5 AND dst IN (SELECT src FROM e WHERE sl = 5 AND dl = 4)), "
    "r12 AS (SELECT src AS x, dst AS y FROM e WHERE sl = 5 AND dl = 4 AND src IN (SELECT dst FROM e WHERE sl = 2 AND dl = 5)) "
    + _CATALOG.format(a=0, b=1, kind="leaf", la=2, lb=5, r="r01")
    + " UNION ALL "
    + _CATALOG.format(a=1, b=2, kind="leaf", la=5, lb=4, r="r12")
)
QUERIES["catalog_info"] = lambda spark, sf_dir: engine.catalog_info(lazy_graph(spark, sf_dir), PATTERNS["path3"])


@query("step_metrics", f"""SELECT 2 AS depth, 1 AS vertex, (SELECT count(*) FROM e WHERE sl = 5 AND dl = 2) AS prefixes, 0 AS rejected
    UNION ALL SELECT 3, 2, ({pattern_sql(PATTERNS['wedge'], True, 'count(*)')}), ({pattern_sql(PATTERNS['wedge'], False, 'count(*)')}) - ({pattern_sql(PATTERNS['wedge'], True, 'count(*)')})""")
def _(g: PropertyGraph, spark):
    return engine.step_metrics(g, PATTERNS["wedge"], [0, 1, 2])


_PEEL = "k{i} AS (SELECT src, dst FROM {e} WHERE src IN (SELECT src FROM {e} GROUP BY src HAVING count(*) >= 2) AND dst IN (SELECT src FROM {e} GROUP BY src HAVING count(*) >= 2))"
ORACLES["kcore_2"] = f"WITH {_V}, {_E0}, {_E}, " + ", ".join(_PEEL.format(i=i, e=f"k{i - 1}" if i else "e") for i in range(8)) + " SELECT DISTINCT src AS vid FROM k7"
QUERIES["kcore_2"] = lambda spark, sf_dir: lazy_graph(spark, sf_dir).k_core(2)


# -- preparation -----------------------------------------------------------------------------------
query("relabel_hash", "SELECT vid, CAST((((vid % 1000003) * 7919 + 104729) % 1000003) % 10 AS INTEGER) AS label FROM v")(lambda g, spark: prep.relabel_hash(g.vertices, 10))
query("sample_edges_hash", "SELECT src, dst FROM e WHERE src < dst AND (((src % 1000003) * 7919 + (dst % 1000003) * 104729) % 1000003) % 1000 < 250")(lambda g, spark: prep.sample_edges_hash(g.edges, 250))


# -- plans: no SQL ---------------------------------------------------------------------------------
@query("plan_order_nd")
def _(g: PropertyGraph, spark):
    rows = [(name, kind, " ".join(map(str, o)), utility(p, o)) for name, p in PATTERNS.items() for kind, o in [*(("nd", o) for o in nd_orders(p)), ("test", constrained_order(p))]]
    return spark.createDataFrame(rows, "pattern string, kind string, ordering string, utility int")


@query("plan_json")
def _(g: PropertyGraph, spark):
    return spark.createDataFrame([(name, Plan.single(nd_orders(p)[0]).to_json()) for name, p in PATTERNS.items()], "pattern string, plan string")


@query("nucleus_tree")
def _(g: PropertyGraph, spark):
    rows = [(name, d["node"], d["parent"], d["r"], d["k"], d["vertices"], d["edges"], d["density"]) for name, p in PATTERNS.items() for d in describe(density_tree(p))]
    return spark.createDataFrame(rows, "pattern string, node int, parent int, r int, k int, vertices array<int>, edges int, density double")
