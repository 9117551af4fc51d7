"""The query interface: match, count, explain, catalog and metrics.

Matches map pattern vertices to data vertices of the same label so that pattern edges become data
edges; ``iso`` maps different vertices to different ones, ``hom`` needn't. Extra data edges don't
matter, and every automorphic image is a match of its own.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.pattern import Pattern
from weftgraph.plans import extend as steps
from weftgraph.plans import local
from weftgraph.plans.orders import Sizes, cheapest, order_of, utility
from weftgraph.plans.reduce import Relations, nlf_filter, scan, semi_join_program, sizes, sizes_of_scans
from weftgraph.plans.tree import Plan
from weftgraph.store import written

STRATEGIES = ("auto", "semi", "array", "local")


class Timeout(RuntimeError):
    """The time limit was reached; there is no partial count."""


@dataclass
class Prepared:
    """What a query is run with: relations, sizes, order, strategy, and how long each stage took."""

    graph: PropertyGraph
    pattern: Pattern
    injection: bool
    strategy: str
    order: list[int]
    relations: Relations
    sizes: Sizes
    #: Without an order that is asked for, squares are joined from wedges.
    square: bool = False
    metrics: dict[str, float] = field(default_factory=dict)
    table: object = None


def _spark(graph: PropertyGraph) -> SparkSession:
    return graph.spark


def prepare(graph: PropertyGraph, pattern: Pattern, mode: str = "iso", order: str = "nd", preprocess: bool | None = None, strategy: str = "auto", input_order: list[int] | None = None) -> Prepared:
    """Scan, filter, reduce and order. ``preprocess``: NLF and semi-join reduction, written once; None: only where plans are bound to profit (many cycles)."""
    if mode not in ("iso", "hom"):
        raise ValueError(f"unknown mode: {mode!r}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy!r}; known: {STRATEGIES}")
    metrics: dict[str, float] = {}

    def timed(name, f):
        start = time.time()
        out = f()
        metrics[name] = time.time() - start
        return out

    injection = mode == "iso"
    known, table = Sizes(), None
    if strategy in ("auto", "local") and pattern.n > 1:
        part = local.relevant(graph, pattern).select("src", "dst", "sl", "dl")
        few = timed("scan_s", lambda: part.limit(local.LOCAL_EDGES + 1).count())
        if few <= local.LOCAL_EDGES:
            table = timed("load_s", part.toArrow)
            strategy = "local"
        elif strategy == "local":
            raise ValueError(f"the pattern's labels have more than {local.LOCAL_EDGES} edges; take another strategy")
    relations = scan(graph, pattern)
    if strategy != "local":
        dense = len(pattern.edges) - pattern.n + 1 >= 3
        if preprocess or (preprocess is None and dense):
            def kept(df):
                return written(df, "relation")

            def reduced():
                base = nlf_filter(graph, pattern, relations, kept) if injection else relations
                return semi_join_program(pattern, {e: kept(r) for e, r in base.items()}, kept)

            relations = timed("preprocess_s", reduced)
            known.learn(sizes(relations))
    free = order in ("nd", "auto")
    square = strategy == "semi" and free and steps.square(pattern) is not None
    # with a cycle there is a choice; lists are joined from all of a vertex's relations
    if strategy in ("semi", "auto") and len(pattern.edges) >= pattern.n and not square:
        if not known.edge:
            known.learn(timed("sizes_s", lambda: sizes_of_scans(graph, pattern, relations)))
        relations = {e: F.broadcast(r) if known.edge[e] <= steps.FEW_ROWS else r for e, r in relations.items()}
    chosen = timed("order_s", lambda: order_of(pattern, order, known, input_order))
    if free and known.fan and strategy in ("semi", "auto"):
        chosen = cheapest(pattern, chosen, known)
    return Prepared(graph, pattern, injection, strategy, chosen, relations, known, square, metrics, table)


def _frame(p: Prepared, limit: int | None) -> DataFrame:
    n = p.pattern.n
    if n == 1:
        return p.graph.with_label(p.pattern.labels[0]).select(F.col("vid").alias("u0"))
    if p.strategy == "local":
        return local.match_local(_spark(p.graph), p.graph, p.pattern, p.order, p.injection, limit, p.table)
    if p.square:
        return steps.match_square(p.pattern, p.relations, p.injection).select(*[f"u{u}" for u in range(n)])
    return steps.extend(p.pattern, p.relations, p.order, p.injection, p.strategy, p.sizes).select(*[f"u{u}" for u in range(n)])


def match(graph: PropertyGraph, pattern: Pattern, mode: str = "iso", order: str = "nd", preprocess: bool | None = None, limit: int | None = None, strategy: str = "auto", input_order: list[int] | None = None) -> DataFrame:
    """One row for each match: u0, u1 and so on. ``limit`` is exact: min(limit, all)."""
    df = _frame(prepare(graph, pattern, mode, order, preprocess, strategy, input_order), limit)
    return df if limit is None else df.limit(limit)


def count(graph: PropertyGraph, pattern: Pattern, mode: str = "iso", order: str = "nd", preprocess: bool | None = None, limit: int | None = None, strategy: str = "auto", input_order: list[int] | None = None, factorise: bool = True) -> DataFrame:
    """One row, ``embeddings``: the number of matches, up to the limit."""
    p = prepare(graph, pattern, mode, order, preprocess, strategy, input_order)
    if limit is not None:
        return _frame(p, limit).limit(limit).agg(F.count(F.lit(1)).alias("embeddings"))
    if p.strategy == "local" or pattern.n == 1:
        return _frame(p, None).agg(F.count(F.lit(1)).alias("embeddings"))
    if p.square:
        return steps.count_square(pattern, p.relations, p.injection)
    return steps.count_rows(pattern, p.relations, p.order, p.injection, p.strategy, p.sizes, factorise)


def count_within(graph: PropertyGraph, pattern: Pattern, seconds: float, **options) -> tuple[int, dict[str, float]]:
    """The count and the stages' times; ``Timeout`` once it takes longer, with its jobs cancelled."""
    sc = _spark(graph).sparkContext
    group = f"weftgraph-{time.time_ns()}"
    done = threading.Event()
    late = threading.Event()

    def watch():
        if not done.wait(seconds):
            late.set()
            sc.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    start = time.time()
    sc.setJobGroup(group, "count within a time limit", interruptOnCancel=True)
    watcher.start()
    try:
        p_count = count(graph, pattern, **options).first()[0]
    except Exception as e:
        if late.is_set():
            raise Timeout(f"more than {seconds} s") from e
        raise
    finally:
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)
    took = time.time() - start
    return p_count, {"query_s": took, "embeddings": p_count, "throughput": p_count / took if took else 0.0}


def run_plan(graph: PropertyGraph, pattern: Pattern, plan: Plan | str, mode: str = "iso", how: str = "semi") -> DataFrame:
    """The matches by a given plan (an object or JSON)."""
    plan = Plan.from_json(plan) if isinstance(plan, str) else plan
    return plan.frame(pattern, scan(graph, pattern), mode == "iso", how)


def explain(graph: PropertyGraph, pattern: Pattern, **options) -> str:
    """Order, utility, strategy, plan JSON and Spark's plan, as text."""
    p = prepare(graph, pattern, **options)
    df = _frame(p, None)
    head = f"order {p.order}, utility {utility(pattern, p.order)}, strategy {p.strategy}\n{Plan.single(p.order).to_json()}\n"
    return head + df._jdf.queryExecution().explainString(_spark(graph)._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def catalog_info(graph: PropertyGraph, pattern: Pattern, mode: str = "iso") -> DataFrame:
    """A row for each pattern edge: kind, rows after the scan and after reduction, largest degrees of both ends."""
    first = {e: written(r, "relation") for e, r in scan(graph, pattern).items()}
    base = nlf_filter(graph, pattern, first) if mode == "iso" else first
    reduced = {e: written(r, "relation") for e, r in semi_join_program(pattern, base).items()}
    out = None
    for a, b in pattern.edges:
        r, f = reduced[a, b], first[a, b]
        n = f.agg(F.count(F.lit(1)).alias("scanned"))
        per = lambda u, r=r: r.groupBy(f"u{u}").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias(f"max_degree_{'ab'[u != a]}"), F.coalesce(F.sum("d"), F.lit(0)).alias(f"rows_{'ab'[u != a]}"))
        row = n.join(per(a), F.lit(True)).join(per(b), F.lit(True))  # one row each
        row = row.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(pattern.edge_kind(a, b)).alias("kind"), "scanned", F.col("rows_a").alias("reduced"), "max_degree_a", "max_degree_b")
        out = row if out is None else out.union(row)
    if out is None:
        raise ValueError("a pattern of one vertex has no relations")
    return out


def step_metrics(graph: PropertyGraph, pattern: Pattern, order: list[int], mode: str = "iso") -> DataFrame:
    """depth, vertex, prefixes, rejected: partial matches of each length, and those that injectivity took back."""
    relations = scan(graph, pattern)
    rows = None
    for depth in range(2, pattern.n + 1):
        head = order[:depth]
        kept = steps.extend(pattern, relations, head, mode == "iso").agg(F.count(F.lit(1)).alias("prefixes"))
        free = _one_step_free(pattern, relations, head, mode == "iso").agg(F.count(F.lit(1)).alias("all"))
        row = kept.join(free, F.lit(True)).select(F.lit(depth).alias("depth"), F.lit(head[-1]).alias("vertex"), "prefixes", (F.col("all") - F.col("prefixes")).alias("rejected"))
        rows = row if rows is None else rows.union(row)
    return rows


def _one_step_free(pattern: Pattern, relations: Relations, head: list[int], injection: bool) -> DataFrame:
    """The prefix with its last vertex bound without regard to injectivity."""
    from weftgraph.plans.orders import backward

    before = steps.extend(pattern, relations, head[:-1], injection) if len(head) > 2 else steps._first(pattern, relations, head)
    return steps.step(before, relations, head[-1], backward(pattern, head)[head[-1]], "semi", Sizes())
