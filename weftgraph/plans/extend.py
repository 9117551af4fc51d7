"""Physical strategies of the join, one pattern vertex at a time, as DataFrame plans.

``semi``: join with one relation of the new vertex, semi-join with its others. ``array``: join the
sorted neighbour lists of all its relations, intersect them, explode. Both give the same rows;
``auto`` takes lists where three or more relations meet.
"""

from __future__ import annotations

from contextlib import ExitStack
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.relations import as_lists
from weftgraph.pattern import Pattern
from weftgraph.plans.orders import Sizes, backward, rows_of_steps
from weftgraph.plans.reduce import Relations
from weftgraph.store import lent, shuffles_dropped

#: Relations of a cyclic pattern that are known to have so few rows (of 16 bytes) are broadcast.
FEW_ROWS = 100_000
#: A round of wedges that are counted isn't made smaller than so many.
ROUND = 1_000_000


def _relation(relations: Relations, a: int, b: int) -> DataFrame:
    return relations[min(a, b), max(a, b)]


def injective(pattern: Pattern, bound: list[int], u: int) -> Column | None:
    """u differs from all vertices of its label that are bound; others can't be equal."""
    same = [F.col(f"u{u}") != F.col(f"u{v}") for v in bound if pattern.labels[v] == pattern.labels[u]]
    return reduce(lambda a, b: a & b, same) if same else None


def step(df: DataFrame, relations: Relations, u: int, before: list[int], how: str, sizes: Sizes, rows: float = 0) -> DataFrame:
    """The prefix with column u; before: u's neighbours in it, one at least. It is joined with the relation of the least fan-out.

    Another relation that is not broadcast is joined with that one first, on u, if this gives fewer than the ``rows`` of the
    prefix: the prefix is then joined with both at once instead of being dealt out for each.
    """
    if how == "array" or (how == "auto" and len(before) >= 3):
        for v in before:
            lists = as_lists(_relation(relations, v, u), f"u{v}", f"u{u}").select(f"u{v}", F.col("nbrs").alias(f"__n{v}"))
            df = df.join(lists, f"u{v}")
        lists = [f"__n{v}" for v in before]
        common = reduce(lambda a, b: F.array_intersect(a, b), [F.col(c) for c in lists])
        return df.select(*[c for c in df.columns if c not in lists], F.explode(common).alias(f"u{u}"))
    # of about equal fan-outs, which are by a sketch, that of a relation that is broadcast
    fan = lambda v: sizes.fan.get((v, u), 0)
    first, *others = sorted(before, key=lambda v: (round(fan(v)), sizes.rows(v, u) > FEW_ROWS, fan(v)))
    new, keys, wide = _relation(relations, first, u), [first], float(sizes.rows(first, u))
    for v in others:
        wider = wide * sizes.fan.get((u, v), 1.0)
        if sizes.rows(v, u) > FEW_ROWS and wider < rows:
            new, wide = new.join(_relation(relations, v, u), f"u{u}"), wider
            keys.append(v)
    df = df.join(new, [f"u{v}" for v in keys])
    for v in others:
        if v not in keys:
            n = sizes.rows(v, u)
            if FEW_ROWS < n <= 16 * FEW_ROWS and 4 * n < rows * sizes.fan.get((first, u), 1.0) and 2 * sizes.fan.get((v, u), 1.0) <= sizes.of(u):
                # pairs are distinct; a semi-join would be pushed below the bits
                df = thinned(df, _relation(relations, v, u)).join(_relation(relations, v, u), [f"u{v}", f"u{u}"])
            else:
                df = df.join(_relation(relations, v, u), [f"u{v}", f"u{u}"], "left_semi")
    return df


def thinned(df: DataFrame, relation: DataFrame) -> DataFrame:
    """df without most of the rows that a semi-join with the relation drops, so that they aren't dealt out for it.

    By one bit for the hash of each pair, in ``FEW_ROWS`` words that are broadcast: no row of the semi-join is lost.
    """
    h = F.xxhash64(*sorted(relation.columns))
    place = [F.pmod(F.shiftrightunsigned(h, 6), F.lit(FEW_ROWS)).alias("__word"), h.bitwiseAND(63).cast("int").alias("__bit")]
    words = relation.select(*place).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    found = df.select("*", *place).join(F.broadcast(words), "__word").where(F.expr("getbit(__bits, __bit) = 1"))
    return found.select(*df.columns)


def extend(
    pattern: Pattern,
    relations: Relations,
    order: list[int],
    injection: bool,
    how: str = "semi",
    sizes: Sizes | None = None,
    prefix: DataFrame | None = None,
    needed: set[int] | None = None,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Rows of the pattern's vertices in ``order``; ``prefix`` holds the first of them already.

    Only ``needed`` columns are kept to the end (all by default); others go once nothing later
    refers to them, so a count carries few columns.
    """
    near, sizes = backward(pattern, order), sizes or Sizes()
    whole = prefix is None
    if whole:
        prefix = roots if roots is not None and pattern.n == 1 else _first(pattern, relations, order)
    bound = [u for u in order if f"u{u}" in prefix.columns]
    made = dict(zip(order, rows_of_steps(order, near, sizes)))
    df = prefix
    for i, u in enumerate(order):
        if u in bound:
            continue
        if whole and i == 1:
            # each candidate of the first vertex is in this relation
            df = _relation(relations, order[0], u).select(f"u{order[0]}", f"u{u}")
        else:
            df = step(df, relations, u, near[u], how, sizes, made[order[i - 1]])
        rule = injective(pattern, [v for v in bound if f"u{v}" in df.columns], u) if injection else None
        if rule is not None:
            df = df.where(rule)
        bound.append(u)
        if needed is not None:
            later = order[i + 1 :]
            alive = [v for v in bound if f"u{v}" in df.columns and (v in needed or pattern.adjacent[v] & set(later) or (injection and any(pattern.labels[w] == pattern.labels[v] for w in later)))]
            df = df.select(*[f"u{v}" for v in alive])
    return df


def _first(pattern: Pattern, relations: Relations, order: list[int]) -> DataFrame:
    """The first vertex's candidates: from the smallest number of its relations that is needed, the first one."""
    u = order[0]
    if pattern.n == 1:
        raise ValueError("a pattern of one vertex has no relation; give its candidates")
    return _relation(relations, u, next(v for v in order if v in pattern.adjacent[u])).select(f"u{u}").distinct()


def leaves_to_multiply(pattern: Pattern, order: list[int], injection: bool) -> list[int]:
    """Vertices of degree 1 at the end of an order whose matches are independent of one another.

    With injection, no other vertex of the pattern may have the leaf's label.
    """
    out: list[int] = []
    for u in order[:0:-1]:
        alone = sum(x == pattern.labels[u] for x in pattern.labels) == 1
        if pattern.degree(u) != 1 or (injection and not alone) or (pattern.n == 2):
            break
        out.append(u)
    return out


def count_rows(pattern: Pattern, relations: Relations, order: list[int], injection: bool, how: str, sizes: Sizes, factorise: bool = True) -> DataFrame:
    """One row, ``embeddings``: leaves are counted by the degree of their neighbour instead of being listed."""
    leaves = leaves_to_multiply(pattern, order, injection) if factorise else []
    inner = [u for u in order if u not in leaves]
    parents = {u: next(iter(pattern.adjacent[u])) for u in leaves}
    if not leaves:
        return extend(pattern, relations, order, injection, how, sizes, needed=set()).agg(F.count(F.lit(1)).alias("embeddings"))
    if len(inner) > 1:
        df = extend(pattern, relations, inner, injection, how, sizes, needed=set(parents.values()))
    else:
        df = _first(pattern, relations, order)
    product = F.lit(1).cast("long")
    for u, v in parents.items():
        df = df.join(_relation(relations, u, v).groupBy(f"u{v}").agg(F.count(F.lit(1)).alias(f"__c{u}")), f"u{v}")
        product = product * F.col(f"__c{u}")
    return df.agg(F.coalesce(F.sum(product), F.lit(0)).cast("long").alias("embeddings"))


def square(pattern: Pattern) -> tuple[int, int, int, int] | None:
    """(x, y, b, d) of a cycle x, b, y, d whose opposite vertices have equal labels; None for other patterns."""
    if pattern.n != 4 or any(pattern.degree(u) != 2 for u in range(4)):
        return None
    b, d = sorted(pattern.adjacent[0])
    (y,) = {1, 2, 3} - {b, d}
    same = pattern.labels[0] == pattern.labels[y] and pattern.labels[b] == pattern.labels[d]
    return (0, y, b, d) if same else None


def _wedges(relation: DataFrame, at: str, end: str, injection: bool) -> DataFrame:
    """p, q, at: pairs of ends (p < q, or p <= q without injection) and a vertex that both are joined to."""
    a, b = relation.select(at, F.col(end).alias("p")), relation.select(at, F.col(end).alias("q"))
    return a.join(b, at).where(F.col("p") < F.col("q") if injection else F.col("p") <= F.col("q")).select("p", "q", at)


def _fewer_wedges(relation: DataFrame) -> tuple[str, str, float, int]:
    """The columns (at, end) of a relation, so that fewer wedges are at the first one; about how many of different ends, and its rows.

    Their numbers are by the sums of squared degrees, here by sketches: signed sums in hashed buckets, whose squares
    have those sums as expectation, also with very uneven degrees.
    """
    def squares(c: str) -> DataFrame:
        h = F.xxhash64(c)
        sign = F.when(h.bitwiseAND(1) == 0, 1).otherwise(-1)
        buckets = relation.groupBy(F.shiftrightunsigned(h, 52).alias("bucket")).agg(F.sum(sign).alias("s"), F.count(F.lit(1)).alias("rows"))
        return buckets.agg(F.lit(c).alias("c"), F.sum(F.col("s").cast("double") * F.col("s")).alias("n"), F.sum("rows").alias("rows"))

    x, b = relation.columns
    found = {r.c: r for r in squares(x).union(squares(b)).collect()}
    n, rows = {c: r.n or 0.0 for c, r in found.items()}, found[x].rows or 0
    at, end = (x, b) if n[x] <= n[b] else (b, x)
    return at, end, max(0.0, (n[at] - rows) / 2), rows


def _square_side(pattern: Pattern, relations: Relations) -> tuple[DataFrame, str, str, float, int]:
    """One of the four relations, its columns (at, end), about how many wedges it has, and its rows.

    By the pattern's symmetry, each of its relations holds what the others need.
    """
    x, _, b, _ = square(pattern)
    relation = _relation(relations, x, b).select(f"u{x}", f"u{b}")
    return relation, *_fewer_wedges(relation)


def match_square(pattern: Pattern, relations: Relations, injection: bool) -> DataFrame:
    """Matches of a square: wedges over a pair of ends in one order, joined with themselves on both ends, and turned round."""
    relation, at, end, _, _ = _square_side(pattern, relations)
    x, y, b, d = square(pattern)
    (x, y), (b, d) = ((x, y), (b, d)) if at == f"u{x}" else ((b, d), (x, y))
    w = _wedges(relation, at, end, injection)
    both = w.withColumnRenamed(at, "x").join(w.withColumnRenamed(at, "y"), ["p", "q"])
    if injection:
        both = both.where("x <> y")
    there, back = F.struct(F.col("p").alias("b"), F.col("q").alias("d")), F.struct(F.col("q").alias("b"), F.col("p").alias("d"))
    turned = both.select("x", "y", F.explode(F.when(F.col("p") < F.col("q"), F.array(there, back)).otherwise(F.array(there))).alias("e"))
    return turned.select(F.col("x").alias(f"u{x}"), F.col("y").alias(f"u{y}"), F.col("e.b").alias(f"u{b}"), F.col("e.d").alias(f"u{d}"))


def _pairs(lists: DataFrame, k: int, rounds: int) -> DataFrame:
    """p, q of round k: pairs p < q of each sorted list ``ends``; a p has all its pairs in one round."""
    each = lists.select("ends", F.posexplode("ends").alias("i", "p")).where(F.pmod(F.xxhash64("p"), F.lit(rounds)) == k)
    return each.select("p", F.explode(F.slice("ends", F.col("i") + 2, F.size("ends"))).alias("q"))


def _ends(relation: DataFrame, at: str, end: str, k: int, parts: int) -> DataFrame:
    """``ends``: the sorted neighbours of each centre in part k that has two or more."""
    own = relation.where(F.pmod(F.xxhash64(at), F.lit(parts)) == k)
    # dealt out before they are gathered, since hardly any edges of a task have the same centre
    ends = own.repartition(at).groupBy(at).agg(F.sort_array(F.collect_list(end)).alias("ends"))
    return ends.where(F.size("ends") > 1).select("ends")


def count_square(pattern: Pattern, relations: Relations, injection: bool) -> DataFrame:
    """One row, ``embeddings``, of a square: wedges are counted by their ends.

    In rounds of half as many wedges as the relation has rows, one by one, so that the disk they take is by the rows; they are
    made anew from the neighbours of each centre, which are gathered by halves and written for that time.
    """
    relation, at, end, wedges, rows = _square_side(pattern, relations)
    spark, total = relation.sparkSession, 0
    # both ends may be one vertex
    if not injection:
        with shuffles_dropped(spark):
            one = relation.groupBy(end).agg(F.count(F.lit(1)).alias("c"))
            total += one.agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).collect()[0][0]
    parts, rounds = 1 + (rows > ROUND), max(1, ceil(wedges / max(rows / 2, ROUND)))
    times = F.col("c") * (F.col("c") - 1 if injection else F.col("c"))
    with ExitStack() as files:
        lists = reduce(DataFrame.union, [files.enter_context(lent(_ends(relation, at, end, k, parts), "ends")) for k in range(parts)])
        for k in range(rounds):
            with shuffles_dropped(spark):
                # dealt out before they are counted, since hardly any wedges of a task have the same ends
                w = _pairs(lists, k, rounds).repartition("p", "q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("c"))
                total += w.agg(F.coalesce(F.sum(2 * times), F.lit(0))).collect()[0][0]
    return spark.range(1, numPartitions=1).select(F.lit(total).cast("long").alias("embeddings"))


def cached_intersections(prefix: DataFrame, relations: Relations, u: int, before: list[int]) -> DataFrame:
    """The step with lists, where each distinct combination of the neighbours is intersected once and joined back."""
    keys = [f"u{v}" for v in before]
    once = step(prefix.select(*keys).distinct(), relations, u, before, "array", Sizes())
    return prefix.join(once, keys)
