"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, natively.

Targets: sources, in code point order with null last, weigh 3, 1, 2 and so on; together they share
``TOTAL`` times all words. A target stops at ``MOST`` times its source's words, and the excess goes to
the others by weight.

Blocks: a hash permutes each source's documents, and ranges of the hash cut it into up to ``BLOCKS``
blocks, or more, of ``BLOCK_DOCS`` documents on average, in a source of more. A source's quota is the exact number of block draws whose words come nearest its target:
whole passes over its blocks, then the first blocks of the permutation that fit, then the few blocks that
fill the rest best. A block is drawn at most ``MOST`` times.

Tree: the root holds all sources' quotas. Each node splits its quotas in two by a multivariate
hypergeometric draw (source by source, each by inversion of the hypergeometric distribution
conditioned on the draws before), down to the output shards. Leaves hold exact quotas; a shard takes
the next so many blocks of each source's permutation, so shards draw disjoint blocks. Each shard is
shuffled locally, by a hash of shard, document and pass.

All randomness is hashes of the seed, so reruns agree. Null texts have no words; null sources are a
source of their own; a source without words has target 0. Rows that share a doc_id are documents of
their own; equal rows are told apart by nothing, so any of them may be the one that is drawn more
often. Extra columns are ignored (their names may not start with ``__``); an empty table gives an
empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, Cut

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Blocks of a source; a block holds one document or so in small sources, and about ``BLOCK_DOCS`` in large ones.
BLOCKS, BLOCK_DOCS = 4096, 1 << 14
#: Blocks that fill what the first blocks of the permutation leave of a target: each the largest that fits, the last the nearest.
FILLS = 4
#: Words in a shard, about.
SHARD_WORDS = 1 << 24
#: Rows of the draws' table up to which it may be broadcast (24 bytes each).
BROADCAST_ROWS = 1 << 19


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def targets(sizes: DataFrame) -> DataFrame:
    """source, docs, source_size, target of a table with source and size.

    The windows run over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS)) + 1)
    ranked = by.select("source", "source_size", "docs", (rank - 1).alias("s"), weight.alias("w"), (F.col("source_size") * MOST).cast("double").alias("top"))
    # sources in the order in which they reach their top as the level (words for a weight of 1) rises
    order = Window.orderBy(F.col("top") / F.col("w"), "s")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * TOTAL - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level).withColumn("free", F.col("top") / F.col("w") >= F.col("level"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("top") / F.col("w"), F.col("s"), F.col("level").alias("level")))).over(everything)["level"]
    return levels.withColumn("final", final).select("s", "source", "docs", "source_size", F.coalesce(F.least(F.col("top"), F.col("final") * F.col("w")), F.col("top")).alias("target"))


def _block(h: Column, blocks: Column) -> Column:
    """The block of a hash: its range among ``blocks`` equal ranges of 32 bits."""
    return F.floor(F.shiftrightunsigned(h, 32) * blocks / F.lit(float(1 << 32))).cast("int")


def _blocks_of(docs: Column) -> Column:
    return F.least(F.greatest(docs, F.lit(1)), F.greatest(F.lit(BLOCKS), F.ceil(docs / BLOCK_DOCS)))


def _quotas(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """s, block, words, place, passes, quota: the blocks in the order in which they are drawn.

    A source's windows run over one row for each of its blocks.
    """
    blocks = sized.groupBy("s", "block").agg(F.sum("size").alias("words"))
    part = F.col("target") - F.col("passes") * F.col("source_size")
    aimed = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
    aimed = aimed.select("s", "passes", F.greatest(part, F.lit(0.0)).alias("part"))
    w = Window.partitionBy("s")
    run = blocks.join(aimed, "s").withColumn("upto", F.sum("words").over(w.orderBy("block")))
    fits = (F.col("upto") <= F.col("part")) & (F.col("part") > 0)
    rest = run.withColumn("group", F.when(fits, 0).otherwise(FILLS + 1))
    for k in range(1, FILLS + 1):
        chosen = F.sum(F.when(F.col("group") <= FILLS, F.col("words")).otherwise(0)).over(w)
        rest = rest.withColumn("gap", F.col("part") - chosen)
        miss = F.abs(F.col("gap") - F.col("words"))
        allowed = (miss < F.col("gap")) if k == FILLS else (F.col("words") <= F.col("gap")) & (F.col("words") > 0)
        better = F.when((F.col("group") > FILLS) & allowed, F.struct(miss, F.col("block")))
        rest = rest.withColumn("best", F.min(better).over(w)["block"]).withColumn("group", F.when((F.col("group") > FILLS) & (F.col("block") == F.col("best")), k).otherwise(F.col("group")))
    placed = rest.withColumn("place", F.row_number().over(w.orderBy("group", "block")) - 1)
    drawn = F.col("passes") * F.count(F.lit(1)).over(w) + F.sum(F.when(F.col("group") <= FILLS, 1).otherwise(0)).over(w)
    return placed.select("s", "block", "words", "place", F.count(F.lit(1)).over(w).alias("of"), drawn.cast("long").alias("quota"))


# -- the splitting tree ----------------------------------------------------------------------------
def _log_factorial(x: str) -> str:
    table = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(16))
    return f"if({x} < 16, element_at(array({table}), cast({x} AS INT) + 1), {x} * ln({x}) - {x} + 0.5D * ln({2 * math.pi!r}D * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * {x} * {x} * {x} * {x} * {x}))"


def _bind(name: str, value: str, then: str) -> str:
    """SQL of ``then`` with ``name`` for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def hypergeometric(u: str, marked: str, total: str, drawn: str) -> str:
    """SQL of the number of marked ones among ``drawn`` of ``total``, by inversion at u (0 to 1).

    The sum runs over nine standard deviations around the mean; what lies beyond is under 1e-15.
    """
    K, N, n = "v.marked", "v.total", "v.drawn"
    given = f"named_struct('marked', {marked}, 'total', {total}, 'drawn', {drawn}, 'u', {u})"
    shape = f"named_struct('mean', {n} * ({K} / {N}), 'spread', 9 * sqrt({n} * ({K} / {N}) * (1 - {K} / {N}) * (({N} - {n}) / greatest({N} - 1, 1))) + 2)"
    ends = f"named_struct('low', greatest(0L, {n} - ({N} - {K}), cast(floor(m.mean - m.spread) AS BIGINT)), 'high', least({K}, {n}, cast(ceil(m.mean + m.spread) AS BIGINT)))"
    whole = [K, f"{N} - {K}", n, f"{N} - {n}", "e.low", f"{K} - e.low", f"{n} - e.low", f"{N} - {K} - {n} + e.low", N]
    logs = f"transform(array({', '.join(f'cast({x} AS DOUBLE)' for x in whole)}), x -> {_log_factorial('x')})"
    first = "exp(f[0] + f[1] + f[2] + f[3] - f[4] - f[5] - f[6] - f[7] - f[8])"  # the probability of e.low
    ratio = f"(({K} - k) * ({n} - k)) / ((k + 1) * ({N} - {K} - {n} + k + 1))"  # of the probabilities of k + 1 and k
    step = f"if(h.done, h, named_struct('sum', h.sum + h.p, 'p', h.p * coalesce({ratio}, 0D), 'k', if(h.sum + h.p >= v.u, k, h.k), 'done', h.sum + h.p >= v.u))"
    run = f"aggregate(sequence(e.low, e.high), named_struct('sum', 0D, 'p', {first}, 'k', e.high, 'done', false), (h, k) -> {step}, h -> h.k)"
    return _bind("v", given, _bind("m", shape, _bind("e", ends, _bind("f", logs, run))))


def split_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """shard, s, q from s, quota: exact quotas of each shard; ``shards`` is a power of two.

    A node is one row with an array of its sources; each level is a projection.
    """
    u = f"(shiftrightunsigned(xxhash64({seed}L, node, x.s), 11) / 9007199254740992D)"
    draw = f"CASE WHEN x.q = 0 OR a.n = 0 THEN 0L WHEN x.q = a.total THEN a.n ELSE {hypergeometric(u, 'x.q', 'a.total', 'a.n')} END"
    taken_from = """named_struct('total', a.total - x.q, 'n', a.n - d, 'out', concat(a.out, array(named_struct('s', x.s, 'q', if(side = 0, d, x.q - d)))))"""
    merge = _bind("d", draw, taken_from)
    fold = f"""aggregate(cells, named_struct('total', total, 'n', total div 2, 'out', cast(array() AS ARRAY<STRUCT<s: INT, q: BIGINT>>)),
        (a, x) -> {merge}, a -> a.out)"""
    level = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("quota").cast("long").alias("q")))).alias("cells")).select(F.lit(1).cast("long").alias("node"), "cells")
    for _ in range(shards.bit_length() - 1):
        sides = level.select("node", "cells", F.expr("aggregate(cells, 0L, (a, x) -> a + x.q)").alias("total"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        level = sides.select((F.col("node") * 2 + F.col("side")).alias("node"), F.expr(fold).alias("cells"))
    return level.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("cells").alias("c")).select("shard", F.col("c.s").alias("s"), F.col("c.q").alias("q"))


class Plan:
    """Targets, blocks and draws of a mix; everything here is in proportion to the sources, not the documents."""

    def __init__(self, docs: DataFrame, seed: int = 0, shard_words: int = SHARD_WORDS):
        self.seed = seed
        rows = docs.select("doc_id", "source", size_of(docs["text"]).alias("size"), _hash(docs, seed).alias("h"))
        self.rows = Cut(rows, "sizes").df
        self.aims = Cut(targets(self.rows), "targets").df
        sized = self.sized(self.rows)
        quotas = Cut(_quotas(sized, self.aims), "quotas").df
        self.sources, words = self.aims.agg(F.count(F.lit(1)), F.sum("target")).first()
        self.shards = 1 << max(0, math.ceil((words or 0) / shard_words) - 1).bit_length()
        cells = Cut(split_tree(quotas.select("s", "quota").distinct(), self.shards, seed), "cells").df
        start = F.coalesce(F.sum("q").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # draw j of a source goes round its blocks: place j mod (number of blocks), pass j div (number of blocks)
        drawn = cells.where("q > 0").withColumn("start", start).select("s", "shard", F.explode(F.sequence("start", F.col("start") + F.col("q") - 1)).alias("j"))
        at = quotas.select("s", "block", "place", "of")
        count = quotas.select("s", "of").distinct()
        passes = drawn.join(count, "s").select("s", "shard", (F.col("j") % F.col("of")).cast("int").alias("place"), F.floor(F.col("j") / F.col("of")).cast("int").alias("pass"))
        self.draws = Cut(passes.join(at, ["s", "place"]).select("s", "block", "shard", "pass"), "draws").df

    def sized(self, rows: DataFrame) -> DataFrame:
        """Rows with their source's number s and their block, from source and h."""
        aims = self.aims.select("s", F.col("source").alias("__source"), F.col("docs").alias("__docs"), "source_size", "target")
        joined = rows.join(F.broadcast(aims) if self.sources_few() else aims, F.col("source").eqNullSafe(F.col("__source")))
        return joined.withColumn("block", _block(F.col("h"), _blocks_of(F.col("__docs")))).drop("__source", "__docs")

    def sources_few(self) -> bool:
        """Whether the sources' table is small enough to broadcast; it is counted once."""
        if not hasattr(self, "_few"):
            self._few = self.aims.count() <= 10_000
        return self._few


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    plan = Plan(docs, seed)
    times = plan.draws.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    out = plan.sized(plan.rows).join(times, ["s", "block"], "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))


def mix(docs: DataFrame, seed: int = 0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The drawn documents with all their columns and ``shard``, in shards that are shuffled locally.

    A document that is drawn twice is there twice, in the shards of its two draws. A partition is a shard.
    """
    plan = Plan(docs, seed, shard_words)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(row, "source", "doc_id", _hash(docs, seed).alias("h"))
    draws = plan.draws
    if draws.count() <= BROADCAST_ROWS:
        draws = F.broadcast(draws)
    drawn = plan.sized(hashed).join(draws, ["s", "block"])
    order = F.xxhash64(F.lit(seed), "shard", "pass", "h")
    return drawn.repartitionById(plan.shards, F.col("shard")).sortWithinPartitions("shard", order).select("row.*", "shard")
