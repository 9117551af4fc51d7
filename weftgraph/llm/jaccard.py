"""Exact n-gram Jaccard join in the metric space of the Jaccard distance, and its components.

Documents are sets of word shingles; two link when the similarity of their sets reaches a threshold,
that is when their distance is at most ``t``. Documents with equal sets form a class, and classes
are joined:

1. *Anchors.* In a global order of shingles, a class's anchors are its first ``n - ceil(s n) + 1``
   shingles. Linked classes share an anchor, so only classes with a common anchor need comparing. The
   order puts the most frequent shingles last (found by a mergeable sketch over all documents), so
   that passages shared by many documents hardly become anchors. Any order gives the same links.
2. *Voronoi regions.* The classes of an anchor take the first of them (by class number, a hash) as the
   pivot: the anchor's region. A class belongs to the regions of all its anchors' pivots. Its
   distance to each pivot is computed exactly, which settles all pairs with the pivot.
3. *Recursion.* The pivot leaves; what is left of a region goes on with new pivots, unless all of it
   is already in one component. The distances to the first pivot bound the others: by the triangle
   inequality, two members of a region whose distances to it differ by more than ``t`` can't link, so
   a later pivot is compared only with the members inside its window.

Every pair that shares an anchor is thus compared, excluded by its sizes, the places of its first common
anchor (what stands before it isn't shared), the triangle inequality or the parities of its sets (which differ in no more bits than the sets in shingles), or known to be in one component; nothing else is dropped. Dense groups end after a round or two,
since all are linked through their pivots: the number of comparisons stays in proportion to the
number of anchors, not to the square of a group.

Shingles are 64-bit hashes (two equal ones by chance within one pair: 1 in 10^10 for texts of 20,000
words); class numbers are 64-bit hashes that are verified by 64 more bits, and drawn again with
another seed if two collide.

Empty and null texts have an empty set and link with nothing. Rows that share a doc_id are taken each
by itself. Repeated rows are one class, as are all documents with equal sets. A null doc_id is never the smallest
one, unless no other is in the component. Very long texts are read whole. Extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import sketch
from weftgraph.llm.common import Cut, give_back, settle

#: Bound of the list of frequent shingles that all tasks get (8 bytes each), and of what a task tells of its own.
FREQUENT, FREQUENT_OF_TASK, LEAST_FREQUENT = 1 << 19, 1 << 16, 8
#: Pivots of a region in the first round, in which dense regions end, and in those after it.
PIVOTS = (1, 64, 1024)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, least similarity in percent, seed of the hashes."""

    words: int = 5
    percent: int = 80
    seed: int = 0

    @property
    def distance(self) -> float:
        return 1 - self.percent / 100


class _Words(dict):
    """Hashes of words."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


_words: dict[int, _Words] = {}


def shingles(text: str | None, rule: Rule) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (A-Z in lower case, words split at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    cache = _words.setdefault(rule.seed, _Words(rule.seed))
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(rule.words, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h *= _C1
        h += w[i : len(w) - k + 1 + i]
    h += np.uint64(k)
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows in small numbers, and their texts, the last column; in the end the worker's memory of words goes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, part.column(part.num_columns - 1).to_pylist()
    _words.clear()
    give_back()


def frequent(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of all documents; at most ``FREQUENT``.

    Each task counts the shingles of its documents, keeps those found again, the most frequent when
    they are many, and the counts are added up. It bears on speed alone.
    """

    def run(batches):
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        found: list[np.ndarray] = []
        size = 0

        def add():
            nonlocal keys, counts, found, size
            k, c = np.unique(np.concatenate([*found, keys]), return_counts=True)
            c = c.astype(np.int64)
            c[np.searchsorted(k, keys)] += counts - 1
            keep = c > 1
            k, c = k[keep], c[keep]
            if len(k) > FREQUENT_OF_TASK:
                top = np.sort(np.argpartition(-c, FREQUENT_OF_TASK)[:FREQUENT_OF_TASK])
                k, c = k[top], c[top]
            keys, counts, found, size = k, c, [], 0

        for _, texts in _texts(batches):
            for t in texts:
                s = shingles(t, rule)
                found.append(s)
                size += len(s)
            if size > 2_000_000:
                add()
        if found:
            add()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])

    counts = Cut(docs.select("doc_id", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT), "frequent")
    sizes = counts.df.groupBy(sketch.bucket(F.col("n")).alias("code")).count().orderBy(F.desc("code")).collect()  # a few hundred buckets
    total, least = 0, None
    for code, n in sizes:
        total += n
        if total > FREQUENT:
            break
        least = code
    found = np.empty(0, np.int64)
    if least is not None:
        found = counts.df.where(sketch.bucket(F.col("n")) >= F.lit(least)).select("h").toArrow().column("h").to_numpy()
    counts.drop()
    return np.sort(found.astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, rule: Rule, late: np.ndarray) -> DataFrame:
    """doc_id, t (the text's hash), n, f1, f2, anchors, parity of every document.

    ``parity``: of n bits or more (a power of two), each the parity of the shingles that fall on it; two
    sets differ in at least as many shingles as their parities in bits. A task gives a class's
    anchors and parity once: copies in the same task have null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        last = shared.value
        seen: set[int] = set()
        for rows, texts in _texts(batches):
            ns, f1s, f2s, anchors, parities = [], [], [], [], []
            for t in texts:
                s = shingles(t, rule)
                n = len(s)
                f = xxhash.xxh3_128_intdigest(s.tobytes(), rule.seed)
                f1 = (f >> 64) - (1 << 63)
                ns.append(n), f1s.append(f1), f2s.append((f & (1 << 64) - 1) - (1 << 63))
                if n == 0 or f1 in seen:
                    anchors.append(None), parities.append(None)
                    continue
                seen.add(f1)
                bits = 64 << ((n - 1) // 64).bit_length()
                parities.append(np.packbits(np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1 != 0, bitorder="little").view(np.int64))
                k = n - (rule.percent * n + 99) // 100 + 1
                if len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    is_late = last[at] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                anchors.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(ns, pa.int64()), pa.array(f1s, pa.int64()), pa.array(f2s, pa.int64()), pa.array(anchors, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                names=["doc_id", "t", "n", "f1", "f2", "anchors", "parity"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, n long, f1 long, f2 long, anchors array<long>, parity array<long>")


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """f1, s: the whole sets, once in a task for each class."""

    def run(batches):
        seen: set[int] = set()
        for _, texts in _texts(batches, 100):
            f1s, sets = [], []
            for t in texts:
                s = shingles(t, rule)
                f1 = (xxhash.xxh3_128_intdigest(s.tobytes(), rule.seed) >> 64) - (1 << 63)
                if len(s) and f1 not in seen:
                    seen.add(f1)
                    f1s.append(f1), sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(f1s, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["f1", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "f1 long, s array<long>")


# -- components ------------------------------------------------------------------------------------
def components(edges: DataFrame) -> Cut:
    """node, root for every node of an edge: root is the smallest node of its component.

    Large-star and small-star steps in turn, to the fixpoint; each step is two joins over the edges
    and its result is written, so no neighbourhood is gathered anywhere.
    """
    e = Cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # stars: every u has one v, and no v is a u
        ends = e.df.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("s")).select("s.*")
        odd = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 OR (out > 0 AND least = 0)")
        if odd.isEmpty():
            return e
        both = e.df.union(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = Cut(small.select("e.*").where("u <> v").distinct(), "edges")
        e.drop()
        e = new
        settle(e.spark)


# -- the join --------------------------------------------------------------------------------------
#: Documents up to which their numbers and hashes may be broadcast (16 bytes each) to pick their texts.
BROADCAST_IDS = 1 << 20


def _halved(parity: Column) -> Column:
    """The parity of half as many bits."""
    half = (F.size(parity) / 2).cast("int")
    return F.zip_with(F.slice(parity, 1, half), F.slice(parity, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def _possible(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose parities don't exclude a link: sets that link differ in at most (1 - s) / (1 + s) of their sizes' sum."""
    a = classes.select(F.col("f1").alias("x"), F.col("n").alias("n_a"), F.col("parity").alias("a"))
    b = classes.select(F.col("f1").alias("p"), F.col("n").alias("n_b"), F.col("parity").alias("b"))
    both = pairs.join(a, "x").join(b, "p")
    # sizes of pairs differ by less than a factor of two, so their parities' lengths by one step at most
    fit = lambda own, other: F.when(F.size(own) > F.size(other), _halved(own)).otherwise(own)
    fitted = both.withColumns({"a2": fit(F.col("a"), F.col("b")), "b2": fit(F.col("b"), F.col("a"))})
    bits = F.aggregate(F.zip_with("a2", "b2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    return fitted.where(bits * (100 + rule.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - rule.percent)).select("x", "p")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> Cut:
    """x, p, common, together: the sizes of intersection and union of each pair's sets.

    Sets are made anew of the texts of the pairs' documents, one for each class.
    """
    ids = pairs.select(F.explode(F.array("x", "p")).alias("f1")).distinct().join(classes.select("f1", "first"), "f1").select(F.col("first.doc_id").alias("i"), F.col("first.t").alias("t"))
    few = pairs.count() * 2 <= BROADCAST_IDS
    hashed = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    texts = hashed.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("t")), "left_semi")
    sets = Cut(shingle_sets(texts, rule), "sets")
    a = sets.df.select(F.col("f1").alias("x"), F.col("s").alias("a"))
    b = sets.df.select(F.col("f1").alias("p"), F.col("s").alias("b"))
    sizes = pairs.join(a, "x").join(b, "p").select("x", "p", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), (F.size("a") + F.size("b")).cast("long").alias("both"))
    out = Cut(sizes.select("x", "p", "common", (F.col("both") - F.col("common")).alias("together")).distinct(), "checked")
    sets.drop()
    return out


def _grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """doc_id, t, n, f1 of every document; f1, root, rep, first of every class.

    rep is the class's smallest doc_id, first its first row: the smallest doc_id (null only if there is no other), the smallest hash of a text.
    """
    while True:
        late = frequent(docs, rule)
        sig = Cut(signatures(docs, rule, late), "signatures")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
        classes = Cut(sig.df.where("n > 0").groupBy("f1").agg(F.min("doc_id").alias("rep"), first, F.min("f2").alias("lo"), F.max("f2").alias("hi"), F.first("n").alias("n"), F.first("parity", ignorenulls=True).alias("parity")), "classes")
        if classes.df.where("lo <> hi").isEmpty():
            break
        sig.drop(), classes.drop()
        rule = Rule(rule.words, rule.percent, rule.seed + 1)
    roots = _class_roots(docs, rule, sig.df, classes.df)
    of = classes.df.select("f1", "rep", "first")
    if roots is None:
        of = of.withColumn("root", F.col("f1"))
    else:
        of = of.join(roots.df.withColumnsRenamed({"u": "f1", "v": "root"}), "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    return sig.df.select("doc_id", "t", "n", "f1"), of


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; component_id is the component's smallest doc_id."""
    rows, of = _grouped(docs, rule)
    linked = of.groupBy("root").agg(F.min("rep").alias("least"))
    out = rows.join(of.join(linked, "root").select("f1", "least"), "f1", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _class_roots(docs: DataFrame, rule: Rule, sig: DataFrame, classes: DataFrame) -> Cut | None:
    """u, v: each linked class and the root of its component; None if no classes link."""
    entries = sig.where("anchors is not null").select(F.posexplode("anchors").alias("at", "h"), F.col("f1").alias("x"), "n")
    # tables that are joined by an anchor are written first, so that a join can split an anchor with very many rows
    shared = Cut(entries.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "anchors")  # classes that several tasks told count more than once
    region = Cut(entries.join(shared.df, "h").select("h", "x", "n", "at", F.col("x").alias("root"), F.lit(None).cast("double").alias("far")), "regions")
    shared.drop()
    roots: Cut | None = None
    turn = 0
    while not region.df.isEmpty():
        # the pivots of each anchor's region: the first classes of those that are left
        order = Window.partitionBy("h").orderBy("x")
        chosen = region.df.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS[min(turn, len(PIVOTS) - 1)]).withColumn("last", F.max("x").over(Window.partitionBy("h")))
        leaders = Cut(chosen.select("h", "k", "last", F.col("x").alias("p"), F.col("n").alias("p_n"), F.col("at").alias("p_at"), F.col("root").alias("p_root"), F.col("far").alias("p_far")), "pivots")
        p = leaders.df.drop("k", "last")
        near = (F.col("x") > F.col("p")) & (F.col("root") != F.col("p_root"))
        near &= F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * rule.percent  # else the sizes alone exclude a link
        # a pair's first common anchor leaves so many shingles to share at most; each pair is seen in that anchor's region too
        near &= F.least(F.col("n") - F.col("at"), F.col("p_n") - F.col("p_at")) * (100 + rule.percent) >= (F.col("n") + F.col("p_n")) * rule.percent
        near &= F.coalesce(F.abs(F.col("far") - F.col("p_far")) <= rule.distance + 1e-9, F.lit(True))
        pairs = region.df.join(p, "h").where(near).select("x", "p").distinct()
        possible = Cut(_possible(pairs, classes, rule), "possible")
        checked = _verified(possible.df, docs, classes, rule)
        possible.drop()
        links = checked.df.where(F.col("common") * 100 >= F.col("together") * rule.percent).select(F.col("x").alias("u"), F.col("p").alias("v"))
        if not links.isEmpty():
            new = components(links if roots is None else links.union(roots.df.select("u", "v")))
            if roots is not None:
                roots.drop()
            roots = new
        # what is left: classes that weren't pivots, in regions that are not yet in one component
        left = region.df.join(leaders.df.where("k = 1").select("h", "last", "p"), "h").where("x > last").drop("last", "root")
        if roots is None:
            left = left.withColumn("root", F.col("x"))
        else:
            left = left.join(roots.df.select(F.col("u").alias("x"), "v"), "x", "left").withColumn("root", F.coalesce("v", "x")).drop("v")
        if turn == 0:
            far = checked.df.select("x", "p", (1 - F.col("common") / F.col("together")).alias("d"))
            left = left.join(far, ["x", "p"], "left").withColumn("far", F.col("d"))
        rest = Cut(left.select("h", "x", "n", "at", "root", "far"), "regions")
        open_regions = Cut(rest.df.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "anchors")
        new_region = Cut(rest.df.join(open_regions.df, "h"), "regions")
        for cut in (region, checked, leaders, rest, open_regions):
            cut.drop()
        region, turn = new_region, turn + 1
        settle(region.spark)
    region.drop()
    return roots


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents that are the first of their component, with all their columns.

    A document is a doc_id with a text: rows of one doc_id with texts that differ are judged each by its own
    component, rows without a doc_id by their texts; the first of a component has its smallest doc_id, then the
    smallest hash of a text. Documents without words all stay. Of repeated rows (one doc_id, one text) one stays.
    """
    rows, of = _grouped(docs, rule)
    first = of.groupBy("root").agg(F.min("first").alias("stays"))
    known = Cut(rows.where("n > 0").join(of.join(first, "root").select("f1", "stays"), "f1").select("doc_id", "t", "stays"), "known").df
    other = known.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("t") == F.col("stays.t"))))
    gone = other.select(F.col("doc_id").alias("__gone"), F.col("t").alias("__t")).distinct()
    here = docs["doc_id"].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    kept = docs.join(gone, here, "left_anti")
    repeated = rows.groupBy(F.col("doc_id").alias("__again"), F.col("t").alias("__t")).count().where("count > 1").select("__again", "__t")
    if repeated.isEmpty():
        return kept
    again = kept["doc_id"].eqNullSafe(F.col("__again")) & (F.xxhash64(kept["text"]) == F.col("__t"))
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
