"""Line dedup by a log-template tree, with DataFrame functions only.

Every line is parsed down a tree of fixed depth: its number of tokens, then its ``LEADING`` leading
tokens; tokens with a digit are variable fields and count as ``<*>``. Lines of a leaf with equal tokens
are an *exact* template. A leaf's templates are generalised further by position: the line is cut into
``SEGMENTS`` runs of tokens, and each choice of ``CONSTANT`` of them is a *general* template, whatever the
others hold and however often their values recur. So two lines of a leaf match if their similarity, by
runs, is that high. Lines of fewer than ``GENERAL_LEAST`` tokens are generalised by single tokens: one of
them may vary, from ``TWO_LEAST`` on two, any of them. Such a line is in several leaves: it is cut into one
part more than may vary, and each part, with the number of tokens, is a leaf, whose templates hold that
part. A template that recurs in two or more documents is dropped from all of them.

Documents are told apart by their texts: copies of one text are one document. Near copies of whole
documents are no recurring lines either but the business of document dedup. A template's *leader* is the
first (by hash) text that holds it; a text with ``SAME`` of its tokens in lines of one leader is a near
copy of it, and counts as that document. So copies stay whole, unless a template also occurs in a
document outside of the group.

Lines of fewer than ``SHORT`` tokens recur by chance, as do general templates of fewer constant words;
they are dropped if they stand in ``SHORT_SHARE`` of all texts (and in two), at every size of the table alike.
A line of mostly variable fields has its raw text as its only template. Blank lines stay.

Null texts stay null; empty texts stay empty. The doc_id isn't read, so null and repeated ones are
nothing special. Repeated rows give repeated results. Very long texts are handled line by line. Extra
columns are kept; their names may not start with ``__``. An empty table gives an empty one. All of it is
counts, minima and maxima by key, combined before the shuffle, and joins of written tables, which can be
split, so no line or leaf that a third of all documents share meets in one task. Templates, texts and
leaves are 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import Cut, settle

LEADING, SEGMENTS, CONSTANT, GENERAL_LEAST, TWO_LEAST = 3, 8, 6, 12, 8
SHORT, SHORT_SHARE, SAME = 5, 0.005, 0.8
#: A digit, or white space other than the space.
_SPECIAL = r"[0-9\x09\x0B-\x0D]"
_RUNS = [f"run{i}" for i in range(SEGMENTS)]


def _parts(n: int) -> list[tuple[int, int]]:
    """First and last token of each part of a line of ``n`` tokens, fewer than ``GENERAL_LEAST``."""
    k = 3 if n >= TWO_LEAST else 2
    return [(n * i // k, n * (i + 1) // k - 1) for i in range(k)]


def _lines(docs: DataFrame) -> DataFrame:
    """row, pos, n, exact, leaf, run0 and so on, words of each line; n is 0 for blank ones.

    leaf and runs are null but for lines of ``GENERAL_LEAST`` tokens or more, words (hashes) but for shorter ones that
    have general templates. Nearly all lines take the plain way: no digit, spaces only. The expressions are kept small,
    since the JVM doesn't compile very long methods.
    """
    exploded = docs.select(F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where("raw <> ''")
    spaced = F.regexp_replace("raw", r"[\x09\x0B-\x0D]", " ")
    masked = F.when(F.col("raw").rlike(_SPECIAL), F.regexp_replace(spaced, "[^ 0-9]*+[0-9][^ ]*+", "<*>"))
    parsed = exploded.select("row", "pos", "raw", masked.alias("masked")).withColumn("tokens", F.array_remove(F.split(F.coalesce("masked", "raw"), " "), ""))
    fields = F.coalesce(F.length("masked") - F.length(F.replace("masked", F.lit("<*>"), F.lit(""))), F.lit(0))  # times 3
    kinds = parsed.select("row", "pos", "raw", "tokens", F.size("tokens").alias("n"), fields.alias("fields")).withColumn("variable", F.col("fields") * 2 > F.col("n") * 3)
    long, short = f"NOT variable AND n >= {GENERAL_LEAST}", f"NOT variable AND n BETWEEN {SHORT} AND {GENERAL_LEAST - 1}"
    # run i of the line: tokens from i n / SEGMENTS up to (i + 1) n / SEGMENTS, rounded down
    run = "CASE WHEN {long} THEN hash(slice(tokens, n * {i} div {k} + 1, n * ({i} + 1) div {k} - n * {i} div {k})) END"
    return kinds.select(
        "row",
        "pos",
        "n",
        F.when(F.col("variable"), F.xxhash64(F.lit(1), "raw")).otherwise(F.xxhash64("tokens")).alias("exact"),
        F.when(F.expr(long), F.xxhash64("n", F.slice("tokens", 1, LEADING))).alias("leaf"),
        *[F.expr(run.format(long=long, i=i, k=SEGMENTS)).alias(r) for i, r in enumerate(_RUNS)],
        F.when(F.expr(short), F.transform("tokens", lambda t: F.hash(t))).alias("words"),
    )


def _short_choices(spark: SparkSession) -> DataFrame:
    """kind, part, a, b: the tokens (b may be null) that a general template of a line of ``kind`` tokens leaves out in the leaf of a part."""
    rows = []
    for n in range(SHORT, GENERAL_LEAST):
        for part, (first, last) in enumerate(_parts(n)):
            free = [i for i in range(n) if not first <= i <= last]
            rows += [(n, part, *x) for x in (itertools.combinations(free, 2) if n >= TWO_LEAST else [(i, None) for i in free])]
    values = ", ".join(f"({kind}, {part}, {a}, {'CAST(NULL AS INT)' if b is None else b})" for kind, part, a, b in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(kind, part, a, b)"))  # some 100 rows


_RECURS = "a < b AND x < y"


def _several() -> list[Column]:
    """Of templates that hold a key: the first and last text, and template."""
    return [F.min("first").alias("a"), F.max("last").alias("b"), F.min("exact").alias("x"), F.max("exact").alias("y")]


def _in_leaves(parsed: DataFrame) -> DataFrame:
    """The rows (leaf, exact, first, last and others) of leaves with several templates in several texts."""
    leaves = Cut(parsed.groupBy("leaf").agg(*_several()).where(_RECURS).select("leaf"), "leaves")
    return parsed.join(leaves.df, "leaf", "left_semi")


def _general(lines: DataFrame, templates: DataFrame) -> Cut:
    """g, few, exact, first, last: the general templates (with the leaf in them) of each exact one, if the leaf has others.

    ``few`` tells those with fewer than ``SHORT`` constant words. A key is the exclusive or of its runs' hashes, with their places.
    """
    spark, tell = lines.sparkSession, ["exact", "first", "last"]
    hashed = lambda i, x: F.xxhash64(i, x)
    choices = f"array({', '.join(f'named_struct({a!r}, {i}, {b!r}, {j})' for a, b in ['ab'] for i, j in itertools.combinations(range(SEGMENTS), SEGMENTS - CONSTANT))})"
    long = _in_leaves(templates.where("leaf is not null").select("leaf", *tell, *_RUNS))
    whole = functools.reduce(Column.bitwiseXOR, [hashed(F.lit(i), F.col(r)) for i, r in enumerate(_RUNS)])
    long = long.select("leaf", *tell, whole.alias("whole"), F.array(*_RUNS).alias("runs"), F.explode(F.expr(choices)).alias("c")).select("*", "c.a", "c.b")
    words = lines.where("words is not null").groupBy("exact").agg(F.first("words").alias("runs"))
    of_part = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(part).alias("part"), F.lit(a + 1).alias("at"), F.lit(b - a + 1).alias("size")) for k in range(SHORT, GENERAL_LEAST) for part, (a, b) in enumerate(_parts(k))])
    short = templates.join(words, "exact").select(*tell, "runs", F.size("runs").alias("kind"), F.explode(of_part).alias("p")).where("p.k = kind")
    short = short.select(F.xxhash64("kind", "p.part", F.slice("runs", F.col("p.at"), F.col("p.size"))).alias("leaf"), *tell, "runs", "kind", F.col("p.part").alias("part"))
    constant = lambda x: (x != F.hash(F.lit("<*>"))).cast("int")
    counted = F.aggregate("runs", F.lit(0), lambda t, x: t + constant(x))
    folded = F.aggregate(F.transform("runs", lambda x, i: hashed(i, x)), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x))
    short = _in_leaves(short).withColumns({"whole": folded, "constants": counted}).join(_short_choices(spark), ["kind", "part"])
    out = lambda c: F.coalesce(hashed(c, F.get("runs", c)), F.lit(0))
    left = F.when(F.col("b").isNull(), F.lit(0)).otherwise(out(F.col("b")))
    g = F.xxhash64("leaf", F.col("whole").bitwiseXOR(out(F.col("a"))).bitwiseXOR(left)).alias("g")
    rest = F.col("constants") - constant(F.get("runs", F.col("a"))) - F.coalesce(constant(F.get("runs", F.col("b"))), F.lit(0))
    keyed = long.select(g, F.lit(False).alias("few"), *tell).union(short.select(g, (rest < SHORT).alias("few"), *tell))
    return Cut(keyed, "general")


def _recurring(templates: DataFrame, general: DataFrame, often: DataFrame) -> Cut:
    """exact, leader: the templates that recur, themselves or by a general template, and the first text that holds one.

    Keys that recur are written before they are joined, so that a join can split a very frequent one. ``often`` has
    the general templates of few words (as g) and short ones (as exact) that are frequent enough.
    """
    keys = general.where("NOT few").groupBy("g").agg(*_several()).where(_RECURS).select("g", F.col("a").alias("leader"))
    few = general.where("few").groupBy("g").agg(*_several()).where(_RECURS).join(often, "g", "left_semi").select("g", F.col("a").alias("leader"))
    keys = Cut(keys.union(few), "keys")
    by_general = general.join(keys.df, "g").select("exact", "leader")
    long = templates.where(f"n >= {SHORT} AND first < last").select("exact", F.col("first").alias("leader"))
    short = templates.where(f"n < {SHORT} AND first < last").join(often, F.col("exact") == F.col("g"), "left_semi").select("exact", F.col("first").alias("leader"))
    out = Cut(by_general.union(long).union(short).groupBy("exact").agg(F.min("leader").alias("leader")), "recurring")
    keys.drop()
    return out


def _often(lines: DataFrame, general: DataFrame, least: float) -> Cut:
    """g: short templates, and general ones of few words, that stand in ``least`` texts or more, each counted once."""
    short = lines.where(F.col("n") < SHORT).select(F.col("exact").alias("g"), "row")
    few = general.where("few").select("g", "exact").join(lines.where("words is not null").select("exact", "row").distinct(), "exact").select("g", "row")
    counts = short.union(few).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    return Cut(counts.where((F.col("k") >= 2) & (F.col("k") >= least)).select("g"), "often")


def recurring_lines(docs: DataFrame) -> Cut:
    """row, drop: the numbers (from 0) of the lines that each text loses; row is the text's hash."""
    lines = Cut(_lines(docs), "lines")
    some = lines.df.where("n > 0")
    same = [F.first(c).alias(c) for c in ["n", "leaf", *_RUNS]]
    templates = Cut(some.groupBy("exact").agg(*same, F.min("row").alias("first"), F.max("row").alias("last")), "templates")
    general = _general(some, templates.df)
    texts = Cut(some.groupBy("row").agg(F.sum("n").alias("all")), "texts")
    often = _often(some, general.df, SHORT_SHARE * texts.df.count())
    recurring = _recurring(templates.df, general.df, often.df)
    # copies of a text have each of its lines as often as the text, so shares are those of one
    again = Cut(some.select("exact", "row", "pos", "n").join(recurring.df, "exact"), "again")
    led = again.df.groupBy("row", "leader").agg(F.sum("n").alias("k")).groupBy("row").agg(F.max(F.struct("k", "leader")).alias("most"))
    copies = Cut(led.join(texts.df, "row").where((F.col("most.k") >= SAME * F.col("all")) & (F.col("most.leader") != F.col("row"))).select("row", F.col("most.leader").alias("unit")), "copies")
    # once more, with near copies as the document they are copies of
    units = again.df.select("exact", "row").distinct().join(copies.df, "row", "left").select("exact", F.coalesce("unit", "row").alias("unit"))
    held = Cut(units.groupBy("exact").agg(F.min("unit").alias("first"), F.max("unit").alias("last")), "held")
    by_unit = templates.df.select("exact", "n").join(held.df, "exact")
    general_by_unit = Cut(general.df.select("g", "few", "exact").join(held.df, "exact"), "general")
    gone = _recurring(by_unit, general_by_unit.df, often.df)
    lost = again.df.join(gone.df.select("exact"), "exact", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("drop"))
    out = Cut(lost, "lost")
    for cut in (lines, templates, general, texts, often, recurring, again, copies, held, general_by_unit, gone):
        cut.drop()
    settle(out.spark)
    return out


def drop_recurring(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents with ``text`` less its recurring lines, and two counts under the given names; other columns as they were."""
    lost = recurring_lines(docs).df.withColumnsRenamed({"row": "__row", "drop": "__drop"})
    keyed = docs.withColumn("__row", F.xxhash64("text"))
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text: Column = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i))))
    # the small side is hashed, so that texts need not be sorted
    out = keyed.join(lost.hint("shuffle_hash"), "__row", "left").withColumns(
        {"__text": text, "__n": F.when(F.col("text").isNotNull(), F.size(lines)), "__k": F.when(F.col("text").isNotNull(), F.coalesce(F.size("__drop"), F.lit(0)))}
    )
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.col("__n").alias(n_lines), F.col("__k").alias(n_dropped))
