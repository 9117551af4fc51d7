"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets base counts of its whole text. The rates derived from them go into quantile
sketches, one for each language, source and rate. A rate's upper fence is its third quartile plus
``SPREAD`` times the distance of the quartiles. Most rates are 0 in most documents, and their quartiles
with it; so the fence is never below the language's median plus ``SPREAD`` times the distance of its
``TAIL`` quantile. This floor is at most the rate's ``LEAST`` value, since junk may be in the tail, and
that value itself where the tail is at the median, so that equal documents don't reject ordinary
variation. The mean word length has a lower fence too. Fences shrink: those of n documents are averaged
with those of the next wider group (language and source, language, all documents: the same sketches,
merged), which weigh as much as ``PRIOR`` documents. So a small group mostly takes its language's
fences, a large one its own, without a size at which that turns. A document is kept if it doesn't fail
the base rules and every rate is within the fences of its language and source.

Null texts count as empty and fail the base rules; null languages and sources are groups of their
own. Very long texts are read whole. Repeated rows are judged each; ties don't matter, since fences
depend on counts only. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import sketch
from weftgraph.llm.common import Cut

#: Symbols whose share tells markup remains and tables; fixed by the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPREAD = 3
#: Documents as much as which the wider group's fences weigh.
PRIOR = 200
TAIL = 0.99
#: Per 1000 words (or lines, or characters): the floor of the fence is at most this.
LEAST = {"symbols": 100, "dup_lines": 500, "repeats": 400, "capitals": 300, "marks": 150, "word_chars": 10_000}
#: The fence of short words is never above this many characters per 1000 words.
MOST_SHORT = 3_000

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"
_WHITE = " \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, ...]:
    """The counts in ``METRICS`` of one text.

    Words are runs of anything but ASCII white space. n_repeat_words counts words in 3-word windows
    that occur twice or more, the first occurrence included.
    """
    if not text:
        return (0,) * 8
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = text.split("\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup_lines += 1
            elif line.strip(_WHITE):
                seen.add(line)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            upto = 0  # words before it are counted or not in a repeated window
            for i, x in enumerate(windows):
                if counts[x] > 1:
                    repeats += i + 3 - max(upto, i)
                    upto = i + 3
    return (
        n,
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeats,
        len(lines),
        sum(map(bytes.isupper, words)),
        text.count("!"),
    )


def _measure(batches: Iterator[pa.RecordBatch], text_of: int | None = None) -> Iterator[pa.RecordBatch]:
    """The columns with the counts of the last one, the text, instead of it; or all, and the counts of field ``text_of`` of the first."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts = part.column(part.num_columns - 1) if text_of is None else part.column(0).flatten()[text_of]
            own = part.num_columns - (text_of is None)
            counts = list(zip(*[measure(t) for t in texts.to_pylist()]))
            yield pa.RecordBatch.from_arrays([*part.columns[:own], *[pa.array(c, pa.int64()) for c in counts]], names=[*part.schema.names[:own], *[m.split()[0] for m in METRICS.split(", ")]])


def metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and the counts of every whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(_measure, f"{schema}, {METRICS}")


def rates() -> dict[str, Column]:
    """Whole-numbered rates per 1000; null where a document has no words."""
    per = lambda x, of: F.when(F.col(of) > 0, F.floor(F.col(x) * 1000 / F.col(of)))
    return {
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "n_words"),
        "marks": per("n_marks", "n_words"),
        "word_chars": per("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def fences(counts: DataFrame) -> DataFrame:
    """lang, source and a struct of fences: ``high_<rate>``, ``low_word_chars``.

    From documents that pass the base rules. One row for each language and source of ``counts``.
    """
    by_group = sketch.sketch(counts.where(~base_failed()), ["lang", "source"], rates())
    at = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "tail": TAIL}
    names = [*[f"high_{m}" for m in LEAST], "low_word_chars", *[f"floor_{m}" for m in LEAST]]

    def wide(s: DataFrame, keys: list[str], name: str) -> DataFrame:
        q = sketch.quantiles(s, keys, at)
        high = F.col("q3") + SPREAD * (F.col("q3") - F.col("q1"))
        low = F.col("q1") - SPREAD * (F.col("q3") - F.col("q1"))
        least = F.coalesce(*[F.when(F.col("metric") == m, F.lit(v)) for m, v in LEAST.items()])
        floor = F.when(F.col("tail") > F.col("mid"), F.least(F.col("mid") + SPREAD * (F.col("tail") - F.col("mid")), least)).otherwise(least)
        pick = lambda m, c: F.max(F.when(F.col("metric") == m, c))
        cells = [pick(m, high).alias(f"high_{m}") for m in LEAST] + [pick("word_chars", F.least(low, F.lit(MOST_SHORT))).alias("low_word_chars")] + [pick(m, floor).alias(f"floor_{m}") for m in LEAST]
        out = q.groupBy(*keys).agg(F.max("n").alias("n"), *cells)
        return out.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct("n", *names).alias(name))

    lang = sketch.merge(by_group, ["lang"])
    groups = counts.select("lang", "source").distinct()
    g, one, everything = wide(by_group, ["lang", "source"], "g"), wide(lang, ["lang"], "l"), wide(sketch.merge(lang, []), [], "a")
    joined = (
        groups.join(g, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
        .join(one, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
        .join(F.broadcast(everything), F.lit(True), "left")  # one row
    )

    def shrunk(name: str, *levels: str) -> Column:
        out = F.col(f"a.{name}")
        for level in levels:
            n = F.coalesce(F.col(f"{level}.n"), F.lit(0))
            out = (n * F.coalesce(F.col(f"{level}.{name}"), F.lit(0)) + PRIOR * out) / (n + PRIOR)
        return out

    highs = [F.greatest(shrunk(f"high_{m}", "l", "g"), shrunk(f"floor_{m}", "l")).alias(f"high_{m}") for m in LEAST]
    return joined.select("lang", "source", F.struct(*highs, shrunk("low_word_chars", "l", "g").alias("low_word_chars")).alias("fence"))


def within() -> Column:
    """Whether all rates are within ``fence``; a document without words or a group without fences is not judged by them."""
    out = F.lit(True)
    for m, rate in rates().items():
        out = out & F.coalesce(rate <= F.col(f"fence.high_{m}"), F.lit(True))
        if m == "word_chars":
            out = out & F.coalesce(rate >= F.col("fence.low_word_chars"), F.lit(True))
    return out


def judge(counts: DataFrame, fence: DataFrame) -> DataFrame:
    """``counts`` with base_failed and kept; the fences are joined by language and source."""
    f = fence.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "fence")
    joined = counts.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & within()).drop("f_lang", "f_source", "fence")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document.

    Texts are read once; the counts, some tens of bytes a document, are written to the shared folder,
    since both the sketches and the filter read them.
    """
    counts = Cut(metrics(docs, ["doc_id", "lang", "source"]), "quality").df
    return judge(counts, fences(counts)).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns.

    The counts are taken once for the fences (only the sketches stay of them) and again beside the
    texts, so that no text is shuffled or written.
    """
    fence = Cut(fences(metrics(docs, ["lang", "source"])), "fences").df
    kind = docs.schema.simpleString()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "source")
    text_of = [c.lower() for c in docs.columns].index("text")  # a text goes to Python once, within its row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _measure(batches, text_of)

    measured = rows.mapInArrow(run, f"row {kind}, lang {docs.schema['lang'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, {METRICS}")
    return judge(measured, fence).where("kept").select("row.*")
