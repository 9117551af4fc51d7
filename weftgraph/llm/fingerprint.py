"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its low bits are all ones; the
number of bits is the block size's power of two. Each chunk gives two characters of a signature. A
fingerprint holds the smallest block size that gives at most ``MOST`` chunks, the signature at that
block size and the signature at twice that: ``<power>:<signature>:<signature>``. Two fingerprints
are compared at the block sizes that both have, by the edit distance (insertions and deletions) of
their chunk sequences; fingerprints whose block sizes differ by more than a factor of two share none
and have likeness 0. If even the largest block size leaves too many chunks (periodic texts), the
last chunk takes the rest, so the whole text counts in any case.

Null texts count as empty; the empty text has the fingerprint ``0::`` and is like itself only. Equal
texts have equal fingerprints and likeness 1. Very long texts cost time and memory in proportion.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MOST, LEAST_POWER, MOST_POWER = 7, 64, 1, 30
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in DIGITS for b in DIGITS]
_FACTOR = np.uint32(0x9E3779B1)


def _levels(data: np.ndarray) -> np.ndarray:
    """For each byte, how many low bits of the rolling hash there are ones."""
    n = len(data)
    mixed = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    padded = np.zeros(n + WINDOW - 1, dtype=np.uint32)
    padded[WINDOW - 1 :] = mixed
    roll = padded[:n].copy()
    for k in range(1, WINDOW):
        roll *= _FACTOR
        roll += padded[k : k + n]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0xC2B2AE35)
    roll ^= roll >> np.uint32(16)
    return ~roll & (roll + np.uint32(1))  # the lowest zero bit


def _signature(raw: bytes, ends: list[int]) -> str:
    if len(ends) > MOST:
        ends = ends[: MOST - 1]
    if not ends or ends[-1] != len(raw):
        ends = [*ends, len(raw)]
    h = xxhash.xxh32_intdigest
    at, out = 0, []
    for e in ends:
        out.append(_PAIRS[h(raw[at:e]) & 4095])
        at = e
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text (its UTF-8 bytes)."""
    if not text:
        return "0::"
    raw = text.encode("utf-8", "surrogatepass")
    low = _levels(np.frombuffer(raw, dtype=np.uint8))
    # a position ends chunks at every power up to its own; few positions are left after the first powers
    power = LEAST_POWER
    guess = max(LEAST_POWER, (len(raw) // (4 * MOST)).bit_length() - 1)
    at = np.flatnonzero(low >= np.uint32(1 << guess))
    if len(at) <= MOST and guess > LEAST_POWER:
        guess = LEAST_POWER
        at = np.flatnonzero(low >= np.uint32(1 << guess))
    power = guess
    strength = low[at]
    while len(at) > MOST and power < MOST_POWER:
        power += 1
        keep = strength >= np.uint32(1 << power)
        at, strength = at[keep], strength[keep]
    coarse = at[strength >= np.uint32(1 << (power + 1))]
    return f"{power}:{_signature(raw, (at + 1).tolist())}:{_signature(raw, (coarse + 1).tolist())}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the bits of a whole number as the row."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = where.get(x)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _like(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = [a[k : k + 2] for k in range(0, len(a), 2)], [b[k : k + 2] for k in range(0, len(b), 2)]
    return 2 * _common(x, y) / (len(x) + len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    """1 less the edit distance of two fingerprints as a share of their chunks: 0 to 1."""
    if a == b:
        return 1.0
    pa_, a1, a2 = a.split(":")
    pb, b1, b2 = b.split(":")
    p, q = int(pa_), int(pb)
    if p == q:
        return max(_like(a1, b1), _like(a2, b2))
    if p + 1 == q:
        return _like(a2, b1)
    if q + 1 == p:
        return _like(a1, b2)
    return 0.0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


# -- the edited texts of the contract --------------------------------------------------------------
def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    new_mark = mark if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, text, guest), sorted; a guest is the next range's first document."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    rows: list[tuple] = []
    before = None  # range, doc_id, text, fingerprint of a row that waits for the next one
    for b in batches:
        for k in range(0, b.num_rows, 200):
            for at, doc_id, text, guest in zip(*(c.to_pylist() for c in b.slice(k, 200).columns)):
                text = text or ""
                mark = fingerprint(text)
                if before and before[0] == at:
                    rows.append(_row(*before[1:], text, mark))
                before = None if guest else (at, doc_id, text, mark)
            if rows:
                yield batch(rows)
                rows = []


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or under doc_id: a search in blocks of cuts, then in one block."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= doc_id))
    block = upto(longs([b[0] for b in blocks]))
    return F.when(doc_id.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + upto(F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(block, F.lit(1)))))


def edited_digests(docs: DataFrame, rows_per_range: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next by doc_id (null first, repeated numbers by text), after the last
    the first. Documents are cut into ranges at doc_ids that split them about evenly; each range is
    sorted and read as a stream that holds two documents. The documents at a cut are also sent, as
    guests, to the end of the range before it, the first of all to the end of the last. So texts are
    shuffled once, and no range waits for another.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, least, some = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.count("doc_id")).first()
    parts = max(1, min(n // rows_per_range, 20_000))
    cuts: list[int] = []
    if parts > 1 and some:
        found = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        cuts = sorted({c for c in found if c > least or some < n})
    last = len(cuts)
    first_of_all = F.col("doc_id").isNull() if some < n else F.col("doc_id") == F.lit(least)
    at = _range_of(F.col("doc_id"), cuts)
    before = F.when(F.col("doc_id").isin(cuts), F.col("own") - 1) if cuts else F.lit(None).cast("int")
    places = F.array(
        F.struct(F.col("own").alias("at"), F.lit(False).alias("guest")),
        F.struct(before.cast("int").alias("at"), F.lit(True).alias("guest")),
        F.struct(F.when(first_of_all, F.lit(last)).cast("int").alias("at"), F.lit(True).alias("guest")),
    )
    sent = rows.withColumn("own", at.cast("int")).select("doc_id", "text", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("place"))
    ranged = sent.select(F.col("place.at").alias("at"), "doc_id", "text", F.col("place.guest").alias("guest"))
    return ranged.repartition(last + 1, "at").sortWithinPartitions("at", "guest", "doc_id", "text").mapInArrow(_with_next, _COLUMNS)
