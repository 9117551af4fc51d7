"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Method: every match of the split pattern is a word. A word's bytes are rows (word, position,
token). A recursive query joins neighbouring tokens with the merge table, contracts the word's
leftmost pair of minimum rank, and repeats until no pair is left. Decoding joins the ids of each
text, row by row, with the vocabulary and aggregates the bytes in order.

Where all equal pairs may be contracted at once (the new token forms no pair of a lower rank
with any neighbour, so that the next leftmost minimum would be the same pair again), one step
contracts all of them; otherwise it contracts the leftmost alone. Words of under ``LONG`` bytes need
few steps and take the leftmost pair alone in each; both rules give the same tokens (tested).

Texts are first cut into *units*, a run of white space and the run of other characters after it, so
that a unit met before needs no split and no query. No match of ``CUTTABLE`` goes on from another
character to white space or looks at white space after one, so the words of the units are the words of the text. With any other
pattern the whole text is one unit.

Null texts count as empty; an empty text has no tokens. Only the text column is read, so extra
columns of any name do no harm. Repeated rows give repeated results; an empty table an empty one.
Memory: texts are taken in runs of bounded size, a longer text in pieces of whole units, long words
in bounded numbers of steps; what is known of units and words is bounded, the frequent ones stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import give_back

#: The split pattern whose matches the units keep whole.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of Unicode's White_Space property; a fixed list.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_CUT = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
#: Characters of text handled together; units and words that a task remembers.
CHUNK_CHARS = 1 << 20
CACHE_UNITS, CACHE_WORDS = 200_000, 150_000
#: Steps of one recursive query; a longer word goes on from its last state.
STEPS = 48
#: Bytes of words put in one recursive query.
QUERY_BYTES = 1 << 17
#: Ids decoded by one query, and of one run of it.
DECODE_IDS = 1 << 18
#: Bytes of memory of a task's database, and for each byte of a longer word.
MEMORY, MEMORY_OF_BYTE = 128 << 20, 512

#: Bytes from which a word takes LONG_SQL, whose steps cost more but contract all equal pairs at once where that is safe.
LONG = 2048

#: A token's row stands at its last byte and knows its right neighbour (nxt: token, nxt_at: row; -1 for none).
#: The contracted token takes the right neighbour's row, so that one join with the word's best pair does each step.
STEP_SQL = """
WITH RECURSIVE state(step, word, pos, tok, nxt, nxt_at) AS (
    SELECT 0, word, pos, tok, nxt, nxt_at FROM start
  UNION ALL
    SELECT s.step + 1, s.word, s.pos,
           CASE WHEN s.pos = b.to_pos THEN b.merged ELSE s.tok END,
           CASE WHEN s.nxt_at = b.from_pos THEN b.merged ELSE s.nxt END,
           CASE WHEN s.nxt_at = b.from_pos THEN b.to_pos ELSE s.nxt_at END
    FROM state s
    JOIN (SELECT word, (best >> 46)::INT AS merged, ((best >> 23) & 8388607)::INT AS from_pos, (best & 8388607)::INT AS to_pos
          FROM (SELECT p.word, min((m.merged::BIGINT << 46) + (p.pos::BIGINT << 23) + p.nxt_at) AS best
                FROM state p JOIN merges m ON m.l = p.tok AND m.r = p.nxt
                WHERE p.step < {steps} GROUP BY p.word)) b
      ON s.word = b.word AND s.pos <> b.from_pos
)
SELECT word, pos, tok, nxt, nxt_at, step FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
"""

LONG_SQL = """
WITH RECURSIVE state(step, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM start
  UNION ALL
    SELECT step + 1, word, pos, CASE WHEN contract THEN merged ELSE tok END
    FROM (
        SELECT *, lag(contract, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten
        FROM (
            SELECT *, merged IS NOT NULL AND merged = best
                      AND (CASE WHEN alone THEN nth = 1 ELSE (row_number() OVER (PARTITION BY word, merged, idx - nth ORDER BY pos)) % 2 = 1 END) AS contract
            FROM (
                SELECT *, row_number() OVER (PARTITION BY word, merged ORDER BY pos) AS nth
                FROM (
                    SELECT p.step, p.word, p.pos, p.tok, p.idx, m.merged, m.alone, min(m.merged) OVER (PARTITION BY p.word) AS best
                    FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS idx
                          FROM state WHERE step < {steps} WINDOW w AS (PARTITION BY word ORDER BY pos)) p
                    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt)
                WHERE best IS NOT NULL)))
    WHERE NOT eaten
)
SELECT word, pos, tok, step FROM state QUALIFY step = max(step) OVER (PARTITION BY word)
"""


class _Known(dict):
    """Numbers of texts (units or words) in the order in which they are met, and the ids of each by its number."""

    def __init__(self, most: int):
        self.most = most
        self.new: list[str] = []
        self.flat, self.starts, self.lengths, self.used = np.empty(0, np.int32), *[np.empty(0, np.int64) for _ in range(3)]

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self)
        self.new.append(text)
        return n

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the texts in ``new``."""
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lengths) - lengths]
        self.flat, self.lengths = np.r_[self.flat, flat], np.r_[self.lengths, lengths]
        self.used = np.r_[self.used, np.zeros(len(lengths), np.int64)]
        self.new = []

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered texts, one after another, and how many each has."""
        self.used += np.bincount(at, minlength=len(self.used))
        lengths = self.lengths[at]
        return self.flat[_spans(self.starts[at], lengths)], lengths

    def trim(self) -> None:
        """Over its bound, the half that was used most stays."""
        if len(self) <= self.most:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        texts = list(self)
        self.clear()
        for n, k in enumerate(keep.tolist()):
            self[texts[k]] = n
        lengths = self.lengths[keep]
        self.flat = self.flat[_spans(self.starts[keep], lengths)]
        self.starts, self.lengths, self.used = np.cumsum(lengths) - lengths, lengths, self.used[keep] // 2


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each span, one span after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


class Codec:
    """A task's tables of a rank file, and what it knows of units and words."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY >> 20}MB", "preserve_insertion_order": False})
        self.memory = MEMORY
        self.db.execute("SET temp_directory = ''")
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pairs = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.db.register("pairs", pairs)
        self.db.execute("""
            CREATE TABLE merges AS
            SELECT l, r, merged, coalesce(low <= merged, false) AS alone FROM pairs
            LEFT JOIN (SELECT tok, min(rank) AS low FROM (
                SELECT l AS tok, merged AS rank FROM pairs UNION ALL SELECT r, merged FROM pairs) GROUP BY tok) ON tok = merged""")
        self.db.unregister("pairs")
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        self.db.register("given", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, bytes FROM given")
        self.db.unregister("given")
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.cuttable = pattern == CUTTABLE
        self.units, self.words = _Known(CACHE_UNITS), _Known(CACHE_WORDS)

    # -- encoding ------------------------------------------------------------------------------
    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.fromiter((self.ranks.get(b, -1) for b in coded), np.int64, len(coded))
        direct = np.flatnonzero(whole >= 0)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        rest = np.flatnonzero(whole < 0)
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        # as they are found: numbers of words, how many ids each has, the ids
        found = [(direct, np.ones(len(direct), np.int64), whole[direct].astype(np.int32))]
        i = 0
        while i < len(rest):
            long = sizes[rest[i]] >= LONG
            upto = np.searchsorted(np.cumsum(sizes[rest[i:]]), QUERY_BYTES, "right")
            j = i + max(1, int(upto))
            if not long:
                j = min(j, int(np.searchsorted(sizes[rest], LONG)))
            else:
                self._allow(int(sizes[rest[j - 1]]))
            part = rest[i:j]
            found += [(part[w], n, tok) for w, n, tok in self._recursion([coded[k] for k in part.tolist()], sizes[part], bool(long))]
            i = j
        at, counts, flat = (np.concatenate(x) for x in zip(*found))
        starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[at], lengths[at] = np.cumsum(counts) - counts, counts
        return flat[_spans(starts, lengths)], lengths

    def _allow(self, size: int) -> None:
        """Memory for a word of this size; other words never need more than ``MEMORY``."""
        need = max(MEMORY, MEMORY_OF_BYTE * size)
        if need > self.memory:
            self.db.execute(f"SET memory_limit = '{need >> 20}MB'")
            self.memory = need

    def _recursion(self, words: list[bytes], lengths: np.ndarray, long: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of words, how many ids each has, and their ids, as they are done."""
        data = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        state = {"word": word, "pos": pos, "tok": data}
        if not long:
            last = np.cumsum(lengths) - 1
            nxt, at = np.r_[data[1:], np.int32(-1)], pos + np.int32(1)
            nxt[last], at[last] = -1, -1
            state |= {"nxt": nxt, "nxt_at": at}
        columns = list(state)
        state = pa.table(state)
        sql = (LONG_SQL if long else STEP_SQL).format(steps=STEPS)
        while state.num_rows:
            self.db.register("start", state)
            out = self.db.sql(sql).to_arrow_table()
            self.db.unregister("start")
            done = out.column("step").to_numpy() < STEPS
            w, at, tok = (out.column(c).to_numpy()[done].astype(np.int64) for c in ("word", "pos", "tok"))
            if len(w):
                order = np.argsort((w << 32) | at)
                w, counts = np.unique(w[order], return_counts=True)
                yield w, counts.astype(np.int64), tok[order].astype(np.int32)
            state = out.filter(pa.array(~done)).select(columns)

    def _learn(self) -> None:
        """The ids of the new units."""
        self.words.trim()
        found = [self.pattern.findall(u) for u in self.units.new]
        of = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, int(of.sum()))
        if self.words.new:
            self.words.add(*self.encode_words(self.words.new))
        flat, lengths = self.words.ids(at)
        self.units.add(flat, np.add.reduceat(lengths, np.cumsum(of) - of))

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of texts (little-endian unsigned 32-bit integers) and the bytes that these ids decode to."""
        ids: list[bytes] = [b""] * len(texts)
        for group in _groups(texts, self.cuttable):
            for k, part in zip((k for k, _ in group), self._encode([p for _, p in group])):
                ids[k] = ids[k] + part if ids[k] else part
        return ids, self.decode(ids)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece of a text."""
        self.units.trim()
        number = self.units.__getitem__
        numbers: list[int] = []
        ends = []
        for p in pieces:
            numbers += map(number, _UNIT.findall(p) if self.cuttable else [p])
            ends.append(len(numbers))
        if self.units.new:
            self._learn()
        flat, lengths = self.units.ids(np.array(numbers, dtype=np.int64))
        raw = flat.tobytes()
        upto = np.r_[0, np.cumsum(lengths) * 4][ends].tolist()
        return [raw[s:e] for s, e in zip([0, *upto], upto)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        return self.encode_decode(texts)[0]

    # -- decoding ------------------------------------------------------------------------------
    def _aggregate(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of runs of ids, by ordered aggregation over (run, position, id) rows."""
        lengths = np.array([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        rows = pa.table({"run": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(flat), dtype=np.int32), "id": flat})
        self.db.register("rows", rows)
        found = self.db.sql("SELECT run, string_agg(bytes, '') AS bytes FROM (SELECT run, bytes FROM rows JOIN vocabulary USING (id) ORDER BY pos) GROUP BY run").to_arrow_table()
        self.db.unregister("rows")
        out = [b""] * len(ids)
        for i, text in zip(found.column("run").to_pylist(), found.column("bytes").to_pylist()):
            out[i] = text.encode("latin-1")
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of any token ids (little-endian unsigned 32-bit integers); long ones in runs of bounded size."""
        runs = [raw[k : k + 4 * DECODE_IDS] for raw in ids for k in range(0, len(raw), 4 * DECODE_IDS)]
        found: list[bytes] = []
        i = 0
        while i < len(runs):
            j, size = i, 0
            while j < len(runs) and (j == i or size + len(runs[j]) <= 4 * DECODE_IDS):
                size += len(runs[j])
                j += 1
            found += self._aggregate(runs[i:j])
            i = j
        parts = iter(found)
        return [b"".join([next(parts) for _ in range(0, len(raw), 4 * DECODE_IDS)]) for raw in ids]


def _groups(texts: list[str], cuttable: bool) -> Iterator[list[tuple[int, str]]]:
    """Numbers and pieces of texts, about ``CHUNK_CHARS`` together; texts are cut only between units."""
    group: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK_CHARS) if cuttable and len(text) - at > CHUNK_CHARS else None
            piece = text[at : cut.start() if cut else len(text)]
            group.append((k, piece))
            at, size = at + len(piece), size + len(piece)
            if size >= CHUNK_CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


@contextmanager
def codec(ranks_path: str, pattern: str) -> Iterator[Codec]:
    """A task's codec; its memory goes with the task, since the worker's next one may be of another kind."""
    c = Codec(ranks_path, pattern)
    try:
        yield c
    finally:
        c.db.close()
        c.units.clear(), c.words.clear()
        del c
        give_back()


def _texts(batches: Iterator[pa.RecordBatch], c: Codec, rows: int = 500) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """Keys, ids and decoded bytes of the rows (key, text), in runs of bounded size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            keys, texts = part.column(0), ["" if t is None else t for t in part.column(1).to_pylist()]
            for i, j in _chunks(texts):
                yield keys[i:j], *c.encode_decode(texts[i:j])


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ends of runs of texts whose results are sent together."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text.

    Returns the id column, ``ids`` (binary: little-endian unsigned 32-bit integers), ``decoded`` (binary).
    """
    field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for keys, ids, decoded in _texts(batches, c):
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    out = docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]).mapInArrow(run, f"id {field.dataType.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every document, by ``encode_decode``'s codec.

    The digests are taken where the ids are made, so that no ids go through the JVM twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for keys, ids, decoded in _texts(batches, c):
                columns = [
                    keys,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
