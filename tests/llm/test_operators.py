"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import collections
import hashlib
import itertools
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chat, fingerprint, html, jaccard, licenses, lines, mixing, quality, sharding, sketch

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n", "h", "s", "x", "row", "pos", "drop", "size", "block", "shard", "n_words", "n_lines", "n_dropped", "kept", "fence", "at", "guest", "ids"]


VOCABULARY = ["".join(x) for x in itertools.product("bdfgklm", "aeiou", "nrst", "ao")]


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", *VOCABULARY]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white texts, repeated rows, one doc_id twice, a very long text, clashing columns."""
    rng = random.Random(1)
    base = [words(rng, 60 + 20 * k) for k in range(6)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [
        (10, None, "en", "s0", None),
        (11, "", None, None, 0),
        (12, " \n\t ", "en", None, 4),
        (None, base[0] + " tail", None, "s1", 1),
        (13, base[1], "de", "s1", 1),
        (13, base[1], "de", "s1", 1),
        (14, base[2], "en", "s2", 1),
        (14, words(rng, 80), "en", "s2", 1),
        (15, words(rng, 30_000), "en", "s2", 1),
        (16, "é" * 3000 + "\n" + "a" * 2000, "fr", "s2", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- 1 ---------------------------------------------------------------------------------------------
def lcs_like(a, b):
    """Longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_licenses(spark, odd, empty):
    mit = licenses.TEMPLATES["MIT"]
    rng = random.Random(2)
    edited = " ".join(w for w in mit.split() if rng.random() > 0.05)
    cases = {
        "x " * 50 + mit + " y": "MIT",
        words(rng, 300) + "\n" + edited + "\n" + words(rng, 50): "MIT",
        words(rng, 40) + "\nReleased under the MIT License.\n" + words(rng, 40): "MIT-notice",
        "Released under the MIT License.\n" * 3: "MIT-notice",
        words(rng, 500): None,
        "the software is a work of the public and rights": None,
    }
    for text, want in cases.items():
        found = licenses.scan(text)
        assert (found[0][0] if found else None) == want, text[:80]
        for name, coverage, a, b in found:
            tpl = licenses.words(licenses.TEMPLATES[name])
            assert licenses.LEAST <= coverage <= lcs_like(licenses.words(text[a:b]), tpl) / len(tpl) + 1e-9
    for _ in range(50):
        a, b = [rng.choice("abcdefgh") for _ in range(12)], [rng.choice("abcdefgh") for _ in range(9)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs_like(a, b)
    assert licenses.scan_documents(odd).count() == odd.count() and licenses.scan_documents(empty).count() == 0


def test_every_find_of_a_license():
    rng = random.Random(16)
    for name, text in licenses.TEMPLATES.items():
        found = licenses.scan(f"{words(rng, 30)} {text} {words(rng, 30)}")
        assert found[0][:2] == (name, 1.0), (name, found)
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    for between in ("", words(rng, 5), words(rng, 900)):
        found = licenses.scan(f"{words(rng, 20)} {mit} {between} {cut} {between} {bsd} {between} {mit}")
        spans = sorted((a, b) for n, _, a, b in found if n == "MIT")
        assert len(spans) == 3 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and found[0][0] == "BSD-3-Clause"
    for n in (1, 2, 3, 7, 40):
        found = [f for f in licenses.scan("Released under the MIT License.\n" * n) if f[0] == "MIT-notice"]
        assert len(found) == n and all(c == 1.0 for _, c, _, _ in found), n


def test_stretched_license_in_a_long_window():
    """A find of nearly twice its template's length, at any place among frequent words of the template."""
    license = [f"t{k}" for k in range(40)]
    around = [license[17 + k // 25 % 6] if k % 25 == 0 else f"a{k}" for k in range(600)]  # the six words that the find lacks
    far = [*license[:17], *license[23:]][::-1] * 30  # the others are more frequent
    for shift in range(20):
        inside = [*license[:17], *[f"i{k}" for k in range(44)], *license[23:]]
        text = [*around, *["pad"] * shift, *inside, *reversed(around), *far]
        found = licenses.scan(" ".join(text), {"L": " ".join(license)})
        assert found and found[0][1] >= 34 / 40, shift


# -- 2 ---------------------------------------------------------------------------------------------
def test_chat_template_is_reversible():
    rng = random.Random(3)
    for _ in range(300):
        turns = [("".join(rng.choice(["#", "\\", "</turn>", "\n", ": ", "user", "é", "/"]) for _ in range(rng.randrange(6))), "".join(rng.choice(["###", "\\", "</turn>", "\n", " ", "x", "/", "<"]) for _ in range(rng.randrange(8)))) for _ in range(3)]
        formatted = "".join(chat.render(r, t)[0] for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns


def test_chat_events_and_digests(spark, monkeypatch):
    log = [
        (1, 0, 0, "create", "user", "hi"), (1, 1, 1, "create", "assistant", "he"), (1, 1, 2, "delta", None, "llo"), (1, 0, 3, "edit", None, "hey"),
        (1, 2, 4, "create", "user", "gone"), (1, 1, 5, "regenerate", None, "anew"), (1, 3, 6, "create", "user", "stays"), (2, 0, 0, "create", "user", None),
        (2, 1, 1, "create", "assistant", "x"), (2, 1, 2, "delete", None, None), (None, None, None, "create", None, "n"),
    ]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    found = {r.conv_id: [(a, b) for a, b, _, _ in chat.parse(r.text)] for r in chat.reconstruct(df).collect()}
    assert found == {1: [("user", "hey"), ("assistant", "anew"), ("user", "stays")], 2: [("user", "")], None: [("", "n")]}
    rows = [(5, k, "assistant" if k % 2 else "user", f"text {k} \\ ### </turn>") for k in range(40)] + [(6, 1, "assistant", None), (6, 1, "assistant", None), (6, 0, None, "é")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    for size in (1 << 20, 50):  # whole conversations, and many segments
        monkeypatch.setattr(chat, "SEGMENT_CHARS", size)
        got = {r.conv_id: r for r in chat.read_back(chat.reconstruct(chat.of_turns(conv)).coalesce(1)).collect()} if size == 1 << 20 else {r.conv_id: r for r in chat.formatted_digests(conv).collect()}
        r = got[5]
        want = [t for _, _, role, t in rows[:40] if role == "assistant"]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (40, len("".join(want)), hashlib.sha256("".join(want).encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, _, a, t in rows[:40]).encode()).hexdigest()
        assert got[6].n_turns == 3 and got[6].loss_chars == 0
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len("\\### Assistant: </turn> ok")


# -- 3 ---------------------------------------------------------------------------------------------
def naive_measure(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = collections.Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i in range(len(w) - 2):
        if win[tuple(w[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_counts():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a ", "b ", "a b\n", "\n", "c", "é", "#", "\t", " ", " \n", "a b c "]) for _ in range(rng.randrange(40)))
        assert quality.measure(t)[:5] == naive_measure(t), repr(t)
    assert quality.measure(None) == (0,) * 8


def test_quality_verdicts(spark, odd, empty):
    rng = random.Random(5)
    good = [(k, words(rng, 200), "en", "a", 1) for k in range(300)]
    junk = [(1000 + k, " ".join(w + "%%%" for w in words(rng, 200).split()), "en", "a", 1) for k in range(10)]
    short = [(2000, "too short", "en", "a", 1)]
    df = spark.createDataFrame(good + junk + short, SCHEMA)
    found = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert all(found[k].kept for k, *_ in good) and not any(found[k].kept for k, *_ in junk) and found[2000].base_failed and not found[2000].kept
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {k for k, *_ in good}
    v = quality.verdicts(odd)
    assert v.count() == odd.count() and v.where("doc_id in (10, 11, 12) AND NOT base_failed").count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 10").count() == 0
    assert quality.verdicts(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_fences_follow_the_language(spark):
    """The same share of capitals is beyond the tail of one language and within that of another."""
    rng = random.Random(12)

    def text(capitals):
        w = words(rng, 200).split()
        return " ".join([x.upper() for x in w[:capitals]] + w[capitals:])

    rows = [(k, text(k % 10 == 0), "en", f"s{k % 2}", 1) for k in range(300)] + [(1000 + k, text(30 * (k % 10 == 0)), "de", f"s{k % 2}", 1) for k in range(300)]
    rows += [(2000, text(30), "en", "s0", 1), (2001, text(30), "de", "s0", 1), (2002, text(2), "en", "s0", 1)]
    found = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k, kept in found.items() if not kept] == [2000]


def test_quality_fences_shrink(spark):
    """Fences move from the language's to the group's own as the group grows, by exact weights."""
    rng = random.Random(14)
    long_words = lambda n: " ".join("x" * rng.randrange(20, 26) for _ in range(n))
    rows = [(k, words(rng, 100), "en", "plain", 1) for k in range(400)] + [(1000 + k, long_words(100), "en", "long", 1) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = quality.metrics(df, ["doc_id", "lang", "source"]).cache()
    fence = {r.source: r.fence for r in quality.fences(counts).collect()}
    values = collections.defaultdict(list)
    for r in counts.collect():
        values[r.source].append(r.word_chars * 1000 // r.n_words)

    def high(v):
        v = sorted(v)
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        return q3 + 3 * (q3 - q1)

    everything = high(values["plain"] + values["long"])  # of the language and of all alike
    floor = quality.LEAST["word_chars"]
    for source, n in (("plain", 400), ("long", 100)):
        want = max((n * high(values[source]) + 200 * everything) / (n + 200), floor)
        assert abs(fence[source].high_word_chars - want) <= 0.2 * want, source
    assert quality.judge(counts, quality.fences(counts)).where("kept").count() >= 400


def test_sketch_is_mergeable_and_close(spark):
    rng = random.Random(6)
    xs = [int(rng.expovariate(1) * 10 ** rng.randrange(1, 6)) for _ in range(4000)]
    df = spark.createDataFrame([(k % 2, x) for k, x in enumerate(xs)], "g int, v long")
    one = sketch.sketch(df.withColumn("all", F.lit(0)), ["all"], {"v": F.col("v")})
    merged = sketch.merge(sketch.sketch(df, ["g"], {"v": F.col("v")}), [])
    assert {(r.code, r.n) for r in one.collect()} == {(r.code, r.n) for r in merged.collect()}
    q = sketch.quantiles(merged, [], {"a": 0.25, "b": 0.75}).first()
    for got, p in ((q.a, 0.25), (q.b, 0.75)):
        exact = sorted(xs)[-(-int(p * len(xs))) - 1]
        assert exact <= got <= exact * 33 / 32 + 1


# -- 4 ---------------------------------------------------------------------------------------------
def test_line_dedup(spark, odd, empty):
    rng = random.Random(7)
    passage, template = words(rng, 60), "Posted by user {} on day {} in the forum of the old town"
    rows = []
    for k in range(8):
        own = [words(rng, 40) for _ in range(4)]
        rows.append((k, "\n".join([own[0], passage, own[1], template.format(k, k * 7), "", *own[2:]]), "en", "a", 1))
    copy = words(rng, 50) + "\n" + words(rng, 50)
    rows += [(100, copy, "en", "a", 1), (101, copy, "en", "a", 1), (102, "only mine " + words(rng, 30), "en", "a", 1)]
    numbers = [" ".join(str(rng.randrange(10**6)) for _ in range(20)) for _ in range(6)]
    rows += [(200 + k, words(rng, 30) + "\n" + x, "en", "a", 1) for k, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in lines.drop_recurring(df).collect()}
    assert all(out[200 + k].n_dropped == 0 for k in range(6))
    for k in range(8):
        want = [x for x in rows[k][1].split("\n") if x != passage and not x.startswith("Posted by")]
        assert out[k].text == "\n".join(want) and out[k].n_dropped == 2
    assert out[100].text == copy and out[101].text == copy and out[102].n_dropped == 0
    same = lines.drop_recurring(odd, "__a", "__b")
    assert same.columns == [*odd.columns, "__a", "__b"] and same.count() == odd.count()
    assert same.where("doc_id = 10 AND text IS NULL").count() == 1 and same.where("doc_id = 11 AND text = ''").count() == 1
    assert lines.drop_recurring(empty, "__a", "__b").count() == 0


def test_line_dedup_of_recurring_fields(spark):
    """Each field value is in several documents, each combination in one."""
    rng = random.Random(8)
    names, cities = ["Ann", "Bob", "Cid", "Dee"], ["Oslo", "Rome", "Bonn", "Nice"]
    posted = "Posted on our site by {} from the city of {} for all who read it"
    rows = [(k, f"{words(rng, 40)}\n{posted.format(*x)}\n{words(rng, 30)}", "en", "a", 1) for k, x in enumerate(itertools.product(names, cities))]
    rows += [(100, posted.format("Ann", "Rome").replace("for all who read it", "and then went far away"), "en", "a", 1)]  # half of it differs
    out = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[k].n_dropped == 1 and "Posted" not in out[k].text for k in range(16)) and out[100].n_dropped == 0


def test_line_dedup_of_copies(spark):
    """A passage that is most of otherwise different documents goes; copy groups, each its own, stay."""
    rng = random.Random(9)
    passage, notice = words(rng, 60), words(rng, 20)
    rows = [(k, f"{passage}\n{words(rng, 50)}", "en", "a", 1) for k in range(40)]
    groups = [[words(rng, 30) for _ in range(8)] for _ in range(3)]
    for k, g in enumerate(groups):
        near = [*g[:7], words(rng, 30)]  # one line of eight is another
        rows += [(100 + 10 * k + i, "\n".join([*(near if i == 2 else g), notice]), "en", "a", 1) for i in range(3)]
    out = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[k].n_dropped == 1 and passage not in out[k].text for k in range(40))
    for k in range(3):  # only the notice is in several groups
        assert all(out[100 + 10 * k + i].n_dropped == 1 and notice not in out[100 + 10 * k + i].text for i in range(3))


def test_line_dedup_of_short_lines(spark):
    """Any word of a short line may vary, two of eight or more; templates of few words go if they are in a share of the documents."""
    rng = random.Random(10)
    forms = ["Written by {} in the local news", "{} sent this to our local news desk", "Home About {} {} Contact Help Terms Privacy", "All the news by {}"]
    rows = [(k, "\n".join([words(rng, 40), *[f.format(f"N{chr(97 + k)}x", f"M{chr(97 + k)}y") for f in forms], words(rng, 30)]), "en", "a", 1) for k in range(20)]
    out = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[k].n_dropped == 4 for k in range(20))
    for size in (700, 1400):  # 2 of 700 and 4 of 1400 are under one of 200, 4 of 700 and 8 of 1400 over it
        few, many = size // 350, size // 175
        rows = [(k, "\n".join(["And so."] * (k < few) + ["Read more here"] * (k < many) + [f"{words(rng, 20)}"]), "en", "a", 1) for k in range(size)]
        out = {r.doc_id: r for r in lines.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert all(out[k].n_dropped == (k < many) for k in range(size))


# -- 5 ---------------------------------------------------------------------------------------------
def test_shard_store(spark, odd, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", odd.schema, target_bytes=4 << 20, fan_in=3)
    assert store.read().count() == 0 and store.append(empty) in (None, 1)
    for _ in range(5):
        store.append(odd)
    before = store.versions()
    old = store.read(before[-1]).count()
    assert old == 5 * odd.count()
    last = store.compact()
    assert store.versions()[-1] == last and len(store.runs()) < 5
    assert store.read(before[-1]).count() == old  # compaction deletes nothing
    store.vacuum(-10)
    assert store.versions() == [last]
    key = lambda df: collections.Counter(map(str, df.select("doc_id", "text").collect()))
    assert key(store.read()) == collections.Counter({k: 5 * n for k, n in key(odd).items()})
    with pytest.raises(sharding.Conflict):
        store._commit(last - 1, [])
    store.append_each(odd, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)))
    assert store.read().count() == 6 * odd.count()
    assert store.next_merge([sharding.Run(str(k), 2 << 20, 1, 0) for k in range(2)]) == []


# -- 6 ---------------------------------------------------------------------------------------------
def test_shard_store_loses_nothing(spark, odd, tmp_path):
    """An append beside a compaction, writers that die after each step of a commit, old versions, vacuum."""
    rows = odd.where("doc_id < 3").drop(*CLASH)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", rows.schema, fan_in=2, claim_seconds=0.2)
    first = store.append(rows)
    store.append(rows)
    late = "late"  # written, but not yet committed, while the compaction runs
    rows.write.parquet(f"{store.root}/runs/{late}")
    before = store.runs()
    assert store.compact() == 3 and [r.merges for r in store.runs()] == [1] and store.read().count() == 6
    store.vacuum()
    assert store.read(first).count() == 3 and store.read(2).count() == 6  # all is younger than the grace period
    assert store._add([late]) == 4 and store.read().count() == 9
    store._replace({r.name for r in before}, before[0])  # a slower compaction of the same runs
    assert store._latest() == 4 and store.read().count() == 9
    # a writer that died after its claim, and one that died before its rename
    store.fs.create(store._path("manifest", "v0000000005.claim"), False).close()
    store.fs.create(store._path("manifest", ".side"), False).close()
    assert store.append(rows) == 5 and store.read().count() == 12
    store.vacuum(-10)
    assert store.versions() == [5] and store.read().count() == 12
    assert len(os.listdir(tmp_path / "s" / "runs")) == len(store.runs())


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = [(k, words(rng, rng.randrange(1, 120)), "en", rng.choice(["a", "b", "c", "d", None]), 1) for k in range(600)] + [(9999, None, "en", "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.taken(df).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))  # reruns agree
    source = {k: s for k, _, _, s, _ in rows}
    total, by, target = sum(r["size"] for r in found), collections.Counter(), {}
    for r in found:
        assert r.taken <= 2 * r["size"] and r["size"] == len((rows[r.doc_id][1] or "").split() if r.doc_id < 9999 else [])
        by[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert all(abs(by[s] - t) <= max(3, 0.01 * t) for s, t in target.items())
    mixed = mixing.mix(df)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.taken // r["size"] for r in found if r.taken})
    assert mixing.taken(odd).count() == odd.count() and mixing.taken(empty).count() == 0
    assert mixing.mix(odd).drop("shard").columns == [c for c in odd.columns if c != "shard"] and mixing.mix(empty).count() == 0


def test_mixing_in_many_blocks_and_shards(spark, monkeypatch):
    """Blocks of several documents, more of them in larger sources, and shards that are partitions of their own."""
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    rng = random.Random(13)
    df = spark.createDataFrame([(k, words(rng, rng.randrange(20, 60)), "en", "ab"[k % 8 == 0], 1) for k in range(800)], SCHEMA)
    found = mixing.taken(df).collect()
    by, target = collections.Counter(), {}
    for r in found:
        by[r.target] += r.taken
        target[r.target] = r.source_size
    assert len(target) == 2 and all(abs(by[t] - t) <= 0.02 * t for t in target)
    mixed = mixing.mix(df, shard_words=2000).withColumn("at", F.spark_partition_id()).collect()
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter({r.doc_id: r.taken // r["size"] for r in found if r.taken})
    shards = {r.shard for r in mixed}
    assert len(shards) == 32 and len({(r.shard, r["at"]) for r in mixed}) == 32 == len({r["at"] for r in mixed})


def test_splitting_tree_is_exact(spark):
    quota = {0: 400, 1: 30, 2: 7, 3: 0, 4: 1}
    q = spark.createDataFrame(list(quota.items()), "s int, quota long")
    cells = mixing.split_tree(q, 8, 3).collect()
    assert {s: sum(c.q for c in cells if c.s == s) for s in quota} == quota
    sums = [sum(c.q for c in cells if c.shard == k) for k in range(8)]
    assert max(sums) - min(sums) <= 1 and all(c.q >= 0 for c in cells)
    p = spark.range(1).selectExpr(*[f"{mixing.hypergeometric(f'{(k + 0.5) / 400}D', '6L', '20L', '9L')} AS k{k}" for k in range(400)]).first()
    from math import comb

    for x in range(7):
        assert abs(list(p).count(x) / 400 - comb(6, x) * comb(14, 9 - x) / comb(20, 9)) < 0.006


# -- 7 ---------------------------------------------------------------------------------------------
def near_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark, odd, empty):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = words(rng, rng.randrange(5, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w))
            base = w if g % 2 else base  # chains and stars
    rows += ["", None, "One two", "one TWO", "x y z v"]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, jaccard.Rule(4, 85)).collect()}
    assert got == near_components(list(enumerate(rows)), 4, 85)
    kept = {r.doc_id for r in jaccard.keep_one(df, jaccard.Rule(4, 85)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_join_of_odd_rows(odd, empty):
    out = jaccard.join(odd, jaccard.Rule())
    assert out.count() == odd.count() and out.where("doc_id = 13").select("component_id").distinct().collect()[0][0] == 1
    kept = jaccard.keep_one(odd, jaccard.Rule())
    assert kept.columns == odd.columns and kept.where("doc_id = 13").count() == 0 and kept.where("doc_id = 10").count() == 1
    assert jaccard.join(empty, jaccard.Rule()).count() == 0 and jaccard.keep_one(empty, jaccard.Rule()).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------
def test_keep_one_tells_texts_of_one_doc_id_apart(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (7, c), (None, d), (None, d + " tail"), (None, a), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df, jaccard.Rule()).collect()), key=str)
    assert [x for x in kept if x[0] is not None] == sorted([(1, a), (5, b), (7, c), (8, "")], key=str)
    assert len([x for x in kept if x[0] is None]) == 1 and kept[-1][1] in (d, d + " tail")


def test_bpe_is_tiktokens(spark, odd, empty):
    codec = bpe.Codec(RANKS, PATTERN)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(10)
    texts = ["", " ", "\n", "a\n", "a  b", "a\tb", "it's we'll", "a" * 400, "!" * 500, "日本語の文" * 60, "a b\nc d"]
    texts += ["".join(rng.choice("aaab bcé\n\n  \t x1' sther日本…!!#\x1c\x85 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    ids, decoded = codec.encode_decode(texts)
    for t, i, d in zip(texts, ids, decoded):
        assert np.frombuffer(i, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        assert d == t.encode() and codec.decode([i]) == [d]
    for r in bpe.digests(odd, RANKS, PATTERN, with_ids=True).join(odd.select("doc_id", "text").where("doc_id < 13"), "doc_id").collect():
        assert r.n_tokens == len(enc.encode_ordinary(r.text or "")) and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_decode(odd, RANKS, PATTERN).count() == odd.count() and bpe.digests(empty, RANKS, PATTERN).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------
def test_bpe_rules_and_cuts_are_equal(monkeypatch):
    """The rule of long words gives the tokens of the other; what is forgotten, and where texts are cut, bears on nothing."""
    rng = random.Random(4)
    parts = ["a", "aa", "ab", "the", "é", "漢", "1", "#", "\U0001f600"]
    long_words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    spaces = [" ", "  ", "\n", "\t ", "\xa0", "\u2003", "\x1c", "\x85", " 's", "\r\n"]
    texts = ["".join(rng.choice([*parts, *spaces]) for _ in range(rng.randrange(60))) for _ in range(300)]
    plain = bpe.Codec(RANKS, PATTERN)
    short = [plain.encode_words([w])[0].tolist() for w in long_words]
    monkeypatch.setattr(bpe, "LONG", 1)
    assert short == [plain.encode_words([w])[0].tolist() for w in long_words]
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    cut = bpe.Codec(RANKS, PATTERN)
    cut.units.most = cut.words.most = 20
    assert cut.cuttable
    ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain.ranks, special_tokens={})
    ids, decoded = cut.encode_decode(texts)
    assert ids == [np.array(ranks.encode_ordinary(t), "<u4").tobytes() for t in texts] and decoded == [t.encode() for t in texts]


def test_fingerprints(spark, odd, empty):
    rng = random.Random(11)
    for n in (1, 2, 5, 40, 400, 5000):
        t, other = words(rng, n), words(rng, n)
        f = fingerprint.fingerprint(t)
        assert f == fingerprint.fingerprint(t) and fingerprint.likeness(f, f) == 1.0
        if n >= 40:
            assert fingerprint.likeness(f, fingerprint.fingerprint(other)) < 0.15
            assert fingerprint.likeness(f, fingerprint.fingerprint(t + " more words")) > 0.7
            assert 0.3 < fingerprint.likeness(f, fingerprint.fingerprint(fingerprint.edited(t, other))) < 0.75
    assert fingerprint.fingerprint(None) == fingerprint.fingerprint("") == "0::"
    assert len(fingerprint.fingerprint("a" * 50_000)) < 400  # a periodic text
    a, b = [rng.choice("abc") for _ in range(20)], [rng.choice("abc") for _ in range(17)]
    assert fingerprint._common(a, b) == lcs_like(a, b)


def test_edited_digests(spark, odd, empty):
    for df, per in ((odd, 2000), (odd, 3)):
        rows = sorted(texts_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want = collections.Counter()
        for k, (i, t) in enumerate(rows):
            new = fingerprint.edited(t or "", rows[(k + 1) % len(rows)][1] or "")
            want[i, len(t or ""), hashlib.sha256(new.encode()).hexdigest(), fingerprint.fingerprint(new)] += 1
        got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.edited_fingerprint) for r in fingerprint.edited_digests(df, per).collect())
        assert got == want
    assert fingerprint.edited_digests(empty).count() == 0
    one = fingerprint.edited_digests(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# -- 10 --------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T &amp; x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div id="cookie-notice">We use cookies.</div>
%s<div class="comments"><p>First! What a long comment with many words that nobody asked for, again and again.</p></div>
<aside class="sidebar"><p>Sidebar words</p></aside><form><input name=q><label>Search</label></form><footer>&copy; Site</footer></body></html>"""
BODY = "<h1>Head\n line</h1><p>Long  <b>first</b> paragraph with quite a few words &amp; signs &lt; here.<br>next line<p>Short.<ul><li>One<li>Two</ul><p>Another rather long paragraph to end the text of the article.</p>"
WANT = "Head line Long first paragraph with quite a few words & signs < here. next line Short. One Two Another rather long paragraph to end the text of the article."


def test_html_extraction(spark):
    assert html.extract(PAGE % f'<article class="post has-sidebar"><header>{BODY[: BODY.index("<p>")]}</header>{BODY[BODY.index("<p>") :]}<div class="ad">Buy!</div></article>') == WANT
    assert html.extract(PAGE % f"<main>{BODY}</main>") == WANT
    assert html.extract(PAGE % f'<div class="content">{BODY}</div>') == WANT
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("<article><p>Hi.</p></article>") == "Hi."
    assert html.extract(f"<article>{'<p>word word word</p>' * 5000}").count("word") == 15_000
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_pages(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html.extract_pages(df.where("false")).count() == 0


def test_html_of_several_articles(monkeypatch):
    """All articles that are mostly text stay, and lists of links that are marked as articles go, by their ratios."""
    rng = random.Random(15)
    one, two = words(rng, 120), words(rng, 60)
    links = "".join(f"<li><a href=/{k}><b>{words(rng, 2)}</b></a></li>" for k in range(12))
    page = f"<article><h2>One</h2><p>{one}</p><p>Short.</p></article><article><ul>{links}</ul></article><article><h2>Two</h2><p>{two}</p></article>"
    want = f"One {one} Short. Two {two}"
    for whole in (page, f"<main>{page}</main>", f"<article>{page}</article>"):
        assert html.extract(PAGE % whole) == want
    names = f'<div class="x1"><ul>{links}</ul></div><div class="x2"><h2>One</h2><p>{one}</p><p>{two}</p><p>Short.</p></div><div class="x3"><ul>{links}</ul></div>'
    assert html.extract(names) == f"One {one} {two} Short."
    monkeypatch.setattr(html, "ratios", lambda lines: [1.0] * len(lines))
    assert html.extract(PAGE % page) != want and html.extract(names) != f"One {one} {two} Short."


def test_html_of_several_parts():
    """Pages without article whose text is mostly in one section, list or table keep the rest too."""
    rng = random.Random(11)
    intro, one, two, end = (words(rng, n) for n in (30, 120, 60, 20))
    for form in (
        "<section><p>{}</section><section><p>{}</section>",
        "<div><p>{}</div><div><p>{}</div>",
        "<ul><li>{}</ul><p>{}",
        "<table><tr><td>{}<td>{}</table>",
        "<dl><dt>Term<dd>{}</dl><div>{}</div>",
    ):
        body = f'<h1>Head</h1><p>{intro}</p>{form.format(one, two)}<p>{end}</p><p>Bye.</p>'
        want = " ".join(["Head", intro, *(["Term"] if "<dt>" in form else []), one, two, end, "Bye."])
        assert html.extract(PAGE % f'<div class="content">{body}</div>') == want, form
