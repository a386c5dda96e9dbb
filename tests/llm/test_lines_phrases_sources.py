"""Line dedup, phrase collocations and the source audit against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.llm import collocations, divergence, line_runs
from limpid.llm.ngram_prints import DIFFER, Block, Prints, combine, read_words
from limpid.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- lines ------------------------------------------------------------------------------

def plain_lines(rows, least):
    """(id, lines, dropped, kept) of every row."""
    split = [[(line, small(line).strip(BLANKS)) for line in (t or "").split("\n")] for _, t in rows]
    docs = Counter(k for lines in split for k in {k for _, k in lines} if k)
    out = []
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [line for line, k in lines if not k or docs[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


LINES = [(i, f"Head line\n  head LINE\t\nown {i}\n\n\x0bfoot\r\nodd {i % 3}") for i in range(12)] + [
    (0, "Head line\n"), (None, "head line"), (None, None), (50, ""), (51, "\n\n"), (52, "ÄÖ\näö\nÄÖ"), (53, " head line"), (53, " head line"),
]


@pytest.mark.parametrize("batches, least", [(1, 2), (5, 3), (4, 10)])
def test_lines_equal_brute_force(spark, edge, nothing, batches, least):
    made = spark.createDataFrame(LINES, "doc_id long, text string")
    assert lines_of(line_runs.dedup(made, batches, least)) == plain_lines(LINES, least)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert lines_of(line_runs.dedup(edge, batches, least)) == plain_lines(rows, least)
    assert line_runs.dedup(nothing, batches).count() == 0


def test_runs_take_batches_as_they_come(spark):
    runs = line_runs.LineRuns(spark, frequent=10)
    everything = []
    for b in range(7):
        rows = [(b * 10 + i, "boiler plate\nsame in batch %d\nown %d" % (b, b * 10 + i)) for i in range(5)]
        everything += rows
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        runs.add_documents(docs)
        told = runs.places == len(everything) * 3
        # two runs of a level become one of the next
        assert told and [len(level) for level in runs.levels] == [(b + 1) >> i & 1 for i in range(len(runs.levels))]
    docs = spark.createDataFrame(everything, "doc_id long, text string")
    before = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert set(runs.runs()) <= before
    assert lines_of(line_runs.clean(docs, runs.frequent(), runs.places)) == plain_lines(everything, 10)
    runs.release()
    assert not {r.tableName for r in spark.sql("SHOW TABLES").collect()} & set(before)


def test_a_key_that_grows_heavy_late_is_known_as_heavy(spark):
    runs = line_runs.LineRuns(spark, frequent=2)
    few = spark.createDataFrame([(i, "late\nother %d" % (i // 2)) for i in range(4)], "doc_id long, text string")
    many = spark.range(3000).select("id", F.concat(F.lit("late\nown "), "id").alias("text"))
    runs.add_documents(few)
    runs.add_documents(many)
    top = max(r.docs for r in runs.frequent().collect())
    runs.release()
    assert top == 3004 and top * line_runs.HEAVY > runs.places


def test_a_text_of_many_lines_takes_time_by_its_lines(spark):
    text = "\n".join(["x"] * 100_000 + [f"own {i}" for i in range(50_000)])
    rows = [(1, text), (2, "x\ny")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines_of(line_runs.dedup(made, 2, 2)) == plain_lines(rows, 2)


def test_line_dedup_has_no_python_and_no_cross_join(spark):
    plan = QUERIES["op13_line_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# --- phrases ----------------------------------------------------------------------------

def plain_phrases(rows, least):
    f, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in (1, 2, 3):
                f[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return {k: {p: a for p, a in c.items() if a >= least} for k, c in f.items()}, words


def plain_collocations(rows, least, top):
    found, words = plain_phrases(rows, least)
    out = []
    for lang, f in found.items():
        kept = []
        for p, a in f.items():
            if len(p) == 1:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


SAID = [(i, "en", "New York city, new  York\tCITY. the end of the line! of the") for i in range(12)] + [
    (20, None, "a b a b a b a b a b a b"), (21, "de", None), (22, "de", ""), (23, "de", "é ü é ü é ü\x00 é ü é ü é ü é ü é ü é ü é ü é ü é ü"),
    (24, "en", "york " * 30), (24, "en", "york " * 30), (None, "en", " of the  x\x1fy"),
]


def collocated(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, dealing", [
    (10, {}), (3, {}), (3, {"range_bytes": 8, "fan": 3}),                       # one range; many ranges dealt in several rounds
    (3, {"moduli": (5, 13, 2147483587)}), (2, {"moduli": (17, 19, 2147483587), "range_bytes": 50}),  # nearly every fingerprint collides
])
def test_collocations_equal_brute_force(spark, least, dealing):
    made = spark.createDataFrame(SAID, "doc_id long, lang string, text string")
    want = plain_collocations([(r[1], r[2]) for r in SAID], least, 50)
    assert collocated(collocations.collocations(made, 50, least, **dealing)) == want


def test_collocations_of_edge_texts(spark, edge, nothing):
    rows = [(r.lang, r.text) for r in edge.collect()]
    assert collocated(collocations.collocations(edge, 2000, 2)) == plain_collocations(rows, 2, 2000)
    assert collocations.collocations(nothing).count() == 0


def test_prints_of_runs_are_those_of_their_text():
    prints = Prints()
    long = read_words([b"one Two  three, four five", b"TWO\tthree " * 5000])
    alone = read_words([b"two three"])
    first, found, checks = prints.of(long, (2,))[2]
    _, one, check = prints.of(alone, (2,))[2]
    same = found == one[0]
    assert same.sum() == 5001 and set(checks[same]) == {check[0]} and {long.phrase(int(i), 2) for i in first[same]} == {b"two three"}
    assert long.phrase(0, 3) == b"one two three" and list(long.text[:5]) == [0] * 5 and long.text[-1] == 1
    assert len(read_words([]).start) == 0 and len(read_words([b"", b" .,"]).grams(1)) == 0


def test_blocks_survive_packing_and_tell_collisions():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 500, 4000).astype(np.uint64) << np.uint64(50)
    block = combine([Block(raw, (raw >> np.uint64(52)).astype(np.uint32), rng.integers(0, 99, 4000).astype(np.uint32), np.ones(4000, np.uint64))])
    back = Block.unpack(block.pack(), len(block))
    for a, b in zip(vars(block).values(), vars(back).values(), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    values, counts = np.unique(raw, return_counts=True)
    assert (block.prints == values).all() and (block.counts == counts).all()
    two = combine([block, Block(block.prints[:3], block.checks[:3] + 1, block.keys[:3], block.counts[:3])])
    assert (two.checks[:3] == DIFFER).all() and (two.checks[3:] == block.checks[3:]).all()


# --- sources ----------------------------------------------------------------------------

def plain_audit(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small(text))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})
        def share(c, v=len(kept), kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            marks = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", marks)):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = "red green blue Straße éa the of and"
USED = [("en", f"s{i % 7}", " ".join(w for j, w in enumerate(WORDS.split() * 3) if (i + j) % (2 + i % 3))) for i in range(60)] + [
    ("en", "empty", ""), ("en", None, None), (None, None, "x y"), ("de", "a", "one"), ("de", "b", "two"),
    *[("en", "hot", "the same text again and again")] * 40, *[("en", "s1", "the same text again and again")] * 3, ("en", "s0", "THE same text again AND again"),
]


@pytest.mark.parametrize("least, stripe, block", [(10, 256, 4096), (2, 2, 3), (1, 3, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, least, stripe, block):
    # the workers get these by value, as the functions are shipped with the plan
    monkeypatch.setattr(divergence, "BLOCK", block)
    made = spark.createDataFrame(USED, "lang string, source string, text string").repartition(3)
    assert audited(divergence.audit(made, least, 4, stripe=stripe)) == plain_audit(USED, least, 4)


def test_audit_of_edge_texts(spark, edge, nothing):
    rows = [(r.lang, r.source, r.text) for r in edge.collect()]
    assert audited(divergence.audit(edge, 2)) == plain_audit(rows, 2, 10)
    assert divergence.audit(nothing).count() == 0


def test_equal_texts_are_split_once(spark):
    made = spark.createDataFrame(USED, "lang string, source string, text string").repartition(5)
    rows = divergence.collapse(made).collect()
    assert sum(r.copies for r in rows) == len(USED)
    hot = [r for r in rows if r.text == "the same text again and again"]
    assert sum(r.copies for r in hot if r.source == "hot") == 40 and len({r.source for r in hot}) == 2


def test_no_count_overflows(spark):
    kept = spark.createDataFrame([("en", "a", "t", 9_000_000_000_000, 9_000_000_000_001), ("en", "b", "t", 1, 9_000_000_000_001)], "lang string, source string, term string, count long, total long")
    docs = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string")
    _, each = divergence.probabilities(docs, kept)
    assert {r.source: r.p for r in each.collect()} == {"a": 1 + 10**9 * (9_000_000_000_002) // (9_000_000_000_002), "b": 1 + 10**9 * 3 // 3}
