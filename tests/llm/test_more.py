"""Licenses, shards, decontamination, chats, token files, search and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from limpid.llm import chat, decontaminate, licenses, repair, search, sharding, simhash, token_files, toxicity
from limpid.llm.common import read
from limpid.llm.license_rules import BASE, build_rules
from limpid.llm.queries import ORACLE, QUERIES
from oracle import connect, differences
from plain import contamination, multiset, sha, words

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == []


# --- licenses ---------------------------------------------------------------------------

RULES = build_rules()


def plain_scan(text):
    w = words(text)
    line = " " + " ".join(w) + " " if w else " "
    found = []
    for r in RULES:
        for m in re.finditer(r.regex, line) if r.keyword in line else ():
            s = line[:m.start()].count(" ") - 1
            found.append((s, s + m[0].count(" ") + 1, r.tier, r.label, r.rule, r.base))
    kept = [d for d in found if d[5] or not any(e[2] < d[2] and e[0] <= d[0] and e[1] >= d[1] for e in found)]
    base = sorted((i, label) for phrase, label in BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    return len(w), sorted(kept), base


LICENSED = [
    "cc by cc by cc-by-sa 4.0 CC BY", "Licensed under the Apache License, Version 2.0; MIT License", "GNU General Public License",
    "SPDX-License-Identifier: GPL-3.0-or-later gnu general public license version 3 or later " * 40, "über mit license ß MIT\nlicense",
    "released under the terms of the BSD license 3-clause; lgpl 2.1 gplv2 agpl 3.0", "Permission is hereby granted, free of charge, to any person",
]


def same_scan(rows):
    for r in rows:
        n, kept, base = plain_scan(r.text)
        assert n == r.n_words and sorted(tuple(d) for d in r.detections) == kept and sorted((d.start, d.label) for d in r.base_places) == base


def test_scan_equals_trying_every_rule(spark, edge, nothing, medium):
    assert len(RULES) > 300 and len({r.rule for r in RULES}) == len(RULES)
    same_scan(licenses.scan(spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")).collect())
    same_scan(licenses.scan(medium).collect())
    scanned = licenses.scan(edge)
    rows = scanned.collect()
    same_scan(rows)
    assert len(rows) == edge.count() and set(edge.columns) | {"base_places"} == set(scanned.columns)
    assert licenses.scan(nothing).count() == 0


def test_license_query(spark, medium):
    texts = {r.doc_id: r.text for r in medium.collect()}
    rows = QUERIES["op3_licenses"](spark, SMALL).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        n, kept, base = plain_scan(texts[r.doc_id])
        at = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base})) and r.labels == ",".join(sorted({d[3] for d in kept}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(kept)


# --- shards -----------------------------------------------------------------------------

def test_shards_of_the_query(spark, medium):
    rows = QUERIES["op7_rendezvous"](spark, SMALL).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in medium.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and 30 < len(slots) < 100
    assert 30 < sum(r.grown_shard == 16 for r in rows) < 100


def test_weights_and_runs(spark, edge, nothing):
    many = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text")
    counts = Counter(r.shard for r in sharding.assign(many, [1.0, 2.0, 0.0, 1.0]).collect())
    assert counts[2] == 0 and abs(counts[1] / 30_000 - 0.5) < 0.02 and abs(counts[0] / 30_000 - 0.25) < 0.02
    slotted = sharding.with_slots(sharding.assign(edge.unionAll(edge).unionAll(edge), [1.0, 1.0]), run_rows=5).collect()
    assert len(slotted) == 3 * edge.count()
    for shard in (0, 1):
        assert sorted(r.slot for r in slotted if r.shard == shard) == list(range(sum(r.shard == shard for r in slotted)))
    assert all(r.size == 1 for r in slotted if r.doc_id in (3, 4))
    assert sharding.with_slots(sharding.assign(nothing, [1.0])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of("doc_id", [])


# --- decontamination --------------------------------------------------------------------

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Tiny item, here"), (3, None), (4, "..."), (2, "tiny ITEM here"),
         (5, "two three four five six seven eight nine ten eleven")]
HELD = [
    (1, "x One two three four five six seven eight nine ten eleven y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "a tiny item here tiny item here"),
    (1, "clean text"), (None, "tiny, item; HERE"), (6, " ".join(["word"] * 20_000 + ["tiny item here"])), (6, " ".join(["word"] * 20_000 + ["tiny item here"])),
]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_decontamination_equals_trying_every_window(spark, edge, nothing, broadcast):
    items = spark.createDataFrame([(i, t, "x", "y") for i, t in ITEMS], "item_id long, text string, word string, start string")
    docs = spark.createDataFrame(HELD, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in decontaminate.judge(docs, items, broadcast_bytes=broadcast).collect()]
    assert multiset(got) == multiset(contamination(HELD, ITEMS))
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    given = edge.selectExpr("doc_id AS item_id", "text", "word").where("doc_id IN (1, 9)")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in decontaminate.judge(edge, given, broadcast_bytes=broadcast).collect()]
    assert multiset(got) == multiset(contamination(rows, [(i, t) for i, t in rows if i in (1, 9)]))
    assert decontaminate.judge(nothing, items).count() == 0
    none = decontaminate.judge(edge, items.limit(0)).collect()
    assert len(none) == edge.count() and not any(r.contaminated for r in none)


def test_clean_documents_stay(spark, edge):
    given = spark.createDataFrame([(1, "mit license cc by 4 0")], "item_id long, text string")
    out = decontaminate.clean(edge, given)
    assert out.columns == edge.columns and out.count() == edge.count() - 1 and out.where("doc_id = 9").count() == 0


# --- chats ------------------------------------------------------------------------------

def plain_fold(events):
    turns = {}
    for _, kind, turn, role, text in sorted(events, key=lambda e: (e[0], e[2], e[1], e[4] or "")):
        if kind == "regenerate":
            turns = {t: m for t, m in turns.items() if t < turn}
        old = turns.get(turn, ("", ""))
        turns[turn] = (role or old[0], (old[1] if kind == "delta" else "") + (text or ""))
    return [turns[t] for t in sorted(turns)]


LOG = [
    (1, "message", 0, "user", "hi"), (2, "message", 1, "assistant", ""), (3, "delta", 1, None, "Hel"), (4, "delta", 1, None, "lo"), (5, "message", 2, "user", "more?"),
    (6, "edit", 0, None, "hi there"), (7, "regenerate", 1, "assistant", ""), (8, "delta", 1, None, "New <|end|> <\\|x"), (9, "message", 2, "user", None), (10, "delta", 2, None, "again"),
]


def test_fold_equals_replaying(spark):
    logs = {1: LOG, 2: LOG[:4], 3: LOG[2:4], 4: [(1, "message", 0, None, None)], 5: LOG[:6] * 1 + [(6, "delta", 5, "user", "z")]}
    events = spark.createDataFrame([(c, *e) for c, log in logs.items() for e in log], "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {}
    for r in chat.fold(events).orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: plain_fold(log) for c, log in logs.items()}
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 1, "other", 0, "user", "x")], events.schema)).collect()
    assert chat.fold(events.limit(0)).count() == 0


def test_rendering_is_reversible(spark):
    said = ["", "<|", "<\\|", "<\\\\|end|>", "<|start|>user<|message|>x<|end|>", "</s>[INST] ok [/INST]", "a\nb\0", "<<||", "\\<|\\", None, "long " * 50_000]
    rows = [(1, k, ["user", "assistant", "<|end|>", None][k % 4], t) for k, t in enumerate(said)] + [(2, 0, "user", "same")] * 2
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    segments = chat.render(chat.fold(chat.events_of_turns(turns))).orderBy("conv_id", "turn").collect()
    whole = "".join(s.segment for s in segments if s.conv_id == 1)
    assert chat.parse(whole) == [(r or "", t or "") for c, _, r, t in rows if c == 1]
    back = {r.conv_id: r for r in chat.read_back(spark.createDataFrame(segments)).collect()}
    assert back[2].n_turns == 2 and back[1].formatted_chars == len(whole)
    learnt = "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (back[1].loss_chars, back[1].loss_sha256) == (len(learnt), sha(learnt.encode()))
    assert chat.read_back(chat.render(chat.fold(chat.events_of_turns(turns.limit(0))))).count() == 0


# --- token files ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    own.encode_special_tokens = True
    return own


def plain_files(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, monkeypatch, medium, library):
    expected = multiset(plain_files(sorted((r.doc_id, r.text) for r in medium.collect()), library))
    assert multiset(map(tuple, QUERIES["op8_token_files"](spark, SMALL).collect())) == expected
    monkeypatch.setattr(token_files, "RANGE_BYTES", 200_000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 10_000)
    assert multiset(map(tuple, token_files.round_trip(medium).collect())) == expected


def test_token_file_edges(edge, nothing, library):
    rows = token_files.round_trip(edge).orderBy("start").collect()
    assert len(rows) == edge.count() and rows[0].doc_id is None and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    own = multiset((i, n, c) for i, _, n, c in plain_files([(r.doc_id, r.text) for r in edge.collect()], library))
    assert multiset((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == own
    assert token_files.round_trip(nothing).count() == 0


def test_odd_letters_equal_the_library(library):
    own = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    texts = [f"{p}a {p}{p}1'S <|endoftext|>{p}\x85\x1c" for p in map(chr, range(0x500))]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.pack_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(2, 30, n), repair.END).astype("<u2") for n in [0, 5, 3000, 0, 1, 800, 20_000]] + [np.append(np.tile([7, 8, 9], 4000), repair.END).astype("<u2")]
    ids = np.concatenate(docs)
    block = repair.Block(repair.pack(np.arange(len(docs)), np.array([len(d) for d in docs]), ids, 49_408))
    assert block.rules.shape[1] > 100 and len(block.symbols) < 0.6 * len(ids) and np.array_equal(block.ids(), ids)
    for k, d in enumerate(docs):
        assert np.array_equal(block.document(k), d)
        for a, b in [(0, 1), (len(d) // 2, len(d) // 2 + 9), (len(d) - 1, len(d))]:
            assert np.array_equal(block.document(k, a, b), d[a:b])
    assert np.array_equal(repair.Block(repair.pack(np.zeros(0, int), np.zeros(0, int), np.zeros(0, "<u2"), 49_408)).ids(), [])
    with pytest.raises(ValueError):
        repair.Block(b"RPR1" + bytes(40))


# --- search -----------------------------------------------------------------------------

def plain_top(docs, asked, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    n, mean = len(bags), sum(sum(c.values()) for _, c in bags) / len(bags)
    df = Counter(w for _, c in bags for w in c)
    out = {}
    for q, t in asked:
        scored = []
        for i, c in bags:
            size = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + size) for w, m in Counter(words(t)).items() if c[w])
            if s:
                scored.append((-s, -1 << 63 if i is None else i))
        if scored:
            out[q] = sorted(scored)
    return out


def same_top(rows, expected, k=10):
    """Ranks, scores and ids; documents whose scores differ by rounding alone may change places."""
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.score, -1 << 63 if r.doc_id is None else r.doc_id))
    assert set(got) == set(expected)
    for q, every in expected.items():
        best = every[:k]
        assert [rank for rank, _, _ in got[q]] == list(range(1, len(best) + 1))
        for (_, s, i), (e, _) in zip(got[q], best):
            assert abs(s + e) < 1e-12 * abs(e)
            assert any(d == i and abs(x - e) < 1e-12 * abs(e) for x, d in every)


def test_scores_that_32_bits_cannot_tell_apart():
    index, hasher = search.ShardIndex(1000.0), search.TermHasher()
    # one long and one slightly longer document: their scores differ in the eighth digit
    a, b = (np.array([7], np.uint64), np.array([3]), 90_000_001), (np.array([7], np.uint64), np.array([3]), 90_000_000)
    index.add([1, 2], [a, b])
    index.close()
    ids, scores = index.search(np.array([7], np.uint64), np.array([2.5]), 1)
    assert np.float32(index.impacts(np.array([0]), np.array([3]))[0]) == np.float32(index.impacts(np.array([1]), np.array([3]))[0])
    assert list(ids) == [2] and scores[0] == 2.5 * index.impacts(np.array([1]), np.array([3]))[0]
    assert (index.entry_max >= index.impacts(index.doc, index.tf).max()).all()
    empty = search.ShardIndex(1.0)
    empty.add([5], [hasher.counts(" ... !")])
    assert all(len(x) == 0 for x in empty.close().search(np.array([7], np.uint64), np.array([1.0]), 3))


def test_search_where_a_shard_has_no_words(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_TEXT", 4)
    rows = [(0, "... !"), (50, "a b"), (100, None), (101, "b"), (102, "- - -")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.query_id, r["rank"], r.doc_id) for r in search.top_k(docs, docs.where("doc_id % 50 = 0")).collect()}
    assert found == {(50, 1, 50), (50, 2, 101)}


@pytest.mark.parametrize("shard", [64 << 20, 500_000])
def test_search_equals_scoring_everything(spark, monkeypatch, medium, shard):
    monkeypatch.setattr(search, "SHARD_TEXT", shard)
    rows = [(r.doc_id, r.text) for r in medium.collect()]
    same_top(QUERIES["op4_search"](spark, SMALL).collect(), plain_top(rows, [x for x in rows if x[0] % 50 == 0]))


def test_search_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = search.top_k(edge, edge.where("doc_id IN (1, 3, 4, 5, 6, 9)"), k=3).collect()
    same_top(got, plain_top(rows, {(i, t) for i, t in rows if i in (1, 3, 4, 5, 6, 9)}, 3), 3)
    assert {r.doc_id for r in got if r.query_id == 1} == {1, 8}
    assert search.top_k(nothing, nothing).count() == 0 and search.top_k(edge, nothing).count() == 0


# --- pipeline ---------------------------------------------------------------------------

def test_stages_equal_their_operators(spark, tmp_path):
    docs, seen = read(spark, SMALL, "documents"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((docs, out))
        docs = out
    first, given = seen[0]
    assert all(a.columns == first.columns and b.columns == first.columns for a, b in seen[:-1])
    model = toxicity.train(first, read(spark, SMALL, "labels"))
    assert {r.doc_id for r in toxicity.score(first, model).where("predicted = 0").collect()} == {r.doc_id for r in given.collect()}
    given, out = seen[1]
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in simhash.groups(given).where("doc_id = component_id").collect()}
    given, out = seen[2]
    assert given.count() == out.count() and all(r.n_chars == len(r.text) for r in out.collect())
    assert sum(r.n_chars for r in out.collect()) < sum(r.n_chars for r in given.collect())
    given, out = seen[3]
    dirty = contamination([(r.doc_id, r.text) for r in given.collect()], [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()])
    assert {r.doc_id for r in out.collect()} == {i for i, _, hit, _ in dirty if not hit}
    given, out = seen[4]
    texts = {r.doc_id: r.text for r in given.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: sha(t.encode()) for i, t in texts.items()}
    assert multiset(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == multiset(map(tuple, out.collect()))


def test_stages_on_edges(spark, edge, nothing, tmp_path):
    for name, df in (("edge", edge), ("nothing", nothing)):
        docs = df
        for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
            out = apply(spark, docs, SMALL)
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}{k}")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == df.columns
        assert docs.count() == (0 if name == "nothing" else docs.select("doc_id").count())
