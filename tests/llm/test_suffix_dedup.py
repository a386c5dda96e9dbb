import random

import numpy as np
import pytest

from limpid.llm import suffix_dedup
from limpid.llm.induced import suffix_order
from limpid.llm.queries import QUERIES
from plain import multiset, repeats


def test_suffix_order_equals_sorting_all_suffixes():
    rng = np.random.default_rng(4)
    for _ in range(250):
        body = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 150)), dtype=np.uint8)
        data = body.tobytes()
        got = suffix_order(body, len(body) + 1, budget=int(rng.integers(40, 2000)))
        assert got.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_order_to_a_depth():
    rng = np.random.default_rng(9)
    body = np.concatenate([rng.integers(97, 100, 4000, dtype=np.uint8)] * 3)
    data = body.tobytes()
    got = [data[i:i + 50] for i in suffix_order(body, 50)]
    assert got == sorted(got)


def test_query_equals_all_strings(spark, medium):
    rows = [(r.doc_id, r.text) for r in medium.collect()]
    got = QUERIES["op5_suffix_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert multiset(map(tuple, got)) == multiset(repeats(rows))


def planted(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 200))) for _ in range(10)] + ["=" * 300, "-=" * 90, " " * 70]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 20):rng.randint(20, 300)] if rng.random() < 0.6 else "".join(rng.choice("qwertzuiop") for _ in range(rng.randint(0, 80))))
        rows.append((rng.randint(0, 50), "".join(parts)))
    return rows + [(1, None), (2, ""), (None, passages[0] * 3), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "bucket", "shard"), [(1, 24 << 20, 4 << 20), (2, 4000, 3000), (3, 900, 500)])
def test_planted_passages(spark, monkeypatch, seed, bucket, shard):
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", bucket)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rows = planted(seed)
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert multiset(map(tuple, got)) == multiset(repeats(rows))


def test_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    short = [(i, t if t is None or len(t) < 5000 else t[:400]) for i, t in rows]
    df = edge.sparkSession.createDataFrame(short, "doc_id long, text string")
    assert multiset(map(tuple, suffix_dedup.remove(df).collect())) == multiset(repeats(short))
    whole = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove(edge).collect()}
    assert whole[(7, 150_003)].n_removed == 150_000 and whole[(6, 150_000)].n_removed == 0
    assert suffix_dedup.remove(nothing).count() == 0


def test_cutting_keeps_rows_columns_and_characters(edge, nothing):
    out = suffix_dedup.cut(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[8] == "" and by_id[2].startswith("alpha beta gamma") and by_id[2].endswith("zweite Zeile") and len(by_id[2]) < 40
    assert by_id[3] is None and by_id[4] == "" and by_id[7] == "end"
    assert suffix_dedup.cut(nothing).count() == 0
    assert suffix_dedup.cut_text("aéb", [(1, 2)]) == "aéb" and suffix_dedup.cut_text("aéb", [(0, 3)]) == "b"
    assert suffix_dedup.cut_text("xéééy", [(2, 6)]) == "xééy"
