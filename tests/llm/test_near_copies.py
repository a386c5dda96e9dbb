import random

import numpy as np
import pytest

from limpid.llm import simhash
from limpid.llm.components import components
from limpid.llm.queries import QUERIES
from plain import groups, simhash as plain_fingerprint


def near(a, b):
    return (a ^ b).bit_count() <= 3


def test_fingerprints(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "  ", "One", "one TWO", "a b c", "a b c d", "ß é\x0bü\x1cx a", "x " * 5000]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_query_equals_all_pairs(spark):
    rows = sorted(QUERIES["op6_simhash"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.doc_id)
    least = groups([int(r.fingerprint, 16) for r in rows], near)
    assert len(rows) == 1000 and all(len(r.fingerprint) == 16 for r in rows)
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in least]


@pytest.mark.parametrize("hot", [20_000, 30])
def test_planted_neighbours(spark, hot):
    """Chains of one to three flipped bits, and a crowd that shares one half."""
    rng = random.Random(2)
    values = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
    half = rng.getrandbits(32) << 32
    values |= {half | rng.getrandbits(7) << rng.randint(0, 25) for _ in range(150)}
    values = np.array(sorted(values), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, hot=hot)).collect()}
    own = sorted(int(v) for v in values)
    least = groups([v % (1 << 64) for v in own], near)
    assert [got.get(v, v) for v in own] == [own[i] for i in least]


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (50, 49), (49, 50), (41, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(7, 40))
    assert got[49] == got[50] == got[41] == 41 and 3 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(edge, nothing):
    rows = simhash.groups(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fp == by_id[4].fp == by_id[5].fp == 0 and by_id[5].component_id == 3
    assert by_id[8].component_id == 1
    assert simhash.groups(nothing).count() == 0


def test_one_of_each_group_stays(edge, nothing, medium):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 4 and 5 are as empty as 3, 8 repeats 1, 7 is near 6; 10 and the row without an id differ from all
    assert [i for none, i in ids if not none] == [1, 2, 3, 6, 9, 10, 10, 11, 12] and ids[-1][0]
    assert simhash.keep_one(nothing).count() == 0
    rows = simhash.groups(medium).collect()
    expected = sorted(r.doc_id for r in rows if r.doc_id == r.component_id)
    assert sorted(r.doc_id for r in simhash.keep_one(medium).collect()) == expected
