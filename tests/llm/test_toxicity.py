import zlib

import numpy as np
import pytest

from limpid.llm import crf, toxicity
from limpid.llm.common import read
from limpid.llm.queries import QUERIES


def chain_marginals(emissions, model):
    """Sums over all state sequences."""
    n, t = len(emissions), np.array(model.transitions).reshape(2, 2)
    total, hot = 0.0, np.zeros(n)
    for k in range(1 << n):
        y = [k >> i & 1 for i in range(n)]
        w = np.exp(y[0] * model.start + sum(e for e, s in zip(emissions, y) if s) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total += w
        hot += w * np.array(y)
    return hot / total


def test_marginals_equal_the_sum_over_all_sequences():
    rng = np.random.default_rng(3)
    model = crf.Model(transitions=(0.0, -1.3, 0.4, 0.7), start=-0.6)
    sizes = [1, 7, 2, 9, 1, 8]
    emissions = [rng.normal(size=n) * 2 for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum(sizes) - sizes] = True
    got = crf.marginals(np.concatenate(emissions), first, model)
    assert np.allclose(got, np.concatenate([chain_marginals(e, model) for e in emissions]))


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.01"
    return toxicity.train(read(spark, sf, "documents"), read(spark, sf, "labels"))


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op1_toxicity"](spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out]
    toxic = [r.score for r in unseen if labels[r.doc_id]]
    clean = [r.score for r in unseen if not labels[r.doc_id]]
    ranked = np.mean([[a > b for b in clean] for a in toxic])
    assert ranked > 0.95
    assert np.mean([s >= 0.7 for s in toxic]) > 0.75 and np.mean([s >= 0.7 for s in clean]) < 0.02


def test_edges(spark, edge, nothing, model):
    scored = toxicity.score(edge, model)
    rows = scored.collect()
    assert len(rows) == edge.count() and set(edge.columns) == set(scored.columns)
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id == 6}
    assert len(same) == 1
    assert toxicity.score(nothing, model).count() == 0


def test_spans_point_at_offending_words(spark, model):
    df = spark.createDataFrame([(1, "The report was fine. You stupid worthless idiot, go away."), (2, "Nothing here at all.")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    marked = " ".join(rows[1].text[s["start"]:s["end"]].lower() for s in rows[1].spans)
    assert "idiot" in marked and "report" not in marked and rows[2].spans == [] and rows[1].score > rows[2].score


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(1, 1, 1)], [(2, 1, 0)], [(None, 1, 1)], [(99, 1, 1)]])
def test_labels_that_teach_nothing(spark, docs, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 1
