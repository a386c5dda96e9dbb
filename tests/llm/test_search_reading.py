"""A query that reads all its postings finds what pruned blocks find, to the last bit."""

import numpy as np

from limpid.llm import search


def test_reading_all_postings_equals_pruned_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 60) % 400) for _ in range(700)] + ["w1 w2 w3"] * 40 + ["", "..."]
    hasher = search.TermHasher()
    counted = [hasher.counts(t) for t in texts]
    index = search.ShardIndex(sum(n for _, _, n in counted) / len(counted))
    index.add([len(texts) - i for i in range(len(texts))], counted)
    index.close()
    read, calls = search.ShardIndex._read_all, []
    monkeypatch.setattr(search.ShardIndex, "_read_all", lambda *a: calls.append(1) or read(*a))
    found = {}
    for many in (2, 0):
        monkeypatch.setattr(search, "MANY", many)
        found[many] = [index.search(t, n * 0.7, k) for t, n, _ in counted[::20] for k in (1, 10, 50)]
        assert bool(calls) == (many == 0)
    for pruned, whole in zip(found[2], found[0], strict=True):
        assert np.array_equal(pruned[0], whole[0]) and np.array_equal(pruned[1], whole[1])


def test_words_are_counted_with_the_terms():
    import pyarrow as pa

    texts = ["a b a", "", "...", "B c"]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], names=["text"])
    rows = [r for part in search._document_frequencies()(iter([batch])) for r in part.to_pylist()]
    assert sorted((r["df"], r["words"]) for r in rows) == [(1, 1), (1, 2), (2, 2)]
