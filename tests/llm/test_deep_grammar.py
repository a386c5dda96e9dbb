"""Re-Pair goes on until no pair pays."""

import numpy as np

from limpid.llm import repair

FREE = 49_408


def test_repeated_passage_makes_deep_symbols():
    rng = np.random.default_rng(3)
    passage = rng.permutation(np.arange(2, 40_000))[:500].astype("<u2")
    ids = np.append(np.tile(passage, 400), repair.END).astype("<u2")
    symbols, rules = repair.compress(ids, FREE)
    assert repair.lengths_of(rules, FREE).max() > 200 and len(symbols) < 1000
    assert np.array_equal(repair.expand(symbols, rules, FREE), ids)


def test_copied_documents_become_few_symbols_and_read_back():
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(2, 20_000, 300), repair.END).astype("<u2")] * 2_000
    block = repair.Block(repair.pack(np.arange(len(docs)), np.array([len(d) for d in docs]), np.concatenate(docs), FREE))
    assert len(block.symbols) <= 2 * len(docs) and np.array_equal(block.ids(), np.concatenate(docs))
    assert np.array_equal(block.document(1_999), docs[0]) and np.array_equal(block.document(7, 100, 120), docs[0][100:120])


def test_no_pair_that_pays_is_left():
    ids = np.tile(np.random.default_rng(5).integers(2, 60, 3_000), 20).astype("<u2")
    symbols, rules = repair.compress(ids, FREE)
    pairs = symbols[:-1].astype(np.int64) << 16 | symbols[1:]
    assert FREE + rules.shape[1] == 1 << 16 or np.unique(pairs, return_counts=True)[1].max() < repair.LEAST
