"""Work that must follow the size of the input."""

import math

import numpy as np
import pyarrow as pa

import xxhash

from limpid.llm import collocations, induced, search
from limpid.llm.ngram_prints import Block
from plain import words


def _told(blocks):
    """Blocks of one range as the shuffle brings them."""
    made = [(0, "en", 2, 0, len(b), b.pack()) for b in blocks]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
        names=["range", "lang", "n", "words", "size", "data"])


def _apart(count, size):
    """Blocks that have no fingerprint in common."""
    ones = np.ones(size, np.uint32)
    return [Block(np.arange(i, count * size, count, dtype=np.uint64), ones, ones, ones.astype(np.uint64)) for i in range(count)]


def test_rounds_of_ranges_are_many_tasks_each():
    for ranges in (1, 102, 511, 1_300, 4_096, 6_000, 100_000):
        for fan in (3, 512, collocations.FAN):
            rounds = collocations._rounds(ranges, fan)
            assert rounds[-1] == ranges and all(math.ceil(b / a) <= fan for a, b in zip([1, *rounds], rounds))
            assert len(rounds) == 1 or rounds[0] >= ranges ** (1 / len(rounds))
    assert collocations._rounds(1_300, collocations.FAN) == [1_300]  # 6 GB take one shuffle


def test_a_range_is_not_sorted_again_for_every_block(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1_000)
    real, sorted_rows = collocations.combine, []
    monkeypatch.setattr(collocations, "combine", lambda blocks: sorted_rows.append(sum(map(len, blocks))) or real(blocks))
    (key, _, block), = collocations._grouped(iter([_told(_apart(400, 100))]))
    assert key == (0, "en", 2) and np.array_equal(block.prints, np.arange(40_000)) and (block.counts == 1).all()
    assert sum(sorted_rows) < 6 * 40_000


def test_a_round_that_cuts_ranges_holds_no_whole_range(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1_000)
    sizes = [len(b) for _, _, b in collocations._grouped(iter([_told(_apart(400, 100))]), whole=False)]
    assert sum(sizes) == 40_000 and max(sizes) <= 1_100


def _texts(count):
    rng = np.random.default_rng(11)
    return [" ".join(f"w{k}" for k in rng.zipf(1.2, 80) % 900) for _ in range(count)] + ["w1 w2 w3"] * 30 + ["", "..."]


def test_queries_are_copied_once_for_many_indexes(spark, monkeypatch):
    texts = _texts(300)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = docs.where("doc_id % 7 = 0")
    want = sorted(map(tuple, search.top_k(docs, asked).collect()))  # one index
    monkeypatch.setattr(search, "SHARD_TEXT", 1 << 11)
    for tasks, held in ((0, 1 << 20), (0, 100), (4, 1 << 20)):
        monkeypatch.setattr(search, "TASKS", tasks)
        monkeypatch.setattr(search, "HELD_QUERIES", held)
        real, rows = search._search_shards, spark.sparkContext.accumulator(0)

        def counted(mean, k, real=real, rows=rows):
            def run(batches):
                def seen():
                    for batch in batches:
                        rows.add(sum(p < 0 for p in batch.column("part").to_pylist()))
                        yield batch
                return real(mean, k)(seen())
            return run

        with monkeypatch.context() as m:
            m.setattr(search, "_search_shards", counted)
            assert sorted(map(tuple, search.top_k(docs, asked).collect())) == want
        queries = sum(i % 7 == 0 and bool(words(t)) for i, t in enumerate(texts))
        indexes = -(-sum(len(t) for t in texts) // search.SHARD_TEXT)
        assert indexes > 30 and rows.value <= queries * max(tasks * 8, -(-indexes // search.INDEXES))


def test_queries_searched_together_find_what_each_finds():
    hasher, texts = search.TermHasher(), _texts(500)
    index = search.ShardIndex(70.0)
    of, terms, n, total = hasher.count_all(pa.array(texts))
    index.add_all(list(range(len(texts))), of, terms, n, total)
    index.close()
    edges, weights = np.searchsorted(of, np.arange(len(texts) + 1)), n * 0.7 + (terms % np.uint64(97)) / 31
    one = [index.search(terms[a:b], weights[a:b], 10) for a, b in zip(edges[:-1], edges[1:])]
    floor = np.array([s[4] if len(s) > 4 and i % 3 == 0 else 0.0 for i, (_, s) in enumerate(one)])
    for i, ((ids, scores), (known, best)) in enumerate(zip(index.search_all(edges, terms, weights, 10, floor), one, strict=True)):
        kept = best >= floor[i]
        assert np.array_equal(ids[scores >= floor[i]], known[kept]) and np.array_equal(scores[scores >= floor[i]], best[kept])
    # against every document, from counts
    for i in range(0, 500, 50):
        asked = dict(zip(terms[edges[i]:edges[i + 1]].tolist(), weights[edges[i]:edges[i + 1]].tolist()))
        every = []
        for d, text in enumerate(texts):
            w, norm = words(text), 1.2 * (0.25 + 0.75 * len(words(text)) / 70)
            tf = {h: w.count(x) for x in set(w) if (h := xxhash.xxh64_intdigest(x)) in asked}
            every.append(-sum(asked[h] * c * 2.2 / (c + norm) for h, c in tf.items()))
        assert np.allclose(one[i][1], -np.sort(every)[:10], rtol=1e-12)


def test_names_that_differ_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(2)
    names = np.concatenate([rng.integers(1, 4000, 20_000), np.tile(rng.integers(1, 4000, 40), 3)])
    depth, real, given = 26, np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, **how: given.append(len(x)) or real(x, **how))
    order = induced._sort_names(names, depth)
    assert sum(given) < 3 * len(names)
    cut = [tuple(names[i:i + depth]) for i in order.tolist()]
    assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(names)))
    for few in ([5], [1, 1, 1, 1], [2, 1, 2, 1, 2]):
        cut = [few[i:i + depth] for i in induced._sort_names(np.array(few), depth)]
        assert cut == sorted(cut)
