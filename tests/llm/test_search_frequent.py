"""Words cut as buffers, frequent terms laid out, and shards that each have a task."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from limpid.llm import search
from plain import words

ODD = ["", None, "...", " a b", "b a ", "\x00a\x7fB\x80c", "Ä😀x-ÿ@Z[z`{|}~", "a,b,,A", "tab\tline\nend", "word " * 3_000, "über straße 数据 x"]


def test_words_are_counted_as_the_word_rule_says():
    for texts in (pa.array(ODD), pa.array(ODD).slice(3, 5), pa.array(ODD, pa.large_string()), pa.array(["", None]), pa.array([None], pa.string())):
        of, terms, n, total = search.TermHasher().count_all(texts)
        for k, text in enumerate(texts.to_pylist()):
            bag = Counter(xxhash.xxh64_intdigest(w) for w in words(text or ""))
            assert list(zip(terms[of == k].tolist(), n[of == k].tolist())) == sorted(bag.items())
            assert total[k] == sum(bag.values())


def test_a_query_reads_no_posting_of_a_frequent_term(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join([f"w{k}" for k in range(20)] * 3 + [f"r{x}" for x in rng.integers(0, 300, 6)]) for _ in range(900)]
    index, hasher = search.ShardIndex(60.0), search.TermHasher()
    index.add_all(list(range(len(texts))), *hasher.count_all(pa.array(texts)))
    index.close()
    read, seen = index._read, []
    monkeypatch.setattr(index, "_read", lambda at, w: seen.append(int((index.term_edge[at + 1] - index.term_edge[at]).sum())) or read(at, w))
    for t in texts[::90]:
        terms, n, _ = hasher.counts(t)
        ids, scores = index.search(terms, n * 1.0, 10)
        index.asked[np.searchsorted(index.terms, terms)] = True
        every = index._scores(np.arange(len(texts)))
        index.asked[:] = False
        best = np.lexsort((np.arange(len(texts)), -every))[:10]
        assert np.array_equal(ids, best) and np.array_equal(scores, every[best])
    assert max(seen) < 2 * len(texts)  # of 20 documents' worth


def test_closing_holds_a_posting_few_times():
    rng = np.random.default_rng(9)
    index, documents, each = search.ShardIndex(100.0), 2_000, 400
    for _ in range(4):
        terms = np.sort([rng.choice(20_000, each, replace=False) for _ in range(documents // 4)], axis=1).astype(np.uint64)
        index.add([1] * len(terms), [(t, np.ones(each, np.int64), each) for t in terms])
    tracemalloc.start()
    index.close()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 45 * documents * each


def test_every_shard_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_TEXT", 400)
    docs = spark.createDataFrame([(i, f"w{i} common text of some words") for i in range(200)], "doc_id long, text string")
    asked = docs.where("doc_id % 50 = 0")
    tasks = []
    real = search._search_shards

    def counted(mean, k):
        run = real(mean, k)

        def told(batches):
            shards = set()

            def seen():
                for batch in batches:
                    shards.update(batch.column("shard").to_pylist())
                    yield batch

            list(run(seen()))
            yield pa.RecordBatch.from_arrays([pa.array([len(shards)], pa.int64())] * 3 + [pa.array([1.0])], names=["query_id", "query_row", "doc_id", "score"])

        return told

    monkeypatch.setattr(search, "_search_shards", counted)
    tasks = [r.query_id for r in search.top_k(docs, asked, k=1000).where(F.col("query_id") > 0).collect()]
    assert len(tasks) > 4 and set(tasks) == {1}
