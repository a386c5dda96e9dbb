"""Exact top-k search by BM25 over shards of an inverted index, with block-max pruning.

Documents are dealt to shards of a fixed text size. A shard's index has, per term,
postings in document order; the most frequent terms are laid out document by
document as well, with the largest impact (32 bits, rounded up) of each block of
``BLOCK_DOCS`` documents. Queries are searched ``TOGETHER`` at a time. Each reads the
postings of its rarer terms; block maxima then bound what its frequent terms can add,
and documents that stay below the k-th best score are skipped. Queries with which many
remain read their frequent terms for all documents in one product of matrices, which
costs less there. Documents that reach the k-th best score but for rounding are scored
in 64 bits, from counts and lengths.

A task has the indexes of one shard, one after the other in memory, and the queries
once, in an anonymous file beyond ``HELD_QUERIES``; what a query found in one index
bounds it in the next. So queries are copied once per task, of which there are some
per core or one per ``INDEXES`` indexes, and not once per index. Every shard returns
its best k by global statistics (documents, mean length, document frequencies), so
merging by score gives the exact best k of all.

Terms are words of the shared word rule, held as 64-bit hashes (XXH64). A query is
a whole text; a term counts as often as the query has it. Ties in score go to the
smaller id, a null id first.

Defined cases: null, empty and wordless texts have no terms, are found by no query
and find nothing, also where a shard holds no others; repeated documents are found each; queries that repeat id and text are
one query; fewer than k documents with a common term give fewer rows; an empty
table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from limpid.llm.common import byte_slices, give_back, one_thread, reuse_freed, tidy
from limpid.session import stage

K1, B = 1.2, 0.75
TOP = 10
BLOCK_DOCS = 32
# terms of more than this part of the documents are laid out, the most frequent up to so many numbers
FREQUENT = 1 / 16
CELLS = 8 << 20
# part of the documents from which a query reads its frequent terms for all
MANY = 0.1
# a query in so many is bounded by block maxima even where that did not pay
SELDOM = 16
# postings of a short list
FEW = 64
SHARD_TEXT = 64 << 20  # of an index
# queries searched at a time; bytes of queries that a task holds in memory
TOGETHER = 128
HELD_QUERIES = 32 << 20
# tasks per core as long as there are indexes; indexes of a task at most
TASKS, INDEXES = 4, 16

# stands for a null id inside an index
NO_ID = -(1 << 63)

# bytes of text that are cut into words at a time, and postings held at a time
SLICE = 4 << 20
HELD = 1 << 20
# the word rule byte by byte: letters in lower case, a space for what separates words
_BYTES = bytes(ord(" ") if b < 128 and not chr(b).isalnum() else b | 32 if 65 <= b <= 90 else b for b in range(256))


class TermHasher:
    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        """XXH64 of words, none of which holds a space."""
        if not len(words):
            return np.zeros(0, np.uint64)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
        return np.fromiter(map(xxhash.xxh64_intdigest, line[0].as_buffer().to_pybytes().split(b" ")), np.uint64, len(words))

    def _pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order; number of text and hash, and count, of every distinct term; and the words of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])) if len(texts) and at[-1] > at[0] else b""
        # what separates words becomes a space, byte by byte, so that texts begin where they did
        plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[:1]).tobytes()), pa.py_buffer(bytes(data).translate(_BYTES)))
        cut = pc.ascii_split_whitespace(plain)
        words, of = cut.flatten().dictionary_encode(), np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())
        hashes, number = self._hashes(words.dictionary), words.indices.to_numpy()
        spelled = pc.binary_length(words.dictionary).to_numpy() > 0
        if not spelled.all():  # what stands before a leading separator
            kept = spelled[number]
            of, number = of[kept], number[kept]
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        pairs, n = np.unique(of * len(order) + place[number], return_counts=True)
        total = np.bincount(of, minlength=len(texts))
        of, number = np.divmod(pairs, max(1, len(order)))
        return hashes[order], of, number, n, total

    def count_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term hash and count of every distinct term, in the order of both; and the words of each text."""
        hashes, of, number, n, total = self._pairs(texts)
        return of, hashes[number], n, total

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct term hashes in order, how often each stands there, and the number of words."""
        _, terms, n, words = self.count_all(pa.array([text]))
        return terms, n, int(words[0])


def _document_frequencies():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                hashes, _, number, n, _ = hasher._pairs(part.column("text"))
                df = np.bincount(number, minlength=len(hashes))
                # whole numbers below 2**53 are exact
                words = np.bincount(number, weights=n, minlength=len(hashes)).astype(np.int64)
                met = df > 0
                yield pa.RecordBatch.from_arrays([pa.array(hashes[met].view(np.int64)), pa.array(df[met]), pa.array(words[met])], names=["term", "df", "words"])

    return run


def _query_terms():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TermHasher()
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                of, terms, n, _ = hasher.count_all(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("query_id").take(pa.array(of)), part.column("query_row").take(pa.array(of)),
                    pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64)),
                ], names=["query_id", "query_row", "term", "n"])

    return run


class ShardIndex:
    """Postings of one shard; documents are added, then ``close`` sorts them by term and lays out the frequent ones."""

    def __init__(self, mean_words: float):
        self.mean = mean_words
        self.ids: list[int] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list[int], counted: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        of = np.repeat(np.arange(len(ids)), [len(t) for t, _, _ in counted])
        self.add_all(ids, of, np.concatenate([t for t, _, _ in counted]), np.concatenate([n for _, n, _ in counted]), np.array([w for _, _, w in counted]))

    def add_all(self, ids: list[int], of: np.ndarray, terms: np.ndarray, n: np.ndarray, words: np.ndarray) -> None:
        """Documents as ``TermHasher.count_all`` gives them."""
        self.parts.append((terms, (of + len(self.ids)).astype(np.int32), n.astype(np.min_scalar_type(int(n.max(initial=0))))))
        self.ids += ids
        self.lengths.append(words)

    def impacts(self, doc: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each posting adds to a score, per unit of the query's weight."""
        return tf * (K1 + 1) / (tf + self.norm[doc])

    def close(self) -> "ShardIndex":
        terms, docs, counts = zip(*self.parts)
        self.parts = []
        self.norm = K1 * (1 - B + B * np.concatenate(self.lengths).astype(np.float64) / self.mean)
        self.id_array = np.array(self.ids, dtype=np.int64)
        # postings in the order they came in, document by document, then term by term
        doc, self.doc_tf = np.concatenate(docs), np.concatenate(counts)
        self.doc_at = np.searchsorted(doc, np.arange(len(self.ids) + 1, dtype=np.int32))
        term = np.concatenate(terms)
        del terms, docs, counts
        # inside a term those that stand once come first; what is not needed any more is given up at once
        order = np.argsort(self.doc_tf > 1, kind="stable").astype(np.int32 if len(term) < 1 << 31 else np.int64)
        order = order[np.argsort(term[order], kind="stable")]
        term = term[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(term)), bool), term[1:] != term[:-1]]))
        self.terms, self.term_edge = term[starts], np.append(starts, len(term))  # postings of a term
        del term
        # small numbers, since reading postings waits for memory
        self.doc, self.tf = doc[order].astype(np.uint16 if len(self.ids) <= 1 << 16 else np.uint32), self.doc_tf[order]
        del doc
        self.doc_term = np.empty(len(order), dtype=np.int32)
        self.doc_term[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(self.term_edge))
        del order
        # of a term that stands there once, per document; and how much more one gives that stands there often
        self.once = self.impacts(np.arange(len(self.ids)), np.ones(len(self.ids)))
        often = np.flatnonzero(self.tf > 1)
        self.often_at = np.searchsorted(often, self.term_edge)
        self.more = np.empty(len(often), dtype=np.float32)
        for a in range(0, len(often), HELD):
            at = often[a:a + HELD]
            self.more[a:a + HELD] = self.impacts(self.doc[at], self.tf[at]) / self.once[self.doc[at]]
        del often
        self._open()
        self.asked = np.zeros(len(self.terms), bool)  # the terms of the query at hand
        self.weight = np.zeros(len(self.terms))
        self.rooms: dict[int, np.ndarray] = {}
        self.tried = self.pruned = 0
        give_back()
        return self

    def _open(self) -> None:
        """Lay out the most frequent terms document by document, with the largest impact of each block."""
        df, documents = np.diff(self.term_edge), len(self.ids)
        often = np.flatnonzero(df > FREQUENT * documents)
        often = often[np.argsort(-df[often], kind="stable")[:max(1, CELLS // max(1, documents))]]
        self.row = np.full(len(self.terms), -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        blocks = -(-documents // BLOCK_DOCS)
        self.cells, self.entry_max = np.zeros((len(often), documents), np.float32), np.zeros((len(often), blocks), np.float32)
        for row, t in enumerate(often.tolist()):
            span = slice(self.term_edge[t], self.term_edge[t + 1])
            impact = self.impacts(self.doc[span], self.tf[span])
            self.cells[row, self.doc[span]] = impact
            largest = np.zeros(blocks)
            np.maximum.at(largest, self.doc[span] // BLOCK_DOCS, impact)
            self.entry_max[row] = np.nextafter(largest.astype(np.float32), np.float32(np.inf))

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)

    @staticmethod
    def _cuts(size: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of rows that hold about ``HELD`` postings each, one row at least."""
        group = (np.cumsum(size) - size) // HELD
        edges = np.flatnonzero(np.diff(group)) + 1
        return list(zip([0, *edges.tolist()], [*edges.tolist(), len(size)])) if len(size) else []

    def _read(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the postings of the terms ``at`` give every document, rounded."""
        total, size = np.zeros(len(self.ids)), self.term_edge[at + 1] - self.term_edge[at]
        order = np.argsort(size > FEW, kind="stable")
        at, weights, size = at[order], weights[order], size[order]
        begin, often, few = self.term_edge[at], self.often_at[at], np.searchsorted(size > FEW, True)
        often_size = self.often_at[at + 1] - often
        for a, b in self._cuts(size):
            m = min(max(a, few), b)  # short lists are picked, long ones copied
            doc = [self.doc[x:x + n] for x, n in zip(begin[m:b].tolist(), size[m:b].tolist())]
            doc = np.concatenate([self.doc[self._ranges(begin[a:m], size[a:m])], *doc])
            weight = np.repeat(weights[a:b], size[a:b])
            # a term's postings are those that stand once, then the others
            n = often_size[a:b]
            weight[self._ranges(np.cumsum(size[a:b]) - n, n)] *= self.more[self._ranges(often[a:b], n)]
            total += np.bincount(doc.astype(np.intp), weights=weight, minlength=len(total))
        return total * self.once

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs`` for the query at hand, in 64 bits; each sum takes a document's terms in their order."""
        begin, size, out = self.doc_at[docs], self.doc_at[docs + 1] - self.doc_at[docs], []
        for a, b in self._cuts(size):
            posting = self._ranges(begin[a:b], size[a:b])
            term = self.doc_term[posting]
            met = np.flatnonzero(self.asked[term])
            of = np.repeat(np.arange(b - a), size[a:b])[met]
            out.append(np.bincount(of, weights=self.impacts(docs[a:b][of], self.doc_tf[posting[met]]) * self.weight[term[met]], minlength=b - a))
        return np.concatenate(out) if out else np.zeros(0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k documents."""
        return self.search_all(np.array([0, len(terms)]), terms, weights, k, np.zeros(1))[0]

    def search_all(self, edges: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best k documents of each query, of those that reach its ``floor``.

        The terms and weights of query i are those from ``edges[i]`` to ``edges[i + 1]``.
        """
        # arrays of queries times documents stay within ``CELLS``
        some, out = max(1, min(TOGETHER, CELLS // max(1, len(self.ids)))), []
        for a in range(0, len(floor), some):
            cut = edges[a:min(a + some, len(floor)) + 1]
            out += self._search(cut - cut[0], terms[cut[0]:cut[-1]], weights[cut[0]:cut[-1]], k, floor[a:a + some])
        return out

    def _search(self, edges: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        none = (np.zeros(0, np.int64), np.zeros(0))
        if not len(self.terms) or not len(terms):
            return [none] * len(floor)
        documents = len(self.ids)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == terms)
        query, at, weights = np.repeat(np.arange(len(floor)), np.diff(edges))[here], at[here], weights[here]
        row, edges = self.row[at], np.searchsorted(query, np.arange(len(floor) + 1))
        often = np.flatnonzero(row >= 0)
        wanted = np.zeros((len(floor), len(self.cells)), np.float32)
        wanted[query[often], row[often]] = weights[often]
        # what the frequent terms of a query can add to the documents of a block
        more = wanted @ self.entry_max
        rarer, found, everywhere = self._room(0, len(floor)), [none] * len(floor), []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[i], edges[i + 1])
            rare = row[own] < 0
            rarer[i] = self._read(at[own][rare], weights[own][rare])
            # sums of rounded numbers must not hide a document
            slack = 1 + (edges[i + 1] - edges[i] + 8) * 2.0 ** -22
            # where bounds have been of no use, they are tried for some queries only
            left = self._left(rarer[i], wanted[i], more[i], floor[i], k, slack) if i % SELDOM == 0 or self.pruned * SELDOM >= self.tried else None
            if left is None:
                everywhere.append((i, slack))
                continue
            reached = rarer[i][left]
            for r in np.flatnonzero(wanted[i]).tolist():
                reached += self.cells[r][left] * wanted[i, r]
            found[i] = self._best(left, reached, k, slack, floor[i], at[own], weights[own])
        if everywhere:
            total = self._read_all(wanted, np.array([i for i, _ in everywhere]))
            for (i, slack), reached in zip(everywhere, total, strict=True):
                reached += rarer[i]
                own = slice(edges[i], edges[i + 1])
                found[i] = self._best(None, reached, k, slack, floor[i], at[own], weights[own])
        return found

    def _left(self, rarer: np.ndarray, wanted: np.ndarray, more: np.ndarray, floor: float, k: int, slack: float) -> np.ndarray | None:
        """Documents that may be among the best by the maxima of their blocks, if these are few."""
        documents, least = len(rarer), floor or self._reached(rarer, wanted, k)
        block = np.maximum.reduceat(rarer, np.arange(0, documents, BLOCK_DOCS)) + more
        block = np.flatnonzero((block > 0) & (block * slack >= least))
        left = (block[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        left = left[left < documents]
        ceiling = rarer[left] + more[left // BLOCK_DOCS]
        left = left[(ceiling > 0) & (ceiling * slack >= least)]
        self.tried += 1
        if len(left) > MANY * documents:
            return None
        self.pruned += 1
        return left

    def _reached(self, rarer: np.ndarray, wanted: np.ndarray, k: int) -> float:
        """A score that k documents reach but for rounding, if there are as many."""
        if len(rarer) <= k:
            return 0.0
        leading, rows = np.argpartition(rarer, len(rarer) - k)[-k:], np.flatnonzero(wanted)
        return float((rarer[leading] + np.einsum("i,ij->j", wanted[rows], self.cells[rows[:, None], leading])).min())

    def _read_all(self, wanted: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """What the frequent terms of each of ``queries`` give every document, rounded."""
        return np.matmul(wanted[queries], self.cells, out=self._room(1, len(queries)))

    def _room(self, which: int, queries: int) -> np.ndarray:
        """Place for a number per query and document, the same each time; new pages would cost as much as the sums."""
        if which not in self.rooms or len(self.rooms[which]) < queries:
            self.rooms[which] = np.empty((queries, len(self.ids)), np.float32)
        return self.rooms[which][:queries]

    def _best(self, docs: np.ndarray | None, reached: np.ndarray, k: int, slack: float, floor: float, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of ``docs`` (null: all), which have ``reached`` these scores but for rounding, for a query's terms."""
        high = np.flatnonzero(reached >= floor / slack if floor > 0 else reached > 0)
        if len(high) > k:
            score = reached[high]
            high = high[score >= np.partition(score, len(high) - k)[len(high) - k] / slack]
        if not len(high):
            return np.zeros(0, np.int64), np.zeros(0)
        docs = high if docs is None else docs[high]
        self.asked[at], self.weight[at] = True, weights
        try:
            score = self._scores(docs)
        finally:
            self.asked[at] = False
        docs, score = docs[score > 0], score[score > 0]
        best = np.lexsort((self.id_array[docs], -score))[:k]
        return self.id_array[docs[best]], score[best]


class Queries:
    """The queries of a task, kept as Arrow batches, with the best that each has found so far."""

    def __init__(self, k: int):
        self.k, self.file, self.writer = k, tempfile.SpooledTemporaryFile(max_size=HELD_QUERIES), None
        self.ids, self.rows = [], []

    def add(self, asked: pa.RecordBatch) -> None:
        if self.writer is None:
            self.writer = pa.ipc.new_stream(self.file, pa.schema([asked.schema.field(n) for n in ("terms", "weights")]))
        self.ids.append(asked.column("id"))
        self.rows.append(asked.column("row"))
        for a in range(0, asked.num_rows, TOGETHER):
            part = asked.slice(a, TOGETHER)
            self.writer.write_batch(pa.RecordBatch.from_arrays([part.column(n) for n in ("terms", "weights")], names=["terms", "weights"]))

    def close(self) -> "Queries":
        if self.writer is not None:
            self.writer.close()
        count = sum(map(len, self.ids))
        self.found, self.best, self.score = np.zeros(count, np.int64), np.zeros((count, self.k), np.int64), np.zeros((count, self.k))
        return self

    def search(self, index: ShardIndex) -> None:
        if self.writer is None or not len(index.terms):
            return
        self.file.seek(0)
        at = 0
        for batch in pa.ipc.open_stream(self.file):
            terms, weights = batch.column("terms"), batch.column("weights")
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
            terms, weights = terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy()
            # a document must reach the last of k that are found already
            found = index.search_all(edges, terms, weights, self.k, np.where(self.found[at:at + batch.num_rows] == self.k, self.score[at:at + batch.num_rows, -1], 0.0))
            for i, (ids, scores) in enumerate(found, at):
                if len(ids):
                    self._merge(i, ids, scores)
            at += batch.num_rows

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        n = self.found[i]
        ids, scores = np.append(self.best[i, :n], ids), np.append(self.score[i, :n], scores)
        best = np.lexsort((ids, -scores))[:self.k]
        self.found[i] = len(best)
        self.best[i, :len(best)], self.score[i, :len(best)] = ids[best], scores[best]

    def told(self) -> Iterator[pa.RecordBatch]:
        """(query_id, query_row, doc_id, score) of the best of each."""
        if not self.ids:
            return
        ids, rows = pa.chunked_array(self.ids), pa.chunked_array(self.rows)
        for a in range(0, len(self.found), 4096):
            some = slice(a, a + 4096)
            kept = np.arange(self.k) < self.found[some, None]
            of = pa.array(a + np.repeat(np.arange(len(kept)), self.found[some]))
            best = self.best[some][kept]
            if len(best):
                yield pa.RecordBatch.from_arrays([
                    ids.take(of).combine_chunks(), rows.take(of).combine_chunks(), pa.array(best, mask=best == NO_ID), pa.array(self.score[some][kept]),
                ], names=["query_id", "query_row", "doc_id", "score"])


def _search_shards(mean_words: float, k: int):
    """Streams the rows of a shard, queries before the documents of each index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        reuse_freed()
        hasher, queries, index, now = TermHasher(), Queries(k), None, None

        def closed() -> None:
            nonlocal index
            if index is not None and queries.ids:
                queries.search(index.close())
            index = None
            give_back()

        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                # texts and the terms of a query stay in their buffers
                rows = part.select(["shard", "part", "id"]).to_pydict()
                cut = [i for i in range(part.num_rows) if i == 0 or (rows["shard"][i], rows["part"][i]) != (rows["shard"][i - 1], rows["part"][i - 1])]
                for a, b in zip(cut, [*cut[1:], part.num_rows]):
                    if rows["part"][a] < 0:
                        queries.add(part.slice(a, b - a))
                        continue
                    if (rows["shard"][a], rows["part"][a]) != now:
                        if now is None:
                            queries.close()
                        closed()
                        now, index = (rows["shard"][a], rows["part"][a]), ShardIndex(mean_words)
                    index.add_all([NO_ID if x is None else x for x in rows["id"][a:b]], *hasher.count_all(part.column("text").slice(a, b - a)))
            give_back()  # what cutting texts has freed lies between the parts that are kept
        if now is not None:
            closed()
            yield from queries.told()

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) for the rows of ``queries`` (id, text) against all of ``docs``."""
    corpus = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.xxhash64(id_column, text).alias("query_row"), F.col(text).alias("text"))
    asked = asked.where(F.length("text") > 0).dropDuplicates(["query_id", "query_row"])
    count, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    indexes = max(1, -(-(size or 0) // SHARD_TEXT))
    shards = min(indexes, max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, -(-indexes // INDEXES)), 1 << 15)
    parts = -(-indexes // shards)
    told = corpus.select("text").mapInArrow(tidy(_document_frequencies()), "term long, df long, words long")
    # the terms' counts also give the mean length, so that texts are cut into words once for both
    df = stage(told.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "search-terms")
    words = (df.agg(F.sum("words")).first()[0] or 0) / (count or 1)
    df = df.select("term", "df")
    terms = asked.mapInArrow(tidy(_query_terms()), "query_id long, query_row long, term long, n long")
    idf = F.log(1 + (F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").groupBy("query_id", "query_row").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("n") * idf).alias("w")))).alias("t"))
    held = stage(weighted, "search-queries")
    # the stated queries meet every shard; what they find there is k rows each
    ask = held.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "query_row", "t").select(
        "shard", F.lit(-1).alias("part"), F.col("query_id").alias("id"), F.col("query_row").alias("row"), F.lit(None).cast("string").alias("text"),
        F.col("t.term").alias("terms"), F.col("t.w").alias("weights"),
    )
    dealt = F.pmod(F.xxhash64("id", "text"), F.lit(shards * parts))
    own = corpus.select(
        (dealt % shards).cast("int").alias("shard"), F.call_function("div", dealt, F.lit(shards)).cast("int").alias("part"), "id", F.lit(None).cast("long").alias("row"), "text",
        F.lit(None).cast("array<bigint>").alias("terms"), F.lit(None).cast("array<double>").alias("weights"),
    )
    # each shard has a task of its own, which a hash of its number would not give
    met = own.unionByName(ask).repartitionById(shards, "shard").sortWithinPartitions("shard", "part", "id")
    found = met.mapInArrow(_search_shards(float(words or 1.0) or 1.0, k), "query_id long, query_row long, doc_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
