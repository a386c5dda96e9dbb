"""Toxicity of whole texts by a linear-chain conditional random field.

Words of labelled texts are tagged toxic or clean, a two-state chain is learnt
from them, and forward-backward marginals of every word of every text give the
document score and the offending spans. Learning sees a bounded sample (see
``SAMPLE_ROWS``, ``SAMPLE_BYTES``); scoring is a map over all rows without a shuffle.

Defined cases: null and empty texts have no word and get the score that the
calibration gives a text without any toxic word; texts of any length are scored
whole; repeated rows are scored each; rows of labels with a null label or a null
or unknown ``doc_id`` teach nothing; without a single toxic or clean label every
text gets the same score; an empty table gives an empty result; input columns
that are called like an output are replaced.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from limpid.llm import crf
from limpid.llm.common import LOWER, UPPER, WORD, map_texts

# learning: rows of each class at most, and the longest text that may teach
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 12_000
THRESHOLD = 0.7
SPAN_THRESHOLD = 0.5
# word emissions that a task remembers
CACHE_WORDS = 100_000

_TABLE = str.maketrans(UPPER, LOWER)
_WORD = re.compile(WORD)


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_TABLE) if text.isascii() is False else text.lower())


def held_out(doc_id: Column) -> Column:
    """Rows that must not teach: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Distinct texts of labelled rows that are not held out, chosen by a hash of the id, and the share of toxic ones."""
    marked = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label"))
    share = marked.agg(F.avg("_label")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids first: the sample's size is fixed, so it can be broadcast and no text is shuffled
    ids = [marked.where(F.col("_label") == k).select("doc_id", "_label").distinct().orderBy(*order).limit(rows) for k in (0, 1)]
    chosen = docs.select("doc_id", "text").where(F.octet_length("text").between(1, text_bytes)).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    taken = chosen.orderBy(*order, "text", "_label").limit(2 * rows).select("text", "_label").collect()
    got = [{r.text for r in taken if r._label == k} for k in (0, 1)]
    rowset = sorted((t, k) for k in (0, 1) for t in got[k])
    return [t for t, _ in rowset], np.array([k for _, k in rowset], dtype=int), float(share or 0.0)


def train(docs: DataFrame, labels: DataFrame, **bounds) -> crf.Model:
    texts, toxic, share = training_sample(docs, labels, **bounds)
    return crf.fit([words(t) for t in texts], toxic, share)


def _scorer(model: crf.Model, with_spans: bool):
    def start():
        cache: dict[str, float] = {}

        def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
            found = []
            tokens = zip(_WORD.finditer(text.translate(_TABLE)), p >= SPAN_THRESHOLD)
            for toxic, run in groupby(tokens, key=lambda x: x[1]):
                if toxic:
                    run = list(run)
                    found.append((run[0][0].start(), run[-1][0].end()))
            return found

        def work(texts: list[str]) -> list:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            emission, known, values, counts = model.emission, cache.get, [], []
            for text in texts:
                own = words(text)
                counts.append(len(own))
                for w in own:
                    e = known(w)
                    if e is None:
                        e = cache[w] = emission(w)
                    values.append(e)
            counts_ = np.array(counts, dtype=np.int64)
            starts = np.cumsum(counts_) - counts_
            emit = np.array(values, dtype=float)
            first = np.zeros(len(emit), dtype=bool)
            first[starts[counts_ > 0]] = True
            p = crf.marginals(emit, first, model)
            score = crf.document_scores(crf.document_features(p, starts, counts_), model)
            out = [score, (score >= THRESHOLD).astype(np.int32)]
            if with_spans:
                out.append([
                    [{"start": a, "end": b} for a, b in spans(t, p[s:s + n])] if n and (p[s:s + n] >= SPAN_THRESHOLD).any() else []
                    for t, s, n in zip(texts, starts, counts_)
                ])
            return out

        return work

    return start


SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


def score(docs: DataFrame, model: crf.Model, text: str = "text", with_spans: bool = True) -> DataFrame:
    """Append ``score`` (0 to 1), ``predicted`` and ``spans`` (offsets in code points, end exclusive)."""
    outputs = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    if with_spans:
        outputs.append(StructField("spans", ArrayType(SPAN)))
    return map_texts(docs, text, outputs, _scorer(model, with_spans))
