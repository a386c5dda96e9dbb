"""Benchmark decontamination by a prefix-filtered set join. Only functions of Spark SQL.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one
window). A document holds a window only if it holds all its words, so one word of
the window, its prefix, must match: the rarest by the counts of the whole corpus.
Document words join these prefix words only. A match at a place fixes where the
window would start (positional bound), it must fit into the document (length
bound), and the item-sized run of words there must be the window, word for word.

Every text is cut into words once; its words are a shared table, which the counts, the
places and the number of words are read from.

The windows are broadcast while the benchmark's texts take ``BROADCAST_BYTES`` at
most, which is measured; beyond that Spark joins by shuffling the document words
that are prefix words of some window, with the words around them.

Defined cases: null and empty texts and items have no words and no windows;
repeated rows and documents with the same id are judged each by its own text;
repeated items count once; an empty table gives an empty result or no hits;
only the id and the text of either table are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm.common import fresh_name, lower_ascii
from limpid.session import stage

WINDOW = 10
BROADCAST_BYTES = 4 << 20
# what is no part of a WORD
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # cutting between words costs a third of extracting them, which keeps a match object per word
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def _small(benchmark: DataFrame, limit: int) -> bool:
    used = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return used <= limit


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, len, words): each distinct window of each item."""
    item = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    return item.select("item_id", "w", start.alias("at")).select(
        "item_id", F.least(F.size("w"), F.lit(size)).alias("len"),
        F.slice("w", F.col("at") + 1, F.lit(size)).alias("words"),
    ).distinct()


def prefixes(found: DataFrame, spoken: DataFrame, small: bool) -> DataFrame:
    """(word, off, len, window, item_id): every window under its rarest word; ties go to the smaller word, then place."""
    vocabulary = found.select(F.explode("words").alias("word")).distinct()
    each = spoken.select(F.explode("w").alias("word"))
    if small:
        counts = each.join(F.broadcast(vocabulary), "word").groupBy("word").count()
    else:  # counted before the join, so that no frequent word meets in one task
        counts = each.groupBy("word").count().join(vocabulary, "word", "left_semi")
    placed = found.select("item_id", "len", F.concat_ws(" ", "words").alias("window"), F.posexplode("words").alias("off", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("item_id", "len", "window").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "off")).alias("rarest")
    )
    return ranked.select("rarest.word", "rarest.off", "len", "window", "item_id")


def cut_words(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, digest, n_words, w) of every row, written once."""
    # equal rows have equal results; texts of one id are told apart by their digest
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")
    cut = docs.select(F.col(id_column).alias("doc_id"), digest, words(F.col("text")).alias("w"))
    return stage(cut.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"), "w"), "decontaminate-words")


def matches(spoken: DataFrame, benchmark: DataFrame, size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, digest, start, len, item_id): every place of a document (of ``cut_words``) that holds a window."""
    small = _small(benchmark, broadcast_bytes)
    found = windows(benchmark, size)
    keys = stage(prefixes(found, spoken, small), "decontaminate-prefixes")
    placed = spoken.select("doc_id", "digest", "w", F.posexplode("w").alias("pos", "word"))
    start = (F.col("pos") - F.col("off")).alias("start")
    fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.size("w"))
    if small:
        met = placed.join(F.broadcast(keys), "word").where(fits)
        run = F.concat_ws(" ", F.slice("w", F.col("pos") - F.col("off") + 1, F.col("len")))
        return met.where(run == F.col("window")).select("doc_id", "digest", start, "len", "item_id")
    around = placed.select(
        "doc_id", "digest", "pos", "word", F.size("w").alias("n"), F.least(F.col("pos"), F.lit(size - 1)).alias("before"),
        F.slice("w", F.greatest(F.col("pos") - (size - 1), F.lit(0)) + 1, F.lit(2 * size - 1)).alias("w"),
    )
    rare = around.join(keys.select("word").distinct(), "word", "left_semi")
    run = F.concat_ws(" ", F.slice("w", F.col("before") - F.col("off") + 1, F.col("len")))
    met = rare.join(keys, "word").where((F.col("off") <= F.col("before")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n")))
    return met.where(run == F.col("window")).select("doc_id", "digest", start, "len", "item_id")


def judge(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_column: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items, contaminated) of every row."""
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1)))
    spoken = cut_words(docs, id_column)
    hits = matches(spoken, benchmark, size, broadcast_bytes).groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("start", "len")).alias("places"), F.collect_set("item_id").alias("items"),
    ).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    return spoken.join(hits, same, "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged."""
    own_id, own_digest = (fresh_name(c, docs.columns) for c in ("_hit_id", "_hit_digest"))
    hit = matches(cut_words(docs, id_column), benchmark, size).select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest)).distinct()
    marked = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return docs.join(hit, F.col(id_column).eqNullSafe(F.col(own_id)) & (marked == F.col(own_digest)), "left_anti")
