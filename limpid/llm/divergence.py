"""How far the word use of each source is from the other sources of its language.

Duplicate texts are collapsed first: equal texts of a language become one row
per source with a multiplicity, within Arrow slices before anything is shuffled,
then over the whole table by a shuffle on the text itself. A text that stands in
several sources or many times is thus split into terms once, and its counts and
document frequencies are added with its multiplicities. What is left is a sparse
table of (lang, source, term, count, docs).

``probabilities`` keeps the terms of enough documents and smooths in whole
numbers; Spark's decimals hold the products, so no count overflows. ``pairs``
compares sources by blocks of terms: in a block, a source is compared only on the
terms that it has itself; terms that neither of two sources has differ by a
constant, which is multiplied by their number. A task sees one block of terms of
at most ``STRIPE`` by ``STRIPE`` sources and gives one partial sum per pair of them.

Texts that repeat within a slice go through a salted round of their own before
the shuffle on the text, so that a text that holds a third of the table does not
come from every slice to one task. Counts are accumulated per task in
dictionaries that are emptied into rows beyond ``HELD`` entries.

Defined cases: null lang, source and text are read as ''; an empty text gives its
group but no terms; repeated rows count as often as they stand; a language of
which no term is kept has pair values of 0; an empty table gives an empty result;
only the three columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from limpid.llm.common import byte_slices, tidy
from limpid.session import stage

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
STRIPE = 256
BLOCK = 4096
SALTS = 16
REPEATS = 4
"""Copies in a slice from which a text takes the salted round."""
HELD = 400_000
"""Entries of (lang, source, term) that a task holds."""

TEXTS = "lang string, source string, text string, copies bigint"
TERMS = "lang string, source string, term string, count bigint, docs bigint"

# bytes that belong to no term become blanks; A to Z become small; bytes beyond ASCII stay
_TABLE = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _collapse_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["lang", "source", "text"]
    for batch in batches:
        for part in byte_slices(batch, "text", 8 << 20):
            made = pa.Table.from_batches([part]).group_by(keys).aggregate([([], "count_all")])
            made = made.select([*keys, "count_all"]).rename_columns([*keys, "copies"])
            yield from made.combine_chunks().to_batches()


def collapse(docs: DataFrame) -> DataFrame:
    """(lang, source, text, copies) with equal texts of a language next to each other, in one task."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    met = given.mapInArrow(tidy(_collapse_slices), TEXTS).withColumn("often", F.col("copies") >= REPEATS)
    # a text is in many slices only with few copies in each, or here
    salted = met.where("often").withColumn("salt", F.spark_partition_id() % SALTS)
    often = salted.groupBy("lang", "source", "text", "salt").agg(F.sum("copies").alias("copies")).drop("salt")
    every = met.where(~F.col("often")).drop("often").unionByName(often)
    return every.repartition("lang", "text").sortWithinPartitions("lang", "text")


class _Tally:
    """Counts and document counts per group and term, given out as batches of rows."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}

    def add(self, group: tuple[str, str], words: list[bytes], found: Counter | None, copies: int) -> None:
        counts, docs = self.counts.setdefault(group, Counter()), self.docs.setdefault(group, Counter())
        if copies == 1 and found is None:
            counts.update(words)
            docs.update(set(words))
            return
        for term, n in (found or Counter(words)).items():
            counts[term] += n * copies
            docs[term] += copies

    def held(self) -> int:
        return sum(map(len, self.counts.values()))

    def drain(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in self.counts.items():
            docs, terms = self.docs[lang, source], list(counts)
            for i in range(0, len(terms), 50_000):
                some = terms[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                    pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64()),
                ], names=["lang", "source", "term", "count", "docs"])
        self.counts, self.docs = {}, {}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, last, words, found = _Tally(), None, [], None
    for batch in batches:
        for part in byte_slices(batch, "text"):
            for lang, source, text, copies in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text", "copies")), strict=True):
                if (lang, text) != last:
                    last, words, found = (lang, text), terms_of(text), None
                elif found is None:
                    found = Counter(words)
                tally.add((lang, source), words, found, copies)
            if tally.held() > HELD:
                yield from tally.drain()
    yield from tally.drain()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents, of whole texts and all rows."""
    found = collapse(docs).mapInArrow(tidy(_count_terms), TERMS)
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of terms that stand in enough documents of their language, with ``total``, their count in the language.

    One shuffle; the window runs over the sources of a term, one row each, and spills.
    """
    term = Window.partitionBy("lang", "term")
    summed = counted.select("*", F.sum("docs").over(term).alias("d"), F.sum("count").over(term).alias("total"))
    return summed.where(F.col("d") >= min_docs).select("lang", "source", "term", "count", "total")


def _smoothed(count, n, v):
    exact = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(20,0)")
    top, bottom = (exact(count) + F.lit(2)) * F.lit(SCALE).cast("decimal(10,0)"), exact(n) + exact(v) * F.lit(2)
    share = F.call_function("div", top, F.nullif(bottom, F.lit(0).cast("decimal(20,0)")))
    return share.cast("bigint") + F.lit(1)


def gap(p, q):
    """floor((p - q)^2 / (p + q)); below 2^31 each, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def probabilities(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per group (lang, source, place, p0, v), and per kept term of a group (lang, source, term, p, q).

    ``p0`` is the value of a term that the group does not have, ``v`` the number of
    kept terms of the language, ``place`` numbers the groups of a language.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    whole = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    known = groups.join(sizes, ["lang", "source"], "left").join(whole, "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = stage(known.select("lang", "source", place.alias("place"), "n", F.coalesce("v", F.lit(0)).alias("v"), "all"), "divergence-groups")
    each = kept.join(known, ["lang", "source"]).select(
        "lang", "source", "place", "term", _smoothed(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        _smoothed(F.col("total"), F.col("all"), F.col("v")).alias("q"))
    return known.select("lang", "source", "place", "v", _smoothed(F.lit(0), F.col("n"), F.col("v")).alias("p0")), each


def _block_sums(table: pa.Table, stripe_size: int) -> pa.Table:
    """Partial sums of one block of terms and two stripes of sources, for every pair in it."""
    cols = {c: table.column(c).to_numpy() for c in ("place", "a", "b", "p")}
    terms = table.column("term")
    absent = terms.is_null().to_numpy()
    lang, a, b = table.column("lang")[0].as_py(), int(cols["a"][0]), int(cols["b"][0])
    places, at = np.unique(cols["place"], return_inverse=True)
    number = terms.combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False)
    base = np.zeros(len(places), np.int64)
    base[at[absent]] = cols["p"][absent]
    width = int(number.max(initial=0)) + 1
    p = np.repeat(base[:, None], width, 1)
    has = np.zeros(p.shape, bool)
    p[at[~absent], number[~absent]] = cols["p"][~absent]
    has[at[~absent], number[~absent]] = True
    stripe = places // stripe_size
    total, count = np.zeros((len(places), len(places)), np.int64), np.zeros((len(places), len(places)), np.int64)
    for i in range(len(places)):
        mine = np.flatnonzero(has[i])
        if not mine.size:
            continue
        one, others, both = p[i, mine], p[:, mine], has[:, mine]
        f = (others - one) ** 2 // (others + one)
        # [x, y] gathers the terms of x without the shared ones in x's turn, and those of y in y's turn
        total[i] += f.sum(1) - (f * both).sum(1)
        total[:, i] += f.sum(1)
        count[i] += mine.size - both.sum(1)
        count[:, i] += mine.size
    i, j = np.nonzero(np.triu(np.ones(total.shape, bool), 1) & (stripe[:, None] == a) & (stripe[None, :] == b))
    return pa.table({
        "lang": pa.array([lang] * len(i), pa.string()), "s": pa.array(places[i], pa.int64()), "t": pa.array(places[j], pa.int64()),
        "value": pa.array(total[i, j], pa.int64()), "met": pa.array(count[i, j], pa.int64()),
    })


def pairs(groups: DataFrame, each: DataFrame, terms: int, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    ``terms`` is the number of kept terms of all languages; it sets the number of blocks.
    """
    blocks = terms // BLOCK + 1
    last = F.floor(F.max("place").over(Window.partitionBy("lang")) / stripe)
    striped = groups.withColumn("last", last)

    def sided(df: DataFrame) -> DataFrame:
        """Every row for each pair of stripes (a <= b) that its source takes part in."""
        own = F.floor(F.col("place") / stripe)
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))
        return df.select("*", own.alias("own"), other.alias("other")).select(
            "lang", "place", "term", "p", "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("bigint")
    have = each.select("lang", "source", "term", "p", block.alias("block")).join(striped.select("lang", "source", "place", "last"), ["lang", "source"])
    lack = striped.select("lang", "place", "last", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")).where("p IS NOT NULL")
    rows = sided(have.drop("source")).unionByName(sided(lack))
    schema = "lang string, s bigint, t bigint, value bigint, met bigint"
    sums = rows.groupBy("lang", "block", "a", "b").applyInArrow(lambda t: _block_sums(t, stripe), schema)
    summed = sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    summed = summed.unionByName(summed.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value", "met"))
    left = groups.select("lang", F.col("place").cast("bigint").alias("s"), "source", F.col("p0").alias("p"), "v")
    right = groups.select("lang", F.col("place").cast("bigint").alias("t"), F.col("source").alias("item"), F.col("p0").alias("q"))
    # the result itself: one row for every two sources of a language
    every = left.join(right, "lang").where(F.col("s") != F.col("t")).join(summed, ["lang", "s", "t"], "left")
    rest = F.coalesce((F.col("v") - F.coalesce("met", F.lit(0))) * gap(F.col("p"), F.col("q")), F.lit(0))
    return every.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to every other source, and the terms that mark a source."""
    kept = stage(kept_terms(stage(term_counts(docs), "divergence-terms"), min_docs), "divergence-kept")
    groups, each = probabilities(docs, kept)
    each = stage(each, "divergence-each")
    terms = each.select("lang", "term").distinct().count()
    apart = pairs(groups, each, terms, stripe)
    marks = each.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    best = marks.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)
    return found.unionByName(best)
