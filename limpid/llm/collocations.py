"""Phrases of two or three words that stand together more often than their parts explain.

Every n-gram of whole texts is hashed by prefix polynomials (``ngram_prints``).
A task gathers its fingerprints into sorted blocks, dealt by ranges of fingerprints;
a shuffle brings the blocks of a range together, where counts are added. Only
fingerprints that are frequent go on, each with the key of a document that holds
it: these documents are joined, hashed again, and the phrases are read out of them
where fingerprint and check agree. Fingerprints under which different checks met
are collisions: their phrases are counted anew from the texts, by the words
themselves. Frequent phrases alone are ever written as text; their parts are
frequent too, so scores come from joins of that table with itself.

Ranges are so many that one takes about ``RANGE_BYTES`` of text. Beyond ``FAN`` ranges
they are dealt in rounds, each cutting the ranges of the round before into about as
many, so that every round has many tasks; only the last one gathers whole ranges. A frequent word or phrase is one
record per block, however often it stands. Counts and scores are whole numbers;
products are decimals of 38 digits, which counts below 10^15 cannot leave.

Defined cases: null text is empty, null lang is ``und``; an empty table gives an
empty result; repeated rows count as often as they stand; a phrase never reaches
over the end of a piece or text; only id, text and lang are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.llm.common import byte_slices, give_back, tidy
from limpid.llm.ngram_prints import DIFFER, MODULI, Block, Prints, combine, read_words
from limpid.session import stage

SIZES = (1, 2, 3)
FREQUENT = 10
TOP = 2000
SCALE = 1_000_000
SLICE = 1 << 19
TURNS = 4
HELD = 6_000_000
"""n-grams that a task holds before it gives out blocks."""
RANGE_BYTES = 8 << 20
FAN = 4096
CLASHES = 1_000_000
"""Collided fingerprints that are counted anew in one pass; more take more passes."""

BLOCKS = "range int, lang string, n int, words bigint, size int, data binary"
FOUND = "lang string, n int, print bigint, check bigint, key bigint, a bigint"


def _given(docs: DataFrame) -> DataFrame:
    """(lang, text, key): the key tells rows apart well enough to find one again, not for certain."""
    text = F.coalesce("text", F.lit(""))
    key = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 31)).alias("key")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"), key)


def _by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], pa.RecordBatch]]:
    langs = part.column("lang")
    for lang in langs.unique():
        some = part.filter(pa.compute.equal(langs, lang))
        yield lang.as_py(), some.column("text").cast(pa.binary()).to_pylist(), some


def _rows(blocks: dict[tuple[str, int], Block], width: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted blocks by ranges of fingerprints."""
    for (lang, n), block in blocks.items():
        if not len(block):
            continue
        at = np.flatnonzero(np.diff(block.prints // np.uint64(width), prepend=np.uint64(1 << 63)))
        ends = np.append(at[1:], len(block))
        for i in range(0, len(at), 64):
            made = []
            for a, b in zip(at[i:i + 64], ends[i:i + 64], strict=True):
                piece = block.slice(a, b)
                words = int(piece.counts.sum()) if n == 1 else 0
                made.append((int(piece.prints[0]) // width, lang, n, words, len(piece), piece.pack()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                names=["range", "lang", "n", "words", "size", "data"])


def _let_go(held: dict[tuple[str, int], list[Block]], width: int) -> Iterator[pa.RecordBatch]:
    """Give out all that is held, some ranges of one language and size after the other, so that little is held twice."""
    for k in list(held):
        blocks = held.pop(k)
        for i in range(TURNS):
            yield from _rows({k: combine([b.take(b.prints // np.uint64(width) % np.uint64(TURNS) == i) for b in blocks])}, width)
    give_back()


def _fingerprints(prints: Prints, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[Block]] = {}
        total = 0
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                for lang, texts, some in _by_lang(part):
                    words, key = read_words(texts), some.column("key").to_numpy().astype(np.uint32)
                    for n, (first, found, checks) in prints.of(words, SIZES).items():
                        held.setdefault((lang, n), []).append(Block(found, checks, key[words.text[first]], np.ones(len(found), np.uint8)))
                        total += len(found)
                if total > HELD:
                    yield from _let_go(held, width)
                    total = 0
        yield from _let_go(held, width)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[tuple[tuple[int, str, int], int, Block]]:
    """Blocks of one range, language and size, which come next to each other, as one; or as several of about ``HELD``."""
    last, held, words, size_held, limit = None, [], 0, 0, HELD
    for batch in batches:
        for part in byte_slices(batch, "data"):
            for r, lang, n, w, size, data in zip(*(part.column(c).to_pylist() for c in part.schema.names), strict=True):
                if (r, lang, n) != last:
                    if held:
                        yield last, words, combine(held)
                    last, held, words, size_held, limit = (r, lang, n), [], 0, 0, HELD
                held.append(Block.unpack(data, size))
                words += w
                size_held += size
                if size_held <= limit or len(held) == 1:
                    continue
                held = [combine(held)]
                size_held = len(held[0])
                if whole:  # made one block again when it has doubled, so that none is sorted over and over
                    limit = max(HELD, 2 * size_held)
                elif size_held > HELD // 2:
                    yield last, words, held[0]
                    held, words, size_held = [], 0, 0
    if held:
        yield last, words, combine(held)


def _narrower(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang, n), _words, block in _grouped(batches, whole=False):
            yield from _rows({(lang, n): block}, width)

    return run


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lang, n), words, block in _grouped(batches):
            often = np.flatnonzero(block.counts >= np.uint64(least))
            columns = [block.prints[often].astype(np.int64), block.checks[often].astype(np.int64),
                       block.keys[often].astype(np.int64), block.counts[often].astype(np.int64)]
            if words:  # all words of the block, frequent or not, as size 0
                columns = [np.append(c, v) for c, v in zip(columns, (0, 0, 0, words), strict=True)]
            sizes = np.full(len(columns[0]), n, np.int32)
            if words:
                sizes[-1] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(sizes), pa.string()), pa.array(sizes), *map(pa.array, columns)],
                names=["lang", "n", "print", "check", "key", "a"])

    return run


def _rounds(ranges: int, fan: int) -> list[int]:
    """Number of ranges after each round: as few rounds as cut none into more than ``fan``, which cut alike."""
    times = 1
    while fan ** times < ranges:
        times += 1
    return [*(math.ceil(ranges ** (i / times)) for i in range(1, times)), ranges]


def frequent_prints(docs: DataFrame, least: int = FREQUENT, moduli: tuple[int, int, int] = MODULI, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """(lang, n, print, check, key, a) of frequent n-grams; as size 0, words per language in parts."""
    given, prints = _given(docs), Prints(moduli)
    text_bytes = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = text_bytes // range_bytes + 1
    rounds = _rounds(ranges, fan)
    widths = [prints.span // r + 1 for r in rounds]
    blocks = given.mapInArrow(tidy(_fingerprints(prints, widths[0])), BLOCKS)
    for i, parts in enumerate(rounds):
        met = blocks.repartition(parts, "range").sortWithinPartitions("range", "lang", "n")
        last = i + 1 == len(rounds)
        blocks = met.mapInArrow(tidy(_frequent(least) if last else _narrower(widths[i + 1])), FOUND if last else BLOCKS)
    return blocks


def _read_out(prints: Prints):
    """Phrases of the wanted fingerprints, out of the document that is said to hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                rows = []
                for lang, text, wanted in zip(*(part.column(c) for c in ("lang", "text", "wanted")), strict=True):
                    words = read_words([text.as_py().encode()])
                    made = prints.of(words, SIZES)
                    seek = wanted.values.flatten()
                    n, found, check, a = (x.to_numpy() for x in seek)
                    for size, (first, p, c) in made.items():
                        mine = np.flatnonzero(n == size)
                        if not mine.size or not p.size:
                            continue
                        order = np.argsort(p)
                        at = order[np.minimum(np.searchsorted(p, found[mine].astype(np.uint64), sorter=order), len(p) - 1)]
                        same = (p[at] == found[mine].astype(np.uint64)) & (c[at] == check[mine])
                        rows += [(lang.as_py(), size, words.phrase(int(first[i]), size).decode(), int(x)) for i, x in zip(at[same], a[mine][same], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                        names=["lang", "n", "phrase", "a"])

    return run


def _count_again(prints: Prints, wanted: dict[tuple[str, int], np.ndarray]):
    """Occurrences of phrases under the wanted fingerprints, by their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                rows = []
                for lang, texts, _some in _by_lang(part):
                    words = read_words(texts)
                    for n, (first, found, _checks) in prints.of(words, SIZES).items():
                        hit = first[np.isin(found, wanted[lang, n])] if (lang, n) in wanted else ()
                        rows += [(lang, n, p.decode(), c) for p, c in Counter(words.phrase(int(i), n) for i in hit).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                        names=["lang", "n", "phrase", "a"])

    return run


PHRASES = "lang string, n int, phrase string, a bigint"


def frequent_phrases(docs: DataFrame, least: int = FREQUENT, moduli: tuple[int, int, int] = MODULI, **dealing) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, a) of the frequent phrases, words included, and (lang, words) of all words."""
    prints = Prints(moduli)
    found = stage(frequent_prints(docs, least, moduli, **dealing), "phrase-prints")
    words = found.where("n = 0").groupBy("lang").agg(F.sum("a").alias("words"))
    clash = found.where((F.col("n") > 0) & (F.col("check") == DIFFER)).select("lang", "n", "print")
    # a document is asked for its own n-grams only
    wanted = found.where((F.col("n") > 0) & (F.col("check") != DIFFER)).groupBy("lang", "key").agg(
        F.collect_list(F.struct("n", "print", "check", "a")).alias("wanted"))
    asked = _given(docs).join(wanted, ["lang", "key"]).select("lang", "text", "wanted")
    # rows of the same key may hold the same phrase
    phrases = asked.mapInArrow(tidy(_read_out(prints)), PHRASES).distinct()
    clashes = clash.count()
    for i in range(-(-clashes // CLASHES)):
        # one block of a bounded number of fingerprints for each pass over the texts
        block: dict[tuple[str, int], list[int]] = {}
        for r in clash.orderBy("lang", "n", "print").offset(i * CLASHES).limit(CLASHES).toLocalIterator():
            block.setdefault((r["lang"], r["n"]), []).append(r["print"])
        again = _given(docs).mapInArrow(tidy(_count_again(prints, {k: np.array(v, np.uint64) for k, v in block.items()})), PHRASES)
        phrases = phrases.unionByName(again.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    return stage(phrases, "phrases"), words


def _part(first: int, last: int) -> Column:
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def collocations(docs: DataFrame, top: int = TOP, least: int = FREQUENT, **dealing) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases by their weakest cut."""
    phrases, words = frequent_phrases(docs, least, **dealing)
    split = phrases.where("n > 1").select("lang", "n", "phrase", "a", F.split("phrase", " ").alias("w"))
    cut = lambda k, n: F.struct(F.lit(k).alias("k"), _part(1, k).alias("left"), _part(k + 1, n).alias("right"))
    cuts = F.when(F.col("n") == 2, F.array(cut(1, 2))).otherwise(F.array(cut(1, 3), cut(2, 3)))
    parted = split.select("lang", "phrase", "a", F.inline(cuts))
    known = phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    scored = parted.join(known, ["lang", "left"]).join(known.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", whole("a") * whole("a") * F.lit(SCALE).cast("decimal(7,0)"), whole("l") * whole("r"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    inner = F.explode(F.array(_part(1, 2), _part(2, 3))).alias("phrase")
    longer = split.where("n = 3").select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
