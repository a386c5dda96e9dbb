"""Line dedup over levelled sorted runs of line hashes. Only functions of Spark SQL.

``LineRuns`` keeps, for every line key seen, in how many documents it stood, as a
few sorted runs: tables of (h1, h2, docs), bucketed and sorted by the hashes, so
that runs are merge-joined without a shuffle. A new batch of documents is counted,
the keys that the runs know as frequent already are merge-anti-joined away (their
verdict stands), and the rest become a run of level 0. Two runs of a level are
merged into one of the next, so that n batches leave at most log2(n) + 1 runs and
a key is rewritten as often. ``clean`` drops the lines whose key is frequent.

A key is a line without blanks at its ends and with A-Z lower-cased; two XXH64 of
different seeds stand for it (128 bits). A key counts once per document, before
anything is shuffled. Heavy keys, with more than a thousandth of all places, of which there
can be no more than a thousand, are met by a broadcast of that proven size; so
none of the other keys can fill a task. A batch adds its own heavy keys even
where the runs know them, lest a key grow heavy unseen. Lines are never shuffled, only
their hashes; where a line is to go is brought back by (id, digest of the text).

Runs are tables of the session's catalogue in the shared folder; ``release``
drops them. A lost executor costs the tasks it ran; a run is listed only after
its table is written.

Defined cases: a null or empty text is one empty line; empty keys are never
counted nor dropped; repeated rows are documents of their own and are judged
alike; rows without an id are documents too; a document that loses all its lines
keeps the empty text; an empty table gives an empty result; only the id and text
columns are read, clashing names of other columns do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid.llm.common import BLANK, LOWER, UPPER
from limpid.session import scratch_path, stage

FREQUENT = 10
HEAVY = 1000
"""A key with more than one of so many places is heavy; there are fewer heavy keys than that."""

HASHES = ["h1", "h2"]


def keys_of(text: Column) -> Column:
    """The keys of all lines of a text, in order."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(BLANK)))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def counts(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """(by, h1, h2, docs): documents per line key; the hash comes after the key is made single in its document."""
    seen = docs.select(*by, F.explode(F.array_distinct(keys_of(F.col(f"`{text}`")))).alias("key")).where("key <> ''")
    return seen.groupBy(*by, *hashed(F.col("key"))).agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """Sorted runs of line hashes on levels; see the module."""

    def __init__(self, spark: SparkSession, frequent: int = FREQUENT) -> None:
        self.spark, self.frequent_from = spark, frequent
        # as many buckets as shuffle partitions: a sorted run is then written as it leaves its aggregation
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.places = 0

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
        writer.option("path", scratch_path(self.spark, name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def _merge(self, one: str, other: str, level: int) -> None:
        """Two runs become one of ``level``; both are sorted and dealt alike, so nothing is shuffled."""
        a, b = (self.spark.table(n).withColumnRenamed("docs", c) for n, c in ((one, "a"), (other, "b")))
        docs = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
        self._write(a.join(b, HASHES, "full_outer").select(*HASHES, docs.alias("docs")), level)
        self._drop(one, other)

    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """Add the ``counts`` of a batch as a run, without the keys that are frequent already."""
        places = batch.agg(F.sum("docs")).first()[0] or 0
        self.places += places
        fresh, known = batch.select(*HASHES, "docs"), F.lit(0)
        for i, run in enumerate(self.runs()):
            fresh = fresh.join(self.spark.table(run).withColumnRenamed("docs", f"known{i}"), HASHES, "left")
            known += F.coalesce(f"known{i}", F.lit(0))
        heavy = F.col("docs") * HEAVY > places
        self._write(fresh.where(heavy | (known < self.frequent_from)).select(*HASHES, "docs"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) > 1:
            pair, self.levels[level] = self.levels[level], []
            self._merge(*pair, level + 1)
            level += 1

    def add_documents(self, docs: DataFrame, text: str = "text") -> None:
        self.add(counts(docs, text=text))

    def frequent(self) -> DataFrame:
        """(h1, h2, docs) of the frequent keys; all runs are merged into one for it."""
        while len(self.runs()) > 1:
            one, other, *rest = self.runs()
            top = len(self.levels)
            self.levels = [[n for n in level if n in rest] for level in self.levels]
            self._merge(one, other, top - 1)
        if not self.runs():
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, docs bigint")
        return self.spark.table(self.runs()[0]).where(F.col("docs") >= self.frequent_from)

    def release(self) -> None:
        self._drop(*self.runs())
        self.levels = []


def _identity(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text"))


def dropped_places(docs: DataFrame, frequent: DataFrame, places: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, places): the places of lines with a frequent key, from 0, sorted; documents without any are left out.

    ``places`` is the sum of ``docs`` over all keys, frequent or not.
    """
    # fewer than HEAVY rows, since their documents add up to no more than all places
    heavy = frequent.where(F.col("docs") * HEAVY > places).select(*HASHES, F.lit(True).alias("heavy"))
    lines = _identity(docs, id_column, text).select("doc_id", "digest", F.posexplode(keys_of(F.col("text"))).alias("at", "key"))
    placed = lines.where("key <> ''").select("doc_id", "digest", "at", *hashed(F.col("key")))
    told = placed.join(F.broadcast(heavy), HASHES, "left")
    light = told.where("heavy IS NULL").join(frequent.select(*HASHES), HASHES, "left_semi")
    # equal rows have equal places
    hit = told.where("heavy").unionByName(light).groupBy("doc_id", "digest")
    return hit.agg(F.array_sort(F.collect_set("at")).alias("places"))


def _kept_flags(places: Column, n: Column) -> Column:
    """One boolean per line, from the sorted places that go; its work is the number of lines."""
    before = lambda i: F.coalesce(F.get(places, i - 1), F.lit(-1))
    runs = F.transform(places, lambda p, i: F.array_append(F.array_repeat(F.lit(True), (p - before(i) - 1).cast("int")), F.lit(False)))
    rest = F.array_repeat(F.lit(True), (n - F.element_at(places, -1) - 1).cast("int"))
    return F.concat(F.flatten(runs), rest)


def clean(docs: DataFrame, frequent: DataFrame, places: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``docs``."""
    gone = dropped_places(docs, frequent, places, id_column, text).select(
        F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "places")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    lines = F.split("text", "\n", -1)
    flagged = F.zip_with(lines, _kept_flags(F.col("places"), F.size(lines)), lambda line, keep: F.when(keep, line))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.filter(flagged, lambda x: x.isNotNull()), "\n"))
    return _identity(docs, id_column, text).join(gone, same, "left").select(
        "doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"),
    )


def dedup(docs: DataFrame, batches: int = 4, frequent: int = FREQUENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``clean`` by the counts of all of ``docs``, which come in as so many batches.

    The counts of all batches are taken in one pass over the texts and written by batch.
    """
    spark = docs.sparkSession
    dealt = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(batches)).cast("int").alias("_batch"), F.col(f"`{text}`").alias("text"))
    path = scratch_path(spark, "line-counts")
    counts(dealt, "_batch").write.partitionBy("_batch").parquet(path)
    counted = spark.read.schema("h1 bigint, h2 bigint, docs bigint, _batch int").parquet(path)
    runs = LineRuns(spark, frequent)
    try:
        for b in range(batches):
            runs.add(counted.where(F.col("_batch") == b).drop("_batch"))
        found = stage(runs.frequent(), "frequent-lines")
    finally:
        runs.release()
    return clean(docs, found, runs.places, id_column, text)
