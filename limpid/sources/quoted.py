"""Text tables whose quoted values may hold line breaks, read in many tasks per file.

Spark splits a text file into byte ranges and a range into lines. Whether a line
begins inside a quoted value depends on all lines before it, but a line is only a
map of two states: outside or inside on entry gives outside or inside on exit.
Maps compose, so a first pass gives one map per range; their prefix over the
ranges of a file, one small row each, gives every range its state on entry. Where
no line leaves a value open, which the first pass shows, Spark's own reader of
single lines is used. Else a second pass marks the lines: those that are a record
by themselves go on as they are, and only lines of records that span several are
shuffled, by the place of their first line, and put together.

A quote opens a value only where a field begins; doubled quotes stand for one. A
break within quotes stays as it is written, with a carriage return if it has one. A
range is what ``spark.sql.files.maxPartitionBytes`` makes of it; a record is never
limited to a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

_INSIDE = '(?:[^"]++|"")*+'
_FIELD = f'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_OPEN = f'"{_INSIDE}$'
FROM_OUTSIDE = f"^(?:{_FIELD},)*+{_OPEN}"
"""A line that begins outside and ends inside a quoted value."""
FROM_INSIDE = f'^{_INSIDE}(?:$|"[^,]*+,(?:{_FIELD},)*+{_OPEN})'
"""A line that begins and ends inside one."""

LINES = "file string, block bigint, line string, to0 int, to1 int"
RANGE = "file string, block bigint, opens bigint, returns bigint, end0 int, end1 int, last0 bigint, last1 bigint, first bigint"
MARKED = "file string, block bigint, at bigint, line string, in0 int, in1 int, out0 int, out1 int, last0 bigint, last1 bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the state they lead to from outside (to0) and from inside (to1)."""
    read = spark.read.option("lineSep", "\n").text(path)
    quoted = F.contains(F.col("value"), F.lit('"'))
    to = lambda pattern, plain: F.when(quoted, F.col("value").rlike(pattern).cast("int")).otherwise(plain)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"),
        to(FROM_OUTSIDE, 0).alias("to0"), to(FROM_INSIDE, 1).alias("to1"),
    )


def _states(to0: np.ndarray, to1: np.ndarray, entry: int) -> np.ndarray:
    """The state after every line, if the first begins in ``entry``."""
    n = len(to0)
    fixed, swaps = to0 == to1, (to0 == 1) & (to1 == 0)
    turned = np.cumsum(swaps)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    known = last >= 0
    base = np.where(known, to0[last], entry)
    return (base + turned - np.where(known, turned[last], 0)) % 2


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of one range; a task reads its ranges one after the other."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        name = batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(name) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.column("file")[int(a)].as_py(), int(block[a]), batch.slice(int(a), int(b - a))


class _Walk:
    """Both possible courses of states through a range, kept from batch to batch."""

    def __init__(self) -> None:
        self.here, self.at, self.state, self.last = None, 0, [0, 1], [-1, -1]

    def step(self, file: str, block: int, part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per course: states before and after the lines, and the first line of the record each belongs to (-1: before the range)."""
        if (file, block) != self.here:
            self.__init__()
            self.here = file, block
        to0, to1 = (part.column(c).to_numpy() for c in ("to0", "to1"))
        number = self.at + np.arange(len(to0))
        courses = []
        for course in (0, 1):
            after = _states(to0, to1, self.state[course])
            before = np.append(self.state[course], after[:-1])
            begun = np.maximum.accumulate(np.where(before == 0, number, self.last[course]))
            self.state[course], self.last[course] = int(after[-1]), int(begun[-1])
            courses.append((before, after, begun))
        self.at += len(to0)
        return courses


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, rows = _Walk(), {}
    for file, block, part in _by_range(batches):
        start = walk.at if walk.here == (file, block) else 0
        walk.step(file, block, part)
        line = part.column("line")
        filled = np.flatnonzero(pa.compute.not_equal(pa.compute.utf8_rtrim(line, "\r"), "").to_numpy(zero_copy_only=False))
        old = rows.get((file, block), (0, 0, 0, 0, 0, 0, -1))
        first = old[6] if old[6] >= 0 or not filled.size else start + int(filled[0])
        opens = old[0] + int(part.column("to0").to_numpy().sum())
        returns = old[1] + int(pa.compute.sum(pa.compute.count_substring(pa.compute.utf8_rtrim(line, "\r"), "\r")).as_py() or 0)
        rows[file, block] = opens, returns, *walk.state, *walk.last, first
    columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True)) or [[]] * 9
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                     names=["file", "block", "opens", "returns", "end0", "end1", "last0", "last1", "first"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk()
    for file, block, part in _by_range(batches):
        start = walk.at if walk.here == (file, block) else 0
        (in0, out0, last0), (in1, out1, last1) = walk.step(file, block, part)
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("file"), part.column("block"), pa.array(start + np.arange(part.num_rows)), part.column("line"),
             small(in0), small(in1), small(out0), small(out1), pa.array(last0), pa.array(last1)],
            names=[f.split()[0] for f in MARKED.split(", ")])


def _entered(ranges: DataFrame) -> DataFrame:
    """Per range its state on entry, and the place of the record that is open there.

    The window runs over the ranges of a file, one row each, never over lines.
    """
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # a map that does not depend on its entry settles the state; swaps since then turn it
    fixed, swap = F.col("end0") == F.col("end1"), (F.col("end0") == 1) & (F.col("end1") == 0)
    turns = ranges.withColumn("turns", F.sum(swap.cast("int")).over(order))
    settled = turns.withColumn("settled", F.last(F.when(fixed, F.struct("end0", "turns")), ignorenulls=True).over(past)).withColumn(
        "before", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    entry = F.pmod(F.coalesce("settled.end0", F.lit(0)) + F.col("before") - F.coalesce("settled.turns", F.lit(0)), F.lit(2))
    known = settled.withColumn("entry", entry)
    last = F.when(F.col("entry") == 0, F.col("last0")).otherwise(F.col("last1"))
    begun = known.withColumn("begun", F.when(last >= 0, F.struct(F.col("block").alias("open_block"), last.alias("open_at"))))
    head = F.min(F.when(F.col("first") >= 0, F.struct("block", "first"))).over(Window.partitionBy("file")).alias("head")
    return begun.select("file", "block", "entry", F.last("begun", ignorenulls=True).over(past).alias("open"), head)


def read_records(spark: SparkSession, path: str, columns: list[str], ranges: DataFrame) -> DataFrame:
    """One row of texts per record of the files; the first record of a file is its header."""
    marked = _lines(spark, path).mapInArrow(_marked, MARKED).join(_entered(ranges), ["file", "block"])
    chosen = lambda c: F.when(F.col("entry") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    told = marked.select("file", "block", "at", "line", "head", "open", chosen("in").alias("in"), chosen("out").alias("out"), chosen("last").alias("last"))
    alone = told.where((F.col("in") == 0) & (F.col("out") == 0)).select("file", "block", "at", "head", "line")
    own = F.struct(F.col("block").alias("open_block"), F.col("last").alias("open_at"))
    spread = told.where((F.col("in") == 1) | (F.col("out") == 1)).withColumn("record", F.when(F.col("last") >= 0, own).otherwise(F.col("open")))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    whole = spread.groupBy("file", "record", "head").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line")).select(
        "file", F.col("record.open_block").alias("block"), F.col("record.open_at").alias("at"), "head", "line")
    records = alone.unionByName(whole).where((F.col("block") != F.col("head.block")) | (F.col("at") != F.col("head.first")))
    text = F.regexp_replace("line", "\r$", "")
    names = [f"c{i}" for i in range(len(columns))]
    parsed = F.from_csv(text, ", ".join(f"{n} string" for n in names), {"escape": '"', "multiLine": "true"})
    return records.where(text != "").select(parsed.alias("r")).select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, columns, strict=True)])


def range_maps(spark: SparkSession, path: str) -> DataFrame:
    """One row per byte range of the files: where its lines lead from either state."""
    return _lines(spark, path).mapInArrow(_range_maps, RANGE)


def needs_records() -> Column:
    """Does a value reach over a line, or hold a carriage return that a reader of lines would break at?"""
    return F.coalesce(F.sum(F.col("opens") + F.col("returns")), F.lit(0)) > 0
