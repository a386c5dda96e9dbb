"""Exact order statistics and exact "first n rows" without a one-task group.

A median by ``percentile`` keeps a map of all values of a group in one task, and
``row_number`` over a group sorts it in one task. Here a group is first counted
per coarse bucket of its values (partial aggregation, a bounded number of
buckets), the bucket that holds the wanted rank is found from the running
counts, and only the rows of that bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.functions.text import exponent
from limpid.session import stage

SUB_BUCKETS = 1024

WINDOW_LIMIT = 1_000_000
"""Rows per key up to which one task may order a key."""

SAMPLE_WINDOW_LIMIT = 1_000
"""The same for samples, whose other way reads the rows three times, whatever their number."""

BUCKET_LIMIT = 1_000_000
"""Values in a bucket up to which one task may order the bucket."""

SLICE_DIGITS = 3
"""Hex digits by which digests are cut into slices at a time."""


def coarse_key(value: Column) -> Column:
    """A whole number that never decreases as ``value`` grows.

    Sign, power of two, and the position inside the octave: buckets are about a
    thousandth of their values wide whatever the scale of the data.
    """
    size = F.abs(value)
    octave = exponent(size)
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * SUB_BUCKETS)
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(SUB_BUCKETS - 1))
    # 1100 lifts the exponent of the smallest double above zero
    key = (octave + 1100) * SUB_BUCKETS + inside + 1
    return (
        F.when(value == 0, F.lit(0))
        .when(size == float("inf"), F.signum(value).cast("long") * 4_000_000)
        .otherwise(F.signum(value).cast("long") * key)
    ).cast("long")


def linear_key(value: Column, low: Column, high: Column) -> Column:
    """Equal slices of [low, high]; never decreases as ``value`` grows."""
    share = (value - low) / (high - low)
    slice_ = F.floor(share * SUB_BUCKETS)
    bounded = F.least(F.greatest(slice_, F.lit(0)), F.lit(SUB_BUCKETS - 1))
    return F.when(high > low, bounded).otherwise(F.lit(0)).cast("long")


def _bucket_of_rank(
    rows: DataFrame, keys: list[str], bucket: str, value: str, weight: str, rank: str
) -> DataFrame:
    """Per key and rank: bounds of the bucket holding it, and the rows before it.

    ``rows`` carries for each key either one ``rank`` or, after the first
    refinement, the rank it is searched for. The window runs over buckets, whose
    number per key is bounded, never over rows.
    """
    counted = rows.groupBy(*keys, bucket).agg(
        F.sum(weight).alias("_w"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.first(rank).alias(rank), F.count(F.lit(1)).alias("_rows"),
    )
    upto = Window.partitionBy(*keys).orderBy(bucket)
    running = counted.withColumn("_upto", F.sum("_w").over(upto))
    return running.where(
        (F.col("_upto") >= F.col(rank)) & (F.col("_upto") - F.col("_w") < F.col(rank))
    ).select(
        *keys, rank, "_lo", "_hi", "_rows", (F.col("_upto") - F.col("_w")).alias("_before")
    )


def value_at_rank(
    freq: DataFrame, keys: list[str], ranks: DataFrame, value: str, weight: str
) -> DataFrame:
    """The value at each wanted 1-based rank, and the rows strictly before it.

    ``freq`` holds ``keys``, a double ``value`` and a row count ``weight`` (the
    same value may appear on several rows); ``ranks`` holds ``keys`` and
    ``_rank``, several per key if wanted. Returns ``keys, _rank, value,
    _below`` where ``_below`` counts the rows with a smaller value.

    Octave slices leave about a thousandth of a spread-out group for the last
    ordering; as long as the widest bucket found exceeds ``BUCKET_LIMIT``, it is
    cut into linear slices, each a thousandth of it.
    """
    wanted = [*keys, "_rank"]
    rows = freq.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_n"))
    first = (
        rows.withColumn("_b", coarse_key(F.col("_v")))
        .groupBy(*keys, "_b")
        .agg(
            F.sum("_n").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .withColumn(
            "_upto", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_b"))
        )
        .join(ranks.select(*wanted), keys)
        .where(
            (F.col("_upto") >= F.col("_rank"))
            & (F.col("_upto") - F.col("_w") < F.col("_rank"))
        )
        .select(*wanted, "_lo", "_hi", "_rows", (F.col("_upto") - F.col("_w")).alias("_before"))
    )
    found = stage(first, "rank-octave")
    # one number for the driver: rows of the widest bucket of several values that holds a rank
    wide = lambda f: f.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_rows"))).alias("w")).first()["w"] or 0
    # every cut leaves a thousandth of the bucket's width, until its rows are few or its values one
    while wide(found) > BUCKET_LIMIT:
        found = _narrow(rows, wanted, found)
    found = found.drop("_rows")

    last = (
        rows.join(found, keys)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*wanted, "_before", "_v")
        .agg(F.sum("_n").alias("_n"))
    )
    upto = F.sum("_n").over(Window.partitionBy(*wanted).orderBy("_v")) + F.col("_before")
    return (
        last.withColumn("_upto", upto)
        .where(
            (F.col("_upto") >= F.col("_rank"))
            & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        )
        .select(
            *wanted, F.col("_v").alias(value), (F.col("_upto") - F.col("_n")).alias("_below")
        )
    )


def _narrow(rows: DataFrame, wanted: list[str], first: DataFrame) -> DataFrame:
    """Linear slices of every bucket found, and the slice that holds the rank."""
    keys = wanted[:-1]
    # both ranks of a median usually share a bucket; each is followed on its own
    left = (
        rows.join(first, keys)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_b", linear_key(F.col("_v"), F.col("_lo"), F.col("_hi")))
        .withColumn("_rest", F.col("_rank") - F.col("_before"))
    )
    second = _bucket_of_rank(left, wanted, "_b", "_v", "_n", "_rest")
    return stage(
        second.join(first.select(*wanted, F.col("_before").alias("_skipped")), wanted)
        .select(
            *wanted, "_lo", "_hi", "_rows",
            (F.col("_before") + F.col("_skipped")).alias("_before"),
        ),
        "rank-slice",
    )


def median_by_rank(freq: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Exact interpolated median per key: mean of the two middle values."""
    middle = freq.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    ranks = middle.select(
        *keys,
        F.explode(
            F.array_distinct(
                F.array(
                    F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1")
                )
            )
        ).alias("_rank"),
    )
    found = value_at_rank(freq, keys, ranks, value, weight)
    # halves first: the sum of two large values would overflow
    return found.groupBy(*keys).agg((F.min(value) / 2 + F.max(value) / 2).alias("median"))


def median_by_map(freq: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The same result from Spark's own ``percentile``; for bounded groups only."""
    return freq.groupBy(*keys).agg(
        F.percentile(F.col(value), F.lit(0.5), F.col(weight)).alias("median")
    )


def sampling_key(seed: int | str, *identity: Column) -> Column:
    """Hex digest ordering rows at random but the same way everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in identity]))


def _limit_number(
    rows: DataFrame, keys: list[str], wanted: DataFrame, number: str
) -> DataFrame:
    """Per key the number at the wanted rank, and how many of its rows belong in."""
    freq = rows.where(F.col(number).isNotNull()).select(
        *keys, number, F.lit(1).cast("long").alias("_n")
    )
    # asking for more rows than there are means all of them
    sizes = freq.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    asked = wanted.join(sizes, keys).select(
        *keys, F.least("_rank", "_size").alias("_rank")
    ).where(F.col("_rank") >= 1)
    return stage(
        value_at_rank(freq, keys, asked, number, "_n").select(
            *keys, F.col(number).alias("_limit"), (F.col("_rank") - F.col("_below")).alias("_rest")
        ),
        "first-rows",
    )


def _slice_of_rank(counted: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Per key the slice ``_b`` of digests that holds the rank ``_rest``, and the rank within it.

    ``counted`` holds rows per slice. Asking for more rows than there are means all of them.
    """
    of_key = Window.partitionBy(*keys)
    running = counted.withColumn("_upto", F.sum(weight).over(of_key.orderBy("_b"))).withColumn(
        "_rest", F.least("_rest", F.sum(weight).over(of_key)))
    before = F.col("_upto") - F.col(weight)
    inside = (F.col("_rest") >= 1) & (F.col("_upto") >= F.col("_rest")) & (before < F.col("_rest"))
    return running.where(inside).select(*keys, "_b", (F.col("_rest") - before).alias("_rest"))


def _last_digest(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Per key the digest of the last row that belongs in.

    Also how many rows carry it and how many of those are needed; both are one
    where digests tell rows apart. Reads ``keys`` and ``_digest`` only, twice:
    rows are counted by the first digits of their digest, and the digests of
    the slice that holds the rank, one in thousands, are written. A slice with
    more than ``BUCKET_LIMIT`` digests is cut by further digits.
    """
    told = rows.select(*keys, "_digest")
    start = lambda digits: F.substring("_digest", 1, digits)
    digits = SLICE_DIGITS
    counted = told.groupBy(*keys, start(digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.select(*keys, F.col("_rank").alias("_rest"))
    slices = stage(_slice_of_rank(counted.join(asked, keys), keys, "_n"), "digest-slice")
    edge = stage(
        told.join(slices, keys).where(start(digits) == F.col("_b"))
        .groupBy(*keys, "_rest", "_digest").agg(F.count(F.lit(1)).alias("_copies")),
        "edge-digests",
    )
    # one number for the driver: digests of the widest slice
    wide = lambda e: e.groupBy(*keys).count().agg(F.max("count").alias("w")).first()["w"] or 0
    while digits < 32 and wide(edge) > BUCKET_LIMIT:
        digits += SLICE_DIGITS
        counted = edge.groupBy(*keys, "_rest", start(digits).alias("_b")).agg(F.sum("_copies").alias("_n"))
        slices = stage(_slice_of_rank(counted, keys, "_n"), "digest-slice")
        edge = stage(
            edge.drop("_rest").join(slices, keys).where(start(digits) == F.col("_b")).drop("_b"), "edge-digests"
        )
    upto = F.sum("_copies").over(Window.partitionBy(*keys).orderBy("_digest"))
    last = (
        edge.withColumn("_upto", upto)
        .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_copies") < F.col("_rest")))
        .select(
            *keys, F.col("_digest").alias("_last"), "_copies",
            (F.col("_rest") - (F.col("_upto") - F.col("_copies"))).alias("_need"),
        )
    )
    return stage(last, "last-digest")


def _flag_up_to(
    rows: DataFrame, keys: list[str], last: DataFrame, flag: str, below: Column, level: Column
) -> DataFrame:
    """Flag rows ``below`` the boundary, and on its ``level`` up to the last digest.

    One pass over the rows. Only where copies that no digest tells apart lie
    across the boundary are they written and chosen by their place in the files,
    in the same way, so that no task numbers them all.
    """
    placed = rows.join(last, keys, "left")
    no = F.lit(False)
    inside = F.coalesce(below, no) | (F.coalesce(level, no) & F.coalesce(F.col("_digest") <= F.col("_last"), no))
    extra = ["_last", "_copies", "_need"]
    split = last.where(F.col("_need") < F.col("_copies")).limit(1).count()
    if not split:
        return placed.withColumn(flag, inside).drop(*extra)
    edge = F.coalesce(level, no) & F.coalesce(
        (F.col("_digest") == F.col("_last")) & (F.col("_need") < F.col("_copies")), no
    )
    names = [c for c in placed.columns if c not in extra]
    copies = stage(placed.where(edge).select(*names).drop("_digest"), "copies").select("*", "_metadata.file_path", "_metadata.row_index")
    told = copies.withColumn("_digest", F.md5(F.concat_ws("|", F.element_at(F.split("file_path", "/"), -1), "row_index"))).drop("file_path", "row_index")
    wanted = last.where(F.col("_need") < F.col("_copies")).select(*keys, F.col("_need").alias("_rank"))
    some = _flag_up_to(told, keys, _last_digest(told, keys, wanted), flag, no, F.lit(True))
    return placed.where(~edge).withColumn(flag, inside).drop(*extra).unionByName(some)


def _mark_by_window(
    df: DataFrame, keys: list[str], wanted: DataFrame, order: list[Column], flag: str
) -> DataFrame:
    """The plain way, for keys known to be small."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("_place", place).join(wanted.select(*keys, "_rank"), keys, "left")
    return ranked.withColumn(
        flag, F.coalesce(F.col("_place") <= F.col("_rank"), F.lit(False))
    ).drop("_place", "_rank")


def mark_sample(
    df: DataFrame, keys: list[str], wanted: DataFrame, digest: Column, flag: str,
    largest: int | None = None,
) -> DataFrame:
    """Add ``flag``: is the row among the first n of its key, in digest order?

    ``wanted`` holds ``keys`` and ``_rank`` = n. Rows with equal digests are
    interchangeable; where copies exist in number, put the file position of the
    row into ``sampling_key``. ``largest`` is the measured size of the largest
    key, if known.
    """
    rows = df.withColumn("_digest", digest)
    if largest is not None and largest <= min(WINDOW_LIMIT, SAMPLE_WINDOW_LIMIT):
        return _mark_by_window(rows, keys, wanted, [F.col("_digest")], flag).drop("_digest")
    last = _last_digest(rows, keys, wanted)
    return _flag_up_to(rows, keys, last, flag, F.lit(False), F.lit(True)).drop("_digest")


def mark_first(
    df: DataFrame, keys: list[str], wanted: DataFrame, number: Column, digest: Column, flag: str,
    largest: int | None = None,
) -> DataFrame:
    """Like ``mark_sample`` in the order of ``number``, ties in digest order.

    Rows without a number are never among the first.
    """
    if largest is not None and largest <= WINDOW_LIMIT:
        order = [number.asc_nulls_last(), digest]
        marked = _mark_by_window(df, keys, wanted, order, flag)
        return marked.withColumn(flag, F.col(flag) & number.isNotNull())
    rows = df.withColumn("_order", number).withColumn("_digest", digest)
    limit = _limit_number(rows.select(*keys, "_order"), keys, wanted, "_order")
    placed = rows.join(limit.withColumnRenamed("_limit", "_bound"), keys, "left")
    level = F.col("_order") == F.col("_bound")
    rest = limit.select(*keys, F.col("_rest").alias("_rank"))
    last = _last_digest(placed.where(level).select(*keys, "_digest"), keys, rest)
    marked = _flag_up_to(placed, keys, last, flag, F.col("_order") < F.col("_bound"), level)
    return marked.drop("_order", "_digest", "_bound", "_rest")
