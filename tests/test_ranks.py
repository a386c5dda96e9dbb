"""Distributed rank selection against sorting everything."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from limpid.functions import ranks


def skewed(seed=3, n=4000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = rng.choice(["a", "a", "a", "b", "c"])
        value = rng.choice([
            0.0, 7.0, 7.0, 7.0, -3.5, rng.lognormvariate(0, 6), -rng.lognormvariate(0, 6),
            1.7e9 + rng.randint(0, 10), rng.uniform(-1, 1), 5e-324, float("inf"),
        ])
        rows.append((i, group, value))
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_medians_agree_with_statistics(spark, rows):
    finite = [r for r in rows if r[2] != float("inf")]
    freq = frame(spark, finite).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    by_rank = {r["g"]: r["median"] for r in ranks.median_by_rank(freq, ["g"], "v", "n").collect()}
    by_map = {r["g"]: r["median"] for r in ranks.median_by_map(freq, ["g"], "v", "n").collect()}
    for g in "abc":
        want = statistics.median(r[2] for r in finite if r[1] == g)
        assert by_rank[g] == pytest.approx(want, rel=1e-12) and by_map[g] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_every_rank_of_a_skewed_group(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_LIMIT", limit)
    df = frame(spark, rows).withColumn("n", F.lit(1).cast("long"))
    wanted = spark.createDataFrame(
        [(g, k) for g in "abc" for k in (1, 2, 50, 123, 400, 700)], "g string, _rank long"
    )
    got = {(r["g"], r["_rank"]): (r["v"], r["_below"])
           for r in ranks.value_at_rank(df, ["g"], wanted, "v", "n").collect()}
    for g in "abc":
        ordered = sorted(r[2] for r in rows if r[1] == g)
        for k in (1, 2, 50, 123, 400, 700):
            value = ordered[k - 1]
            assert got[g, k] == (value, sum(v < value for v in ordered))


def test_coarse_key_never_decreases(spark, rows):
    df = frame(spark, rows).select("v", ranks.coarse_key(F.col("v")).alias("k")).orderBy("v")
    keys = [r["k"] for r in df.collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("largest", [None, 10_000])
def test_samples_are_the_first_digests(spark, rows, largest):
    df = frame(spark, rows)
    wanted = spark.createDataFrame([("a", 321), ("b", 0), ("c", 10_000_000)], "g string, _rank long")
    digest = ranks.sampling_key(42, F.col("id"))
    marked = ranks.mark_sample(df, ["g"], wanted, digest, "hit", largest).select("id", "g", "hit").collect()
    assert len(marked) == len(rows)
    import hashlib

    order = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    first = sorted((r[0] for r in rows if r[1] == "a"), key=order)[:321]
    assert {r["id"] for r in marked if r["hit"] and r["g"] == "a"} == set(first)
    assert not [r for r in marked if r["hit"] and r["g"] == "b"]


def test_more_rows_wanted_than_there_are(spark, rows):
    df = frame(spark, rows)
    n = sum(r[1] == "c" for r in rows)
    wanted = spark.createDataFrame([("c", n + 1000)], "g string, _rank long")
    digest = ranks.sampling_key(1, F.col("id"))
    for largest in (None, 10_000):
        marked = ranks.mark_sample(df, ["g"], wanted, digest, "hit", largest)
        assert marked.where("hit").count() == n


@pytest.mark.parametrize("largest", [None, 10_000])
def test_first_rows_with_ties_on_the_boundary(spark, rows, largest):
    df = frame(spark, [(i, g, round(v) % 5 + 0.0 if abs(v) < 1e12 else 3.0) for i, g, v in rows])
    wanted = spark.createDataFrame([("a", 1000), ("b", 77)], "g string, _rank long")
    digest = ranks.sampling_key(42, F.col("id"))
    marked = ranks.mark_first(df, ["g"], wanted, F.col("v"), digest, "hit", largest)
    kept = {(r["g"]): r for r in marked.where("hit").groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"), F.max("v").alias("m")).collect()}
    import hashlib

    order = lambda r: (r["v"], hashlib.md5(f"42|{r['id']}".encode()).hexdigest())
    for g, n in (("a", 1000), ("b", 77)):
        want = sorted((r for r in df.collect() if r["g"] == g), key=order)[:n]
        assert (kept[g]["n"], kept[g]["s"], kept[g]["m"]) == (n, sum(r["id"] for r in want), want[-1]["v"])


def test_result_does_not_depend_on_partitioning(spark, rows):
    wanted = spark.createDataFrame([("a", 321)], "g string, _rank long")
    digest = ranks.sampling_key(42, F.col("id"))
    sums = set()
    for parts in (1, 7, 64):
        df = frame(spark, rows).repartition(parts)
        marked = ranks.mark_sample(df, ["g"], wanted, digest, "hit")
        sums.add(marked.where("hit").agg(F.sum("id")).first()[0])
    assert len(sums) == 1


def test_copies_across_the_boundary(spark, monkeypatch):
    """Equal identities: still exactly n rows, whatever the plan."""
    df = spark.createDataFrame([("a", 1 if i < 60 else i) for i in range(100)], "g string, id long")
    for n in (1, 30, 70, 100):
        wanted = spark.createDataFrame([("a", n)], "g string, _rank long")
        marked = ranks.mark_sample(df, ["g"], wanted, ranks.sampling_key(5, F.col("id")), "hit")
        assert (marked.where("hit").count(), marked.count()) == (n, 100)
        ordered = ranks.mark_first(df, ["g"], wanted, F.lit(1.0), ranks.sampling_key(5, F.col("id")), "hit")
        assert (ordered.where("hit").count(), ordered.count()) == (n, 100)
    first = ranks.mark_first(df, ["g"], spark.createDataFrame([("a", 30)], "g string, _rank long"),
                             F.col("id"), ranks.sampling_key(5, F.col("id")), "hit")
    assert first.where("hit and id = 1").count() == 30
    monkeypatch.setattr(ranks, "WINDOW_LIMIT", 10)
    for n in (30, 70):
        wanted = spark.createDataFrame([("a", n)], "g string, _rank long")
        marked = ranks.mark_sample(df, ["g"], wanted, ranks.sampling_key(5, F.col("id")), "hit", largest=100)
        assert (marked.where("hit").count(), marked.count()) == (n, 100) and set(marked.columns) == {"g", "id", "hit"}
        ordered = ranks.mark_first(df, ["g"], wanted, F.col("id"), ranks.sampling_key(5, F.col("id")), "hit", largest=100)
        assert (ordered.where("hit").count(), ordered.count()) == (n, 100)


def _read_twice(spark, rows, limit, monkeypatch):
    """Digests of a sample's rows, with the number of frames that were ordered by ``row_number``."""
    monkeypatch.setattr(ranks, "BUCKET_LIMIT", limit)
    windows = []
    plain = ranks._mark_by_window
    monkeypatch.setattr(ranks, "_mark_by_window", lambda *a: windows.append(1) or plain(*a))
    wanted = spark.createDataFrame([("a", 1500), ("b", 3), ("c", 1)], "g string, _rank long")
    marked = ranks.mark_sample(frame(spark, rows), ["g"], wanted, ranks.sampling_key(9, F.col("id")), "hit", 2_500)
    return {(r["g"], r["id"]) for r in marked.where("hit").collect()}, len(windows)


@pytest.mark.parametrize("limit", [0, 1, 1_000_000])
def test_slices_of_digests_hold_every_rank(spark, rows, limit, monkeypatch):
    """A key of thousands of rows is not ordered in one task, and its slices are cut as often as need be."""
    import hashlib

    got, windows = _read_twice(spark, rows, limit, monkeypatch)
    want = set()
    for g, n in (("a", 1500), ("b", 3), ("c", 1)):
        ids = sorted((r[0] for r in rows if r[1] == g), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
        want |= {(g, i) for i in ids[:n]}
    assert got == want and windows == 0
