"""Profiles: roles, bounds, frequent values, robust statistics, freshness."""

import pytest
from pyspark.sql import functions as F

from limpid.operators import profile as P


def stats(spark, rows):
    """Facts of text columns: name, distinct, min, max, nulls, of 1000 rows."""
    df = spark.createDataFrame(rows, "column_name string, distinct long, min string, max string, null_count long")
    return df.withColumn("row_count", F.lit(1000)).withColumn("type_class", F.lit("text"))


ROLES = [
    ("id", 1000, "0000a", "fffff", 0, "identifier"),
    ("status", 8, "approved", "shipped", 0, "categorical"),
    ("price", 800, "0.00", "9999.99", 0, "numeric"),
    ("ts", 990, "2018-01-02 10:56:33", "2018-04-29 23:12:01", 0, "temporal"),
    ("name", 940, "adorei", "otimo", 0, "free_text"),
    ("zip", 420, "18000", "91000", 0, "numeric"),
    ("empty", 0, None, None, 1000, "unknown"),
    ("holes", 1000, "a", "z", 3, "free_text"),
    ("m1", 60, "0.00", "N/A", 0, "categorical"),
    ("m2", 60, "inconnu", "99.99", 0, "categorical"),
    ("m3", 60, "2018-01-02", "N/A", 0, "categorical"),
    ("m4", 60, "N/A", "2018-04-29", 0, "categorical"),
    ("revenue", 1000, "12.5", "18.0", 0, "numeric"),
    ("counter", 1000, "1", "1000", 0, "identifier"),
]


def test_roles(spark):
    got = P.classify(stats(spark, [r[:5] for r in ROLES])).select("column_name", "role").collect()
    assert {r[0]: r[1] for r in got} == {r[0]: r[5] for r in ROLES}


def test_empty_table_has_no_role(spark):
    df = spark.createDataFrame([], "a string, b int")
    p = {r["column_name"]: r for r in P.profile_table(df, "T").collect()}
    assert p["a"]["role"] == "unknown" and p["b"]["null_rate"] == 0.0 and p["a"]["row_count"] == 0


def test_adaptive_k(spark):
    df = spark.createDataFrame([(d,) for d in (27, 73, 8, 100, 101, 1552, 0)], "d int")
    got = [r[0] for r in df.select(P.adaptive_k(F.col("d"))).collect()]
    assert got == [27, 73, 8, 100, 20, 20, 20]
    assert spark.range(1).select(P.adaptive_k(F.lit(None).cast("int"))).first()[0] == 20


FRESH = [
    ("2018-04-29", "2018-04-29", "2018-04-29", 0, 0, 0),
    ("2018-04-20", "2018-04-27", "2018-04-29", 7, 2, 0),
    ("2018-04-29", "2018-05-15", "2018-04-29", 16, -16, 1),
    ("2018-03-01", "2018-05-31", "2018-05-31", 91, 0, 0),
    ("2018-03-01 10:00:00", "2018-03-02T09:00:00Z", "*", 1, None, None),
]


def test_freshness(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(FRESH)], "i int, min string, max string, batch_id string")
    got = P.freshness(df.withColumn("role", F.lit("temporal"))).orderBy("i").collect()
    assert [(r["amplitude_jours"], r["retard_jours"], r["dates_futures"]) for r in got] == [r[3:] for r in FRESH]
    silent = P.freshness(df.withColumn("role", F.lit("numeric"))).first()
    assert silent["amplitude_jours"] is None


def test_top_values(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c", None]], "V string")
    top = P.top_values(df, "v", 2).first()
    assert [(e["value"], e["count"]) for e in top["top"]] == [("a", 2), ("b", 2)]
    assert top["non_null_count"] == 5 and top["coverage"] == 0.8
    with pytest.raises(ValueError):
        P.top_values(df, "v", 0)
    assert P.top_values(df, "absent", 3) is None
    empty = P.top_values(df.where("V = 'zzz'"), "V", 3).first()
    assert empty["coverage"] == 0.0 and empty["top"] == []


def test_bounds_of_text_and_numbers_are_kept_apart(spark):
    df = spark.createDataFrame([("8000",), ("90",), ("90",), ("7",)], "v string")
    p = P.profile_table(df, "RAW.T").first()
    assert (p["min"], p["max"]) == ("7", "90") and (p["numeric_min"], p["numeric_max"]) == (7.0, 8000.0)


def test_robust_stats_of_written_numbers(spark):
    rows = [("1",), ("2",), ("4",), ("10",), ("x",), ("nan",), (None,)]
    s = P.robust_stats(spark.createDataFrame(rows, "v string"), ["v"]).first()
    assert (s["non_null_count"], s["numeric_count"], s["median"], s["mad"]) == (6, 4, 3.0, 1.5)
    assert s["numeric_rate"] == round(4 / 6, 6)


def test_robust_stats_answer_from_the_schema(spark):
    df = spark.createDataFrame([(True,)], "b boolean").withColumn("d", F.current_date())
    for r in P.robust_stats(df, ["b", "d"]).collect():
        assert r["median"] is None and r["non_null_count"] is None and r["numeric_rate"] is None


def test_constant_column_has_zero_mad(spark):
    s = P.robust_stats(spark.createDataFrame([(5.0,)] * 9, "v double"), ["v"]).first()
    assert (s["median"], s["mad"]) == (5.0, 0.0)


def test_declared_batch_column_must_exist(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError):
        P.batch_filter(df, "_batch_id", "2018-03-01")
    assert P.batch_filter(df, None, "2018-03-01").count() == 1


def events(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.select(
        F.date_format("ts", "yyyy-MM-dd").alias("_batch_id"), "event_type", "value", "user_id"
    ).where(F.col("ts") < "2024-01-04")


FIELDS = ["batch_id", "column_name", "row_count", "null_count", "distinct", "min", "max", "role",
          "coverage", "median", "mad", "numeric_min", "numeric_max", "retard_jours"]


def as_set(df):
    return {tuple(r) for r in df.select(*FIELDS).collect()}


def test_all_batches_at_once_equal_each_alone(spark, sf):
    df = events(spark, sf)
    together = as_set(P.profile_table(df, "E", batch_column="_batch_id"))
    apart = set()
    for b in ("2024-01-01", "2024-01-02", "2024-01-03"):
        apart |= as_set(P.profile_table(df, "E", batch_column="_batch_id", batch_id=b))
    assert together == apart


def test_partitioning_and_size_path_do_not_matter(spark, sf, monkeypatch):
    df = events(spark, sf)
    base = as_set(P.profile_table(df.repartition(1), "E", batch_column="_batch_id"))
    assert as_set(P.profile_table(df.repartition(64), "E", batch_column="_batch_id")) == base
    monkeypatch.setattr(P, "MAP_LIMIT", 0)
    assert as_set(P.profile_table(df.repartition(7), "E", batch_column="_batch_id")) == base


def test_metrics_are_the_listed_ones(spark, sf):
    m = P.profile_metrics(P.profile_table(events(spark, sf), "E", "d", "_batch_id"))
    got = {r["metric"] for r in m.select("metric").distinct().collect()}
    assert got == {"row_count", "null_count", "null_rate", "distinct", "coverage", "median", "mad", "numeric_rate",
                   "numeric_min", "numeric_max", "retard_jours", "amplitude_jours", "dates_futures"}
    assert m.where("metric = 'row_count' and column_name is not null").count() == 0


def test_approximate_distinct_is_close(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = P.approximate_distinct(df, ["l_partkey"], error=0.01).first()["approx_distinct"]
    want = df.select("l_partkey").distinct().count()
    assert abs(got - want) / want < 0.05


def test_quoted_names(spark):
    df = spark.createDataFrame([(1, "x")], "`a b` int, `it's.odd` string")
    got = {r["column_name"] for r in P.profile_table(df, "T").collect()}
    assert got == {"a b", "it's.odd"}


def test_long_texts_count_by_digest_and_show_whole(spark):
    long = ["a" * 300, "a" * 300 + "b", "c" * 1000]
    rows = [(v, v) for v in long for _ in range(4)] + [("short", f"s{i}" * 200) for i in range(10)]
    df = spark.createDataFrame(rows, "label string, body string")
    p = {r["column_name"]: r for r in P.profile_table(df, "T").collect()}
    assert p["label"]["distinct"] == 4 and p["label"]["coverage"] == 1.0
    assert [(e["value"], e["count"]) for e in p["label"]["top"]] == [("short", 10)] + [(v, 4) for v in sorted(long)]
    assert p["body"]["distinct"] == 13 and p["body"]["max"] == max(r[1] for r in rows)
    digests = P.frequency_table(df, ["body"], None, P.DIGEST_OVER)
    assert digests.agg(F.max(F.length("value"))).first()[0] < 100 and digests.count() == 13


def test_distinct_values_by_hash_are_those_by_value(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(0.0, "a", at, [1], "x" * 300, "d1"), (-0.0, "A", at, [1, 2], "x" * 300, "d1"), (float("nan"), "a ", None, [1], "x" * 299 + "y", None),
            (float("nan"), "", at, None, "", None), (None, None, None, [], None, "d2"), (1.5, "a", at + datetime.timedelta(microseconds=1), [1], "x", "d1")]
    df = spark.createDataFrame(rows, "v double, t string, at timestamp, many array<int>, long string, _batch_id string")
    for by in (None, "_batch_id"):
        by_hash = {(r["batch_id"], r["column_name"]): r["distinct"] for r in P.measured(df, None, by).collect()}
        by_value = P.with_distinct(P.column_bounds(df, None, by), P.frequency_table(df, None, by))
        assert by_hash == {(r["batch_id"], r["column_name"]): r["distinct"] for r in by_value.collect()}
    assert by_hash[P.UNDATED, "v"] == 1 and by_hash["d1", "v"] == 2


def test_tables_profiled_together_are_those_profiled_alone(spark, sf):
    e = events(spark, sf)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    together, values = P.profile_tables({"E": (e, "_batch_id"), "O": (o, None)}, "d")
    alone = P.profile_table(e, "E", "d", "_batch_id").unionByName(P.profile_table(o, "O", "d"))
    assert as_set(together) == as_set(alone)
    names = {(r["table_name"], r["column_name"]) for r in together.where("role = 'categorical'").collect()}
    assert {(r["table_name"], r["column_name"]) for r in values.select("table_name", "column_name").distinct().collect()} == names


def test_bounds_of_texts_do_not_sort_the_rows(spark):
    """Text bounds per batch are kept by hash; counts and bounds are those of any plan."""
    df = spark.createDataFrame([("b1", "x", 1), ("b1", "ä", 2), ("b2", None, 3), (None, "", None)], "b string, s string, n int")
    found = P.column_bounds(df, ["s", "n"], "b")
    rows = {(r["batch_id"], r["column_name"]): (r["row_count"], r["null_count"], r["min"], r["max"]) for r in found.collect()}
    assert rows == {
        ("b1", "s"): (2, 0, "x", "ä"), ("b1", "n"): (2, 0, "1", "2"), ("b2", "s"): (1, 1, None, None),
        ("b2", "n"): (1, 0, "3", "3"), ("(none)", "s"): (1, 0, "", ""), ("(none)", "n"): (1, 1, None, None)}
    assert dict(found.dtypes)["row_count"] == "bigint"
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
