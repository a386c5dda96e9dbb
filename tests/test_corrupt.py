"""Corruption, preparation and scoring."""

import pytest
from pyspark.sql import functions as F

from limpid.functions import ranks
from limpid.operators import checks, corrupt, prepare, score
from limpid.plans import gold
from limpid.sources.batches import row_position


@pytest.fixture
def rows(spark):
    data = [(i, f"2018-03-{1 + i % 3:02d}", "sao paulo" if i % 5 < 3 else "santos") for i in range(300)]
    return spark.createDataFrame(data, "id long, day string, city string")


@pytest.fixture(params=["window", "rank"])
def path(request, monkeypatch):
    if request.param == "rank":
        monkeypatch.setattr(ranks, "WINDOW_LIMIT", -1)
    return request.param


def test_exact_counts(spark, rows, path):
    empty = corrupt.inject_nulls(rows, "city", 0.3, "day", ["id"]).groupBy("day").agg(F.count_if(F.col("city").isNull()).alias("n"))
    assert {r["n"] for r in empty.collect()} == {30}
    assert corrupt.duplicate_rows(rows, 0.15, "day", ["id"]).count() == 345
    kept = corrupt.truncate_rows(rows, 0.3, "day", F.col("id"), ["id"])
    assert kept.count() == 90 and kept.agg(F.max("id")).first()[0] < 95


def test_variants_hit_candidates_only(spark, path):
    df = spark.createDataFrame([(i, "d", "sao paulo" if i < 60 else "santos") for i in range(100)], "id int, day string, city string")
    out = corrupt.semantic_variants(df, "city", {"sao paulo": "são paulo"}, 0.10, "day", ["id"])
    got = {r["city"]: r["count"] for r in out.groupBy("city").count().collect()}
    assert got == {"são paulo": 6, "sao paulo": 54, "santos": 40}
    again = corrupt.semantic_variants(df.repartition(17), "city", {"sao paulo": "são paulo"}, 0.10, "day", ["id"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    nothing = corrupt.semantic_variants(df, "city", {"x": "y"}, 0.5, "day", ["id"])
    assert nothing.count() == 100


def test_split_and_fold(spark):
    df = spark.createDataFrame([(i, "d", "sao paulo") for i in range(100)], "id int, day string, city string")
    out = corrupt.semantic_variants(df, "city", {"sao paulo": "são paulo"}, 0.40, "day", ["id"])
    mart = out.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    r = gold.split_rows(mart, "city", "n").first()
    assert (r["split_rows"], r["largest_part"], r["whole"], r["recovered"]) == (2, 60, 100, 40)


def test_copies_are_told_apart_by_position(spark, tmp_path, path):
    """A third of all rows are copies of one row; exactly n of them are hit."""
    df = spark.createDataFrame([(0 if i < 100 else i, "d") for i in range(300)], "id int, day string")
    df.repartition(4).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).withColumn("pos", row_position())
    out = corrupt.inject_nulls(stored.withColumn("v", F.lit("x")), "v", 0.5, "day", ["id", "pos"])
    assert out.where("v is null").count() == 150 and out.count() == 300
    assert stored.select("pos").distinct().count() == 300


def test_missing_columns_raise(spark, rows):
    for call in (
        lambda: corrupt.rename_column(rows, "nope", "x"),
        lambda: corrupt.inject_nulls(rows, "nope", 0.1, "day", ["id"]),
        lambda: corrupt.semantic_variants(rows, "nope", {}, 0.1, "day", ["id"]),
    ):
        with pytest.raises(ValueError):
            call()
    assert corrupt.rename_column(rows, "city", "town").columns == ["id", "day", "town"]
    assert set(corrupt.CORRUPTIONS) == {"rename_column", "inject_nulls", "duplicate_rows", "truncate_rows", "semantic_variants"}


def test_rates_round_half_to_even(spark):
    df = spark.createDataFrame([(i, "d") for i in range(5)], "id int, day string").withColumn("v", F.lit("x"))
    assert corrupt.inject_nulls(df, "v", 0.5, "day", ["id"]).where("v is null").count() == 2


RAMP = {"id": "drift", "table": "customers", "type": "semantic_variants", "from_day": 50, "from_date": "2018-04-19",
        "to_day": 92, "to_date": "2018-05-31",
        "params": {"column": "customer_city", "rate_schedule": {50: 0.1, 65: 0.4, 78: 0.8}}}


def test_ramp(spark):
    once = {"id": "nulls", "table": "orders", "type": "inject_nulls", "day": 60, "date": "2018-04-29", "params": {"column": "customer_id", "rate": 0.3}}
    got = {(r["anomaly_id"], r["batch_id"]): r["rate"] for r in corrupt.spread(spark, [RAMP, once], "2018-03-01").collect()}
    assert len(got) == 44
    assert got["drift", "2018-05-03"] == 0.1 and got["drift", "2018-05-04"] == 0.4 and got["drift", "2018-05-31"] == 0.8
    assert got["nulls", "2018-04-29"] == 0.3
    todo = corrupt.not_yet_corrupted(corrupt.spread(spark, [RAMP, once], "2018-03-01"), spark.createDataFrame([("2018-04-29",)], "batch_id string"))
    assert todo.count() == 42


@pytest.mark.parametrize("change", [
    {"from_date": "2018-04-20"}, {"to_date": "2018-06-01"},
    {"params": {"rate_schedule": {51: 0.1}}}, {"params": {"rate_schedule": {50: 0.1, 93: 0.2}}},
])
def test_bad_ramps_raise(spark, change):
    with pytest.raises(ValueError):
        corrupt.spread(spark, [{**RAMP, **change}], "2018-03-01")


def test_preparation_rules(spark):
    df = spark.createDataFrame([(v,) for v in ["São Paulo", "sao paulo", "saopaulo", "arco verde", "sa£o paulo"]], "city string")
    repaired = prepare.repair_declared(df, "city", {"mapping": {"sa£o paulo": "sao paulo"}})
    folded = prepare.fold_column(repaired, "city")
    final = prepare.fold_blanks_on_majority(folded, "city")
    assert sorted(r["city"] for r in final.collect()) == ["arco verde"] + ["sao paulo"] * 4
    with pytest.raises(ValueError, match="do not occur"):
        prepare.repair_declared(df, "city", {"mapping": {"absent": "x"}})
    good = {"id": "p", "day": 1, "date": "2018-03-01", "table": "geo", "column": "city", "rule": "fold_space_variants_on_majority"}
    for bad in ({**good, "date": "2018-03-02"}, {**good, "rule": "guess"}):
        with pytest.raises(ValueError):
            prepare.apply_rules({"geo": df}, [bad], "2018-03-01", "2018-03-01")
    with pytest.raises(ValueError, match="not in"):
        prepare.apply_rules({"geo": df}, [{**good, "column": "nope"}], "2018-03-01", "2018-03-01")
    same, report = prepare.apply_rules({"other": df}, [good], "2018-03-01", "2018-03-01")
    assert report is None and same["other"] is df
    later, report = prepare.apply_rules({"geo": df}, [good], "2018-03-02", "2018-03-01")
    assert report is None and later["geo"] is df


def test_majority_ties_go_by_the_alphabet(spark):
    df = spark.createDataFrame([("arco verde",), ("arcoverde",)], "city string")
    assert {r["city"] for r in prepare.fold_blanks_on_majority(df, "city").collect()} == {"arco verde"}


def test_scoring(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    f = spark.createDataFrame([("b",), ("c",), ("d",), ("d",)], "k string")
    r = score.precision_recall(score.score(e, f, ["k"])).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1) and r["precision"] == r["recall"] == pytest.approx(2 / 3)


def test_copies_of_rows_are_counted_by_hashes(spark):
    """Nulls in other columns, both zeros, NaN and nested values count as a grouping of whole rows counts them."""
    nan = float("nan")
    data = [
        (None, "a", 1.0, ["x", "y"]), ("a", None, 1.0, ["x", "y"]), ("a", None, 1.0, ["x, y"]), ("a", None, 1.0, ["x", "y"]),
        ("b", "", 0.0, None), ("b", "", -0.0, None), ("b", None, 0.0, None), ("b", "", nan, []), ("b", "", nan, []),
        ("b", "", nan, [None]), ("ab", "c", None, None), ("a", "bc", None, None), ("ab", "c", None, None),
    ]
    df = spark.createDataFrame(data, "`x.y` string, s string, v double, l array<string>")
    got = checks.duplicated_rows(df)
    assert got.first()["duplicated"] == 4
    assert df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count().agg(F.sum(F.col("count") - 1)).first()[0] == 4
    assert checks.duplicated_rows(df.limit(0)).first()["duplicated"] == 0
    shuffled = checks.duplicated_rows(df.drop("l"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_h1" in shuffled


def test_declared_rates_do_not_shuffle_the_events(spark, sf, monkeypatch):
    """The few declared days have a known size; days of events are not sorted by one task each to meet them."""
    from limpid.catalogue import corruption

    seen = []
    plain = corrupt.inject_nulls
    monkeypatch.setattr(corrupt, "inject_nulls", lambda df, *a: seen.append(df) or plain(df, *a))
    corruption.ramped_events.__wrapped__(spark, sf)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
