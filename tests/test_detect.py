"""The anomaly families on small, hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from limpid import schemas
from limpid.operators import detect as D


def profile(spark, *rows):
    """Profile rows from dictionaries; what is not given is NULL."""
    names = schemas.PROFILE_COLUMN.fieldNames()
    base = {"dataset": "shop", "table_name": "RAW.T", "batch_id": "2018-04-29", "row_count": 100, "null_count": 0,
            "null_rate": 0.0}
    data = [tuple({**base, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schemas.PROFILE_COLUMN)


def clauses(spark, *rows):
    names = schemas.CONTRACT_CLAUSE.fieldNames()
    base = {"dataset": "shop", "table_name": "RAW.T", "version": 1, "status": "approved"}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.CONTRACT_CLAUSE)


def series(spark, values, metric="row_count", column=None):
    return spark.createDataFrame(
        [("shop", "RAW.T", column, metric, [float(v) for v in values])],
        "dataset string, table_name string, column_name string, metric string, series array<double>",
    )


def today(spark, value, metric="row_count", column=None):
    return spark.createDataFrame(
        [("shop", "RAW.T", "2018-05-01", column, metric, float(value))],
        "dataset string, table_name string, batch_id string, column_name string, metric string, value double",
    )


STATISTICAL = [
    ([300] * 3, 42, "row_count", None, None),
    ([300, 310, 290, 305] * 5, 42, "row_count", None, "derive_statistique"),
    ([300, 310, 290] * 7, 302, "row_count", None, None),
    ([0.0] * 20, 0.301, "null_rate", "c", "rupture_de_constante"),
    ([0.0] * 20, 0.0, "null_rate", "c", None),
    ([0.0] * 19 + [0.301], 0.301, "null_rate", "c", "rupture_de_constante"),
]


@pytest.mark.parametrize("past, value, metric, column, kind", STATISTICAL)
def test_statistical(spark, past, value, metric, column, kind):
    found = D.statistical(D.compare_to_series(today(spark, value, metric, column), series(spark, past, metric, column)))
    rows = found.collect()
    assert [r["type"] for r in rows] == ([kind] if kind else [])
    if kind == "rupture_de_constante":
        assert rows[0]["magnitude"] == pytest.approx(0.301) and rows[0]["dama"] == "completude"


def test_references_use_existing_batches_before(spark):
    """Gaps in the calendar use no place; a batch is never in its own reference."""
    days = [f"2018-01-{d:02d}" for d in range(1, 29, 2)] + [f"2018-03-{d:02d}" for d in range(1, 29)]
    m = spark.createDataFrame([("s", "T", b, None, "row_count", float(i)) for i, b in enumerate(days)], schemas.PROFILE_METRIC)
    got = {r["batch_id"]: (r["batches"], r["median"]) for r in D.with_references(m, 5).collect()}
    assert got[days[0]] == (0, None) and got[days[1]] == (1, 0.0)
    for i in (5, 20, len(days) - 1):
        assert got[days[i]] == (5, float(i - 3))


def test_semantic(spark):
    top = lambda *e: [{"value": v, "count": c} for v, c in e]
    rows = [
        {"column_name": "city", "role": "categorical", "top": top(("sao paulo", 135800), ("são paulo", 24918))},
        {"column_name": "kind", "role": "categorical", "top": top(("CDI", 3), ("cdi", 2))},
        {"column_name": "id", "role": "identifier", "top": top(("a", 1), ("A", 1))},
        {"column_name": "note", "role": "free_text", "top": top(("a", 1), ("A", 1))},
        {"column_name": "empty", "role": "categorical", "top": None},
        {"column_name": "town", "role": "categorical", "top": top(("arco verde", 1), ("arcoverde", 1))},
    ]
    got = {r["column_name"]: r for r in D.semantic(profile(spark, *rows)).collect()}
    assert set(got) == {"city", "kind"}
    assert got["city"]["magnitude"] == 160718 and got["city"]["observed_values"] == ["sao paulo", "são paulo"]


def test_contract_clauses(spark):
    p = profile(
        spark,
        {"column_name": "a", "null_count": 30, "null_rate": 0.3},
        {"column_name": "k", "distinct": 90, "null_count": 2},
        {"column_name": "ok", "distinct": 98, "null_count": 2},
        {"column_name": "price", "numeric_min": -20.0, "numeric_max": 8000.0},
        {"column_name": "far", "numeric_min": 300.0, "numeric_max": 400.0},
        {"column_name": "txt", "numeric_min": None, "numeric_max": None},
        {"column_name": "s", "top": [{"value": "x", "count": 5}, {"value": "y", "count": 1}], "coverage": 1.0},
    )
    c = clauses(
        spark, {"column_name": "A", "clause": "not_null", "bool_arg": True},
        {"column_name": "k", "clause": "unique"}, {"column_name": "ok", "clause": "unique"},
        {"column_name": "price", "clause": "between", "lo": 1.0, "hi": 100.0},
        {"column_name": "far", "clause": "between", "lo": 1.0, "hi": 1.0},
        {"column_name": "txt", "clause": "between", "lo": 1.0, "hi": 2.0},
        {"column_name": "s", "clause": "accepted_values", "values": ["x", "z"]},
        {"column_name": "gone", "clause": "not_null"},
    )
    got = {r["column_name"]: (r["type"], r["magnitude"]) for r in D.contract_violations(p, c).collect()}
    assert got == {
        "a": ("nulls_interdits", 0.3), "k": ("doublons", pytest.approx(8 / 98)),
        "price": ("hors_bornes", pytest.approx(7900 / 99)), "far": ("hors_bornes", 399.0),
        "s": ("valeur_non_admise", 1.0),
    }


def test_inventory(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    columns = lambda t, *c: spark.createDataFrame([(t, x) for x in c], "table_name string, column_name string")
    reg, there = names("RH.EMPLOYES", "RH.DISPARUE"), names("RH.EMPLOYES", "RH.NOUVELLE")
    found = D.inventory(reg, there, "b", columns("RH.DISPARUE", "a", "b"), columns("RH.NOUVELLE", "B", "A"))
    got = {(r["table_name"], r["type"]) for r in found.collect()}
    assert got == {("RH.DISPARUE", "table_absente"), ("RH.NOUVELLE", "table_non_declaree"), ("RH.DISPARUE", "renommage_probable")}
    other = D.inventory(reg, there, "b", columns("RH.DISPARUE", "a"), columns("RH.NOUVELLE", "B", "A"))
    assert "renommage_probable" not in {r["type"] for r in other.collect()}
    assert D.inventory(reg, None, "b") is None


def test_schema_drift_and_its_reference(spark):
    cols = lambda b, *c: [("T", b, x) for x in c]
    now = spark.createDataFrame(cols("b2", "order_id", "amount") + cols("b1", "order_id"), "table_name string, batch_id string, column_name string")
    history = spark.createDataFrame(cols("b2", "ORDER_ID", "PAYMENT_VALUE"), "table_name string, batch_id string, column_name string")
    signed = spark.createDataFrame([("T", "order_id"), ("T", "old")], "table_name string, column_name string")
    batches = now.select("table_name", "batch_id").distinct()
    ref = D.schema_reference(history, signed, batches)
    got = {(r["batch_id"], r["column_name"], r["type"], r["reference"]) for r in D.schema_drift(now, ref).collect()}
    assert got == {
        ("b2", "PAYMENT_VALUE", "colonne_disparue", "_SCHEMA_HISTORY"),
        ("b2", "AMOUNT", "colonne_nouvelle", "_SCHEMA_HISTORY"),
        ("b1", "OLD", "colonne_disparue", "contrat"),
    }
    first = D.schema_drift(now, D.schema_reference(history.limit(0), None, batches))
    assert first.isEmpty()


def test_external_verdicts_of_this_table_only(spark):
    v = spark.createDataFrame(
        [("RAW.T", "A", "t1", "unique", "unicite", 5, "fail"), ("RAW.U", "A", "t2", "unique", "unicite", 5, "fail"),
         (None, None, "t3", None, None, None, "error")],
        "table_name string, column_name string, test string, kind string, dama string, failures bigint, status string",
    )
    got = {(r["details"]["test"], r["magnitude"], r["dama"]) for r in D.external(v, "b", "RAW.T").collect()}
    assert got == {("t1", 5.0, "unicite"), ("t3", None, "exactitude")}


def test_one_failing_family_does_not_lose_the_others(spark):
    p = profile(spark, {"column_name": "c", "role": "categorical", "top": [{"value": "a", "count": 1}, {"value": "A", "count": 2}]})

    def broken():
        raise RuntimeError("no")

    found, failures = D.detect([("broken", broken), ("semantic", lambda: D.semantic(p)), ("none", lambda: None)], spark)
    assert found.count() == 1 and failures == ["broken: RuntimeError: no"]
    empty, _ = D.detect([("none", lambda: None)], spark)
    assert empty.schema.fieldNames() == schemas.ANOMALY.fieldNames() and empty.isEmpty()


def test_all_families_share_one_schema(spark):
    p = profile(spark, {"column_name": "c", "role": "categorical", "top": [{"value": "a", "count": 1}]})
    for frame in (D.semantic(p), D.contract_violations(p, clauses(spark, {"column_name": "c", "clause": "unique"}))):
        assert [f.name for f in frame.schema] == schemas.ANOMALY.fieldNames()
        assert [f.dataType for f in frame.schema] == [f.dataType for f in schemas.ANOMALY.fields]


def test_semantic_full_sees_rare_values(spark):
    rows = [("b", "c", f"v{i:04d}", 100) for i in range(150)] + [("b", "c", "Rare", 1), ("b", "c", "rare", 1)]
    freq = spark.createDataFrame(rows, "batch_id string, column_name string, value string, n long")
    facts = spark.createDataFrame([("b", "c", "categorical")], "batch_id string, column_name string, role string")
    got = D.semantic_full(freq, facts, "RAW.T").collect()
    assert [(r["reference"], r["magnitude"]) for r in got] == [("rare", 2.0)]


def test_reference_depth(spark):
    m = spark.createDataFrame(
        [("s", "T", f"2018-01-{d:02d}", None, "row_count", 1.0) for d in range(1, 11)]
        + [("s", "T", "2018-01-10", "c", "median", 1.0)], schemas.PROFILE_METRIC)
    assert D.reference_depth(m, "2018-01-10").first()["depth"] == 9


def test_signature_column(spark):
    p = profile(spark, {"column_name": "A", "null_count": 30, "null_rate": 0.3})
    a = D.with_signature(D.contract_violations(p, clauses(spark, {"column_name": "a", "clause": "not_null"})))
    assert a.first()["signature"] == "RAW.T|A|nulls_interdits|-2"
    assert a.select(D.sentence()).first()[0] == "completude on A — 30"
    assert D.count_by_family(a).first()["anomalies"] == 1
    assert a.where(F.col("family") == "contract").count() == 1
