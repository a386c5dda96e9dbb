"""Contracts, memory, impact and corrections."""

import pytest
from pyspark.sql import functions as F

from limpid import schemas
from limpid.operators import checks, contracts as C, corrections as K, detect as D, impact, memory as M
from test_detect import clauses, profile

TOP = lambda *e: [{"value": v, "count": c} for v, c in e]


def proposal(spark):
    return C.propose(profile(
        spark,
        {"column_name": "id", "role": "identifier", "distinct": 99},
        {"column_name": "city", "role": "categorical", "coverage": 1.0, "top": TOP(("sao paulo", 9), ("são paulo", 1))},
        {"column_name": "state", "role": "categorical", "coverage": 1.0, "top": TOP(("SP", 9), ("RJ", 1))},
        {"column_name": "long", "role": "categorical", "coverage": 0.6, "top": TOP(("a", 9))},
        {"column_name": "bare", "role": "categorical", "null_count": 4},
        {"column_name": "price", "role": "numeric", "numeric_rate": 0.7, "numeric_min": 1.0, "numeric_max": 9.0},
        {"column_name": "ts", "role": "temporal", "null_count": 1},
        {"column_name": "note", "role": "free_text"},
        {"column_name": "void", "role": "unknown", "null_count": 100},
    ))


def test_proposal(spark):
    rows, warnings = proposal(spark)
    got = {}
    for r in rows.where("clause <> 'role'").collect():
        got.setdefault(r["column_name"], set()).add(r["clause"])
    assert got == {
        "id": {"unique", "not_null"}, "city": {"no_semantic_collisions", "not_null"},
        "state": {"no_semantic_collisions", "not_null", "accepted_values"},
        "long": {"no_semantic_collisions", "not_null"}, "bare": {"no_semantic_collisions"},
        "price": {"not_null", "between"}, "note": {"not_null"},
    }
    assert {(w["column_name"], w["kind"]) for w in warnings.collect()} == {
        ("id", "duplicates_observed"), ("city", "semantic_collision"), ("long", "partial_evidence"),
        ("bare", "partial_evidence"), ("price", "unreadable_numbers"), ("void", "no_data"),
    }
    listed = rows.where("clause = 'accepted_values'").first()
    assert listed["values"] == ["RJ", "SP"] and listed["status"] == "proposed"
    assert set(rows.columns) == set(schemas.CONTRACT_CLAUSE.fieldNames())


def test_signing(spark):
    rows, warnings = proposal(spark)
    with pytest.raises(ValueError, match="name"):
        C.approve(rows, warnings, "shop", "RAW.T", "  ")
    with pytest.raises(ValueError, match="warnings"):
        C.approve(rows, warnings, "shop", "RAW.T", "ana")
    with pytest.raises(ValueError, match="no contract"):
        C.approve(rows, warnings, "shop", "RAW.X", "ana")
    signed = C.approve(rows, warnings, "shop", "RAW.T", "ana", accept_warnings=True)
    assert C.in_force(rows).isEmpty() and not C.in_force(signed).isEmpty()
    with pytest.raises(ValueError, match="signed"):
        C.approve(signed, warnings, "shop", "RAW.T", "ana", accept_warnings=True)
    with pytest.raises(ValueError, match="never overwritten"):
        C.record(signed, rows)
    assert C.record(rows, rows).count() == rows.count()


def test_latest_signed_version_wins(spark):
    c = clauses(spark, {"column_name": "a", "clause": "unique", "version": 1},
                {"column_name": "a", "clause": "not_null", "version": 2},
                {"column_name": "a", "clause": "between", "version": 3, "status": "proposed"})
    assert [r["clause"] for r in C.in_force(c).collect()] == ["not_null"]
    assert [(r["version"], r["status"]) for r in C.listing(c).collect()] == [(1, "approved"), (2, "approved"), (3, "proposed")]


def test_amending_loosens_only_what_was_broken(spark):
    c = clauses(
        spark, {"column_name": "n", "clause": "not_null", "bool_arg": True}, {"column_name": "n", "clause": "unique", "bool_arg": True},
        {"column_name": "p", "clause": "between", "lo": 1.0, "hi": 100.0},
        {"column_name": "s", "clause": "accepted_values", "values": ["x"]},
    )
    p = profile(
        spark, {"column_name": "n", "null_count": 3, "null_rate": 0.03, "distinct": 97},
        {"column_name": "p", "numeric_min": -5.0, "numeric_max": 8.0},
        {"column_name": "s", "top": TOP(("x", 5), ("y", 1))},
    )
    found = D.contract_violations(p, c)
    new, diff = C.amend(c, found, "ana")
    got = {(r["column_name"], r["clause"]): r for r in new.collect()}
    assert set(got) == {("n", "unique"), ("p", "between"), ("s", "accepted_values")}
    assert (got["p", "between"]["lo"], got["p", "between"]["hi"]) == (-5.0, 100.0)
    assert got["s", "accepted_values"]["values"] == ["x", "y"]
    assert {r["version"] for r in got.values()} == {2} and {r["approved_by"] for r in got.values()} == {"ana"}
    assert {r["clause"]: r["dropped"] for r in diff.collect()} == {"not_null": True, "between": False, "accepted_values": False}
    nothing, none = C.amend(c, found.limit(0), "ana")
    assert nothing.isEmpty() and none.isEmpty()


def test_sentences(spark):
    c = clauses(spark, {"column_name": "s", "clause": "accepted_values", "values": list("abcdefg")},
                {"column_name": "p", "clause": "between", "lo": 1.0, "hi": 2.0})
    got = {r["clause"]: r["t"] for r in c.select("clause", C.clause_sentence().alias("t")).collect()}
    assert got["accepted_values"] == "must be one of 7 values: a, b, c, d, e (+2)"
    assert got["between"] == "must stay between 1.0 and 2.0"


def anomalies(spark, *rows):
    names = schemas.ANOMALY.fieldNames()
    base = {"family": "contract", "table_name": "RAW.T", "batch_id": "b", "dama": "completude", "details": {}}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.ANOMALY)


def incident(spark, *rows):
    names = schemas.INCIDENT.fieldNames()
    base = {"dataset": "shop", "layer": "bronze", "table_name": "RAW.T", "batch_id": "b0", "anomalies": "[]", "signatures": []}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], schemas.INCIDENT)


def test_silence_speaks_again_in_another_octave(spark):
    a = D.with_signature(anomalies(
        spark, {"column_name": "C", "type": "nulls_interdits", "magnitude": 0.35},
        {"column_name": "C", "type": "nulls_interdits", "magnitude": 0.85},
        {"column_name": "D", "type": "nulls_interdits", "magnitude": 0.3},
    ))
    past = incident(
        spark, {"incident_id": "1", "human_decision": "rejected", "signatures": ["RAW.T|C|nulls_interdits|-2"]},
        {"incident_id": "2", "human_decision": None, "signatures": ["RAW.T|C|nulls_interdits|-1"]},
        {"incident_id": "3", "human_decision": "approved", "signatures": ["RAW.T|D|nulls_interdits|-2"]},
    )
    kept, silenced = M.split_silenced(a, past)
    assert [r["magnitude"] for r in silenced.collect()] == [0.35] and kept.count() == 2
    assert {r["incident_id"] for r in M.similar_incidents(past, a).collect()} == {"1", "2", "3"}
    flagged = {r["magnitude"]: r["silenced"] for r in M.flag_silenced(a, past).collect()}
    assert flagged == {0.35: True, 0.85: False, 0.3: False}


def test_status_is_derived(spark):
    found = '[{"type": "x"}]'
    df = incident(spark, {"incident_id": "1", "human_decision": "approved", "anomalies": found},
                  {"incident_id": "2", "anomalies": found}, {"incident_id": "3"}, {"incident_id": "4", "anomalies": "{broken"})
    got = {r["incident_id"]: r["s"] for r in df.select("incident_id", M.status().alias("s")).collect()}
    assert got == {"1": "approved", "2": "en attente", "3": "rien d'anormal", "4": "rien d'anormal"}


def test_summaries_are_bounded_and_short(spark):
    import datetime

    rows = [{"incident_id": str(i), "run_ts": datetime.datetime(2018, 1, i + 1), "batch_id": f"b{i}",
             "diagnosis": '{"root_cause": "' + "x" * 500 + '"}'} for i in range(5)]
    got = M.summaries(incident(spark, *rows)).collect()
    assert {r["batch_id"] for r in got} == {"b4", "b3", "b2"} and all(len(r["root_cause"]) == 401 for r in got)


def test_impact_degrees(spark):
    p = profile(spark, {"column_name": "c", "row_count": 351, "batch_id": "b"})
    a = anomalies(
        spark, {"column_name": "c", "type": "nulls_interdits", "observed_num": 51.0, "reference_num": 0.0},
        {"column_name": "c", "type": "hors_bornes"},
        {"column_name": None, "type": "derive_statistique", "observed_num": 42.0, "reference_num": 351.0},
        {"column_name": "c", "type": "doublons", "details": {"duplicates": "62"}},
        {"column_name": None, "type": "table_absente"},
    )
    got = {r["type"]: r for r in impact.per_anomaly(a, p).collect()}
    assert (got["nulls_interdits"]["rows"], got["nulls_interdits"]["certainty"]) == (51, "exact")
    assert got["nulls_interdits"]["share"] == pytest.approx(51 / 351)
    assert (got["hors_bornes"]["rows"], got["hors_bornes"]["certainty"]) == (1, "minimum")
    assert got["derive_statistique"]["rows"] is None and got["derive_statistique"]["relative_change"] == pytest.approx(-309 / 351)
    assert got["doublons"]["rows"] == 62 and got["table_absente"]["certainty"] == "inconnu"
    head = impact.headline(impact.per_anomaly(a.where("type <> 'table_absente'"), p))
    row = head.withColumn("s", impact.sentence()).first()
    assert (row["rows"], row["type"], row["anomalies"]) == (62, "doublons", 4)
    assert row["s"] == "62 rows of 351 (17.7%) · c — completude · +3 other anomalies"
    assert impact.widest(impact.per_anomaly(a.where("type <> 'table_absente'"), p)).first()["type"] == "doublons"
    drift = impact.headline(impact.per_anomaly(a.where("type = 'derive_statistique'"), p))
    assert drift.select(impact.sentence()).first()[0] == "derive_statistique: 351 → 42 (-88.0%)"


def cities(spark):
    values = ["sao paulo"] * 5 + ["são paulo"] * 2 + ["SÃO PAULO"] + ["santos"] * 3 + [None]
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, city string")


def test_corrections_keep_to_what_was_observed(spark):
    df = cities(spark)
    fixed = {r["city"]: r["count"] for r in K.normalise(df, "city").groupBy("city").count().collect()}
    assert fixed == {"sao paulo": 8, "santos": 3, None: 1}
    invented = spark.createDataFrame([("santos", "Santos (SP)")], "value string, canonical string")
    with pytest.raises(ValueError):
        K.normalise(df, "city", invented)
    assert K.normalise(df, "city", invented, by_person=True).where("city = 'Santos (SP)'").count() == 3
    flagged = K.isolate(K.isolate(df, F.col("city") == "santos"), F.col("id") == 0)
    clean, held = K.split_quarantine(flagged)
    assert held.count() == 4 and clean.columns == df.columns
    assert K.nullify(df, "city", F.col("city") == "santos").where("city is null").count() == 4
    assert K.exclude(df, F.col("city") == "santos").count() == 9


def test_refusals(spark):
    named = anomalies(spark, {"column_name": "CITY", "type": "collision_semantique"})
    observed = spark.createDataFrame([("RAW.T", "city", "sao paulo")], "table_name string, column_name string, value string")
    rows = [
        ("RAW.T", "city", "normaliser", "sao paulo", False, False), ("RAW.T", "city", "normaliser", "80", False, False),
        ("RAW.T", "city", "normaliser", "80", False, True), ("RAW.T", "city", "normaliser", None, True, False),
        ("RAW.T", "city", "mettre_a_null", None, False, False), ("RAW.T", "city", "remplacer", "x", False, False),
        ("RAW.T", "flag", "normaliser", "1", False, False),
    ]
    c = spark.createDataFrame(rows, "table_name string, column_name string, gesture string, target string, whole_column boolean, by_person boolean")
    got = sorted((r["gesture"], r["target"] or "") for r in K.refusals(c, named, observed).collect())
    assert got == [("normaliser", ""), ("normaliser", "80"), ("remplacer", "x")]


def test_default_gestures_guess_nothing(spark):
    a = anomalies(spark, *[{"type": x} for x in ("hors_bornes", "collision_semantique", "doublons", "colonne_nouvelle")])
    got = {r["type"]: r["gestures"] for r in K.default_corrections(a).collect()}
    assert got["hors_bornes"] == ["isoler", "exclure_de_l_agregat"] and got["collision_semantique"] == ["normaliser"]
    assert got["doublons"] == got["colonne_nouvelle"] == ["isoler"]


def test_verification_compares_signatures(spark):
    a = D.with_signature(anomalies(spark, {"column_name": "c", "type": "x", "magnitude": 0.3}, {"column_name": "d", "type": "x", "magnitude": 0.3}))
    assert K.verify(a, a.limit(0)).first()["validation_status"] == "success"
    left = K.verify(a, a.where("column_name = 'd'")).first()
    assert (left["remaining"], left["validation_status"]) == (1, "failed_manual_review")


def test_rules_take_the_signed_list(spark):
    a = anomalies(
        spark, {"column_name": "S", "type": "valeur_non_admise", "reference": '["x","z"]', "observed_values": ["y"]},
        {"column_name": "N", "type": "derive_statistique", "family": "statistical", "details": {"metric": "null_rate"}},
        {"column_name": None, "type": "derive_statistique", "family": "statistical", "details": {"metric": "row_count"}},
        {"column_name": "G", "type": "colonne_disparue", "family": "schema"},
    )
    rules = checks.rules_from_anomalies(a)
    got = {(r["column_name"], r["kind"]): r["values"] for r in rules.collect()}
    assert got == {("s", "accepted_values"): ["x", "z"], ("n", "not_null"): None}
    sets = checks.rule_sets(rules.unionByName(rules)).collect()
    assert all(len(r["rules"]) == 1 and r["rules"][0]["tags"][0] == "generated" for r in sets)
    frame = spark.createDataFrame([("x", None), ("y", "1")], "s string, n string")
    got = {r["kind"]: (r["failures"], r["status"]) for r in checks.run_checks(checks.checks_of(rules), {"RAW.T": frame}.get).collect()}
    assert got == {"accepted_values": (1, "fail"), "not_null": (1, "fail")}
    with pytest.raises(ValueError):
        checks.run_checks(checks.checks_of(rules), {"RAW.T": frame}.get, exclude_tags=("generated",))


def test_typed_corrections(spark):
    df = spark.createDataFrame(
        [(1, "8000", "a"), (2, "50", "b"), (3, None, "b"), (4, "x", None)], "id int, price string, kind string")
    base = {"match": None, "lo": None, "hi": None, "values": None, "target": None, "by_person": False}
    step = lambda **kw: {**base, **kw}
    out = K.correct(df, [
        step(column_name="price", gesture="isoler", match="outside", lo=1.0, hi=100.0),
        step(column_name="kind", gesture="isoler", match="null"),
        step(column_name="price", gesture="mettre_a_null", match="values", values=["x"]),
        step(column_name="kind", gesture="normaliser", match="values", values=["a"], target="b"),
    ])
    got = {r["id"]: (r["price"], r["kind"], r[K.FLAG]) for r in out.collect()}
    assert got == {1: ("8000", "b", True), 2: ("50", "b", False), 3: (None, "b", False), 4: (None, None, True)}
    copies = K.correct(df, [step(column_name="kind", gesture="isoler", match="copies")])
    assert {r["id"] for r in copies.where(K.FLAG).collect()} == {2, 3}
    for bad in (step(column_name="price", gesture="remplacer"), step(column_name="price", gesture="isoler", match="magic"),
                step(column_name="kind", gesture="mettre_a_null", match="copies"),
                step(column_name="kind", gesture="normaliser", match="values", values=["a"], target="zzz")):
        with pytest.raises(ValueError):
            K.correct(df, [bad])


def test_only_approved_batches_are_written(spark, tmp_path):
    from limpid.plans import pipeline
    from limpid.sources.batches import read_batches, write_batches

    path = str(tmp_path / "raw")
    rows = [(d, i, None if i % 2 else "x") for d in ("d1", "d2", "d3") for i in range(10)]
    write_batches(spark.createDataFrame(rows, "_batch_id string, id int, kind string"), path)
    names = schemas.CORRECTION.fieldNames()

    def planned(*given):
        return spark.createDataFrame([tuple({"table_name": "RAW.T", "column_name": "kind", **g}.get(n) for n in names) for g in given], schemas.CORRECTION)

    decided = spark.createDataFrame([("RAW.T", "d1", "approved"), ("RAW.T", "d2", "rejected")], "table_name string, batch_id string, human_decision string")
    named = anomalies(spark, *[{"batch_id": d, "column_name": "kind", "type": "nulls_interdits"} for d in ("d1", "d2", "d3")])
    plan = planned(*[{"batch_id": d, "gesture": "isoler", "match": "null"} for d in ("d1", "d2", "d3")])
    report = pipeline.apply_corrections(spark, path, "RAW.T", "_batch_id", plan, decided, named)
    assert [tuple(r) for r in report.collect()] == [("d1", 10, 10, 0, 5)]
    flagged = read_batches(spark, path).where(K.FLAG)
    assert {r["_batch_id"] for r in flagged.collect()} == {"d1"} and read_batches(spark, path).count() == 30
    invented = planned({"batch_id": "d1", "gesture": "normaliser", "match": "values", "values": ["x"], "target": "y"})
    with pytest.raises(ValueError, match="never observed"):
        pipeline.apply_corrections(spark, path, "RAW.T", "_batch_id", invented, decided, named)
    assert read_batches(spark, path).where("kind = 'y'").isEmpty()
    both = decided.withColumn("human_decision", F.lit("approved"))
    pipeline.apply_corrections(spark, path, "RAW.T", "_batch_id", plan, both, named)
    counts = read_batches(spark, path).groupBy("_batch_id").agg(F.count(K.FLAG).alias("n"), F.count_if(K.FLAG).alias("held"))
    assert {r["_batch_id"]: (r["n"], r["held"]) for r in counts.collect()} == {"d1": (10, 5), "d2": (10, 5), "d3": (0, 0)}
    nothing = pipeline.apply_corrections(spark, path, "RAW.T", "_batch_id", plan, decided.where("batch_id = 'd2'"), named)
    assert nothing.isEmpty()
