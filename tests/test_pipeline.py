"""One whole round on a raw layer: discover, sign, damage, detect, decide, correct, verify."""

import pytest
from pyspark.sql import functions as F

from limpid import schemas
from limpid.operators import contracts as C, corrections as K, corrupt, memory as M
from limpid.operators.profile import profile_metrics, profile_table
from limpid.plans import pipeline
from limpid.session import stage
from limpid.sources import catalog


@pytest.fixture(scope="module")
def world(spark, sf):
    # two batches of a thousand rows each, twenty quiet ones before for the history
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("_batch_id"), "event_id", "event_type", "value"
    )
    quiet = e.where(F.col("_batch_id") < "2024-01-25")
    day = e.where(F.col("_batch_id") == "2024-01-28")
    damaged = corrupt.inject_nulls(day, "event_type", 0.4, "_batch_id", ["event_id"])
    click = F.when(F.col("event_type") == "click", F.lit("CLICK")).otherwise(F.col("event_type"))
    half = damaged.withColumn("event_type", F.when(F.col("value") > 30, click).otherwise(F.col("event_type")))
    reg = catalog.registry(spark, "shop", [
        {"name": "RAW.EVENTS", "layer": "bronze", "batch_column": "_batch_id"},
        {"name": "RAW.GONE", "layer": "bronze", "batch_column": "_batch_id"},
        {"name": "MARTS.M", "layer": "gold"},
    ])
    return {"quiet": quiet, "day": stage(half.unionByName(quiet), "events"), "registry": reg}


def test_round(spark, world):
    reg, table = world["registry"], world["day"]

    def resolve(name):
        if name != "RAW.EVENTS":
            raise LookupError(name)
        return world["quiet"]

    clauses, warnings, failures = pipeline.discover("shop", reg, resolve)
    assert len(failures) == 2 and clauses.select("table_name").distinct().count() == 1
    signed = stage(C.approve(clauses, warnings, "shop", "RAW.EVENTS", "ana", accept_warnings=True), "contract")

    past = profile_table(world["quiet"], "RAW.EVENTS", "shop", "_batch_id")
    metrics = stage(profile_metrics(past), "metrics")
    log = world["quiet"].select("_batch_id").distinct().select(
        F.col("_batch_id").alias("batch_id"), F.lit("events").alias("table_name"),
        F.explode(F.array(*[F.lit(c) for c in ("_BATCH_ID", "EVENT_ID", "EVENT_TYPE", "PRICE")])).alias("column_name"),
    )
    present = spark.createDataFrame([("RAW.EVENTS",), ("MARTS.M",)], "table_name string")
    refs = pipeline.References(metrics=metrics, contracts=signed, schema_history=log, present=present)
    day = "2024-01-28"
    read = lambda name: table if name == "RAW.EVENTS" else resolve(name)
    profiles, found, failures = pipeline.check_layer(spark, "shop", "bronze", day, reg, read, refs)
    assert len(failures) == 1 and failures[0].startswith("RAW.GONE")
    assert profiles.schema.fieldNames() == schemas.PROFILE_COLUMN.fieldNames()
    kinds = {(r["family"], r["type"], r["column_name"]) for r in found.collect()}
    assert {
        ("inventory", "table_absente", None), ("schema", "colonne_disparue", "PRICE"),
        ("schema", "colonne_nouvelle", "VALUE"), ("contract", "nulls_interdits", "event_type"),
        ("contract", "valeur_non_admise", "event_type"), ("semantic", "collision_semantique", "event_type"),
        ("statistical", "rupture_de_constante", "event_type"),
    } <= kinds

    mine = stage(found.where(F.col("table_name") == "RAW.EVENTS"), "mine")
    waiting = pipeline.proposals(mine, profiles)
    row = waiting.first()
    assert waiting.count() == 1 and row["choices"] == ["approved", "amend_contract", "rejected"]
    assert row["rows"] > 0 and "rows of" in row["summary"] and len(row["allowed_gestures"]) == 4

    spelled = mine.where(F.col("type").isin("collision_semantique", "valeur_non_admise"))
    fixed = K.normalise(table.where(F.col("_batch_id") == day), "event_type")
    verdict = pipeline.verify_batch(spark, fixed, spelled, "RAW.EVENTS", "shop", "_batch_id", day, reg, refs)
    assert verdict.first()["validation_status"] == "success"
    still = pipeline.verify_batch(spark, fixed, mine, "RAW.EVENTS", "shop", "_batch_id", day, reg, refs)
    assert still.first()["validation_status"] == "failed_manual_review"

    runs = spark.createDataFrame([("shop", "bronze", "RAW.EVENTS", day)], "dataset string, layer string, table_name string, batch_id string")
    runs = runs.withColumn("run_ts", F.lit("2024-01-28 06:00:00").cast("timestamp_ntz"))
    told = M.run_incidents(runs, mine, spark.createDataFrame(
        [("RAW.EVENTS", day, "rejected", "ana")], "table_name string, batch_id string, human_decision string, decided_by string"))
    told = stage(told, "incidents")
    assert told.schema.fieldNames() == schemas.INCIDENT.fieldNames()
    kept, silenced = M.split_silenced(mine, told)
    assert kept.isEmpty() and silenced.count() == mine.count()
    again = pipeline.proposals(mine, profiles, told)
    assert again.isEmpty()


def test_empty_layer_is_an_error(spark, world):
    with pytest.raises(ValueError):
        pipeline.check_layer(spark, "shop", "silver", "2024-01-28", world["registry"], lambda n: None, pipeline.References())
