"""Files, raw batches, histories, catalogue, verdicts and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from limpid import schemas
from limpid.plans import silver
from limpid.session import release_stages, stage, staging_root
from limpid.sources import batches, catalog, history, ledger, verdicts
from limpid.streaming import ingest, metrics


def put(folder, table, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{table}.csv").write_text(text, encoding="utf-8")


def test_text_stays_text_and_tokens_become_null(spark, tmp_path):
    put(tmp_path, "t", 'a,b\n001,NA\n"x, ""y""\nz",null\nnan,7\n')
    df = batches.read_text_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("a", "string"), ("b", "string")]
    # rows come in no order, as the lines of one record are put together apart from the rest
    assert {tuple(r) for r in df.collect()} == {("001", None), ('x, "y"\nz', None), (None, "7")}
    kept = batches.read_text_table(spark, str(tmp_path / "t.csv"), keep_tokens=True)
    assert kept.where("a = '001'").first()["b"] == "NA"


def test_loading_twice_changes_nothing(spark, tmp_path):
    root, bronze = tmp_path / "incoming", str(tmp_path / "bronze")
    put(root / "2018-03-01", "payments", "order_id,payment_value\n1,10.5\n2,\n")
    put(root / "2018-03-02", "payments", "order_id,amount\n3,7\n")
    for day in ("2018-03-01", "2018-03-01", "2018-03-02"):
        got = batches.load_batch(spark, str(root), day, bronze)
    assert [tuple(r) for r in got.collect()] == [("payments", "2018-03-02", 1)]
    raw = batches.read_batches(spark, f"{bronze}/payments")
    assert raw.count() == 3 and {"payment_value", "amount", *batches.META} <= set(raw.columns)
    typed = silver.order_payments(
        raw.withColumn("payment_sequential", F.lit("1")).withColumn("payment_type", F.lit("x")).withColumn("payment_installments", F.lit("1.5"))
    )
    assert {(r["order_id"], r["payment_amount"] and str(r["payment_amount"]), r["payment_installments"]) for r in typed.collect()} == {
        ("1", "10.50", 2), ("2", None, 2), ("3", None, 2)}
    log = batches.read_batches(spark, f"{bronze}/_schema_history")
    assert {(r["batch_id"], r["column_name"], r["ordinal_position"]) for r in log.collect()} == {
        ("2018-03-01", "ORDER_ID", 1), ("2018-03-01", "PAYMENT_VALUE", 2), ("2018-03-02", "ORDER_ID", 1), ("2018-03-02", "AMOUNT", 2)}
    before = history.read_schema(log, "RAW.PAYMENTS", before="2018-03-02")
    assert [r["column_name"] for r in before.collect()] == ["ORDER_ID", "PAYMENT_VALUE"]
    exact = history.read_schema(log, "payments", batch_id="2018-03-02")
    assert [r["column_name"] for r in exact.collect()] == ["ORDER_ID", "AMOUNT"]
    with pytest.raises(FileNotFoundError):
        batches.load_batch(spark, str(root), "2018-03-09", bronze)


def test_silver_types(spark):
    raw = spark.createDataFrame(
        [("o", "c", "delivered", "2018-04-29 23:12:01", None, "x", "2018-05-02 00:10:00", "2018-05-01")],
        "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_approved_at string, "
        "order_delivered_carrier_date string, order_delivered_customer_date string, order_estimated_delivery_date string",
    )
    o = silver.orders(raw)
    types = dict(o.dtypes)
    assert types["order_purchase_ts"] == "timestamp_ntz" and types["order_purchase_date"] == "date"
    from limpid.plans import gold

    r = gold.delivery_delays(o).first()
    assert (r["delivery_days"], r["delay_vs_estimate"]) == (3, 1)
    items = spark.createDataFrame([("o", None, "p", "s", "2018", "1.005", "x")],
        "order_id string, order_item_id string, product_id string, seller_id string, shipping_limit_date string, price string, freight_value string")
    i = silver.order_items(items).first()
    assert i["order_item_sk"] is None and str(i["price"]) == "1.01" and i["freight_value"] is None


def test_registry_rules(spark):
    ok = {"name": "RAW.ORDERS", "layer": "bronze", "batch_column": "_batch_id"}
    reg = catalog.registry(spark, "shop", [ok, {"name": "MARTS.M", "layer": "gold"}])
    assert reg.schema.fieldNames() == schemas.REGISTRY.fieldNames()
    assert [r["table_name"] for r in catalog.tables_of(reg, "gold").collect()] == ["MARTS.M"]
    for bad in ([ok, {**ok, "name": "raw.orders"}], [{**ok, "layer": "iron"}], [{**ok, "x": 1}], [{**ok, "name": "ORDERS"}], [{**ok, "name": "RAW.OR DERS"}], []):
        with pytest.raises(ValueError):
            catalog.registry(spark, "shop", bad)
    rows = spark.createDataFrame([("shop", "RAW.A", "bronze", None), ("shop", "raw.a", "iron", None), ("shop", "B", "gold", None)], schemas.REGISTRY)
    assert {(r["table_name"], r["fault"]) for r in catalog.registry_errors(rows).collect()} == {
        ("RAW.A", "duplicate_table"), ("RAW.A", "bad_layer"), ("B", "unqualified_name")}
    with pytest.raises(ValueError):
        catalog.gold_view(reg, "RAW.ORDERS", lambda _: reg)


def test_bounded_rows_say_whether_there_was_more(spark):
    rows, more = catalog.bounded_rows(spark.range(101), 100)
    assert rows.count() == 100 and more
    rows, more = catalog.bounded_rows(spark.range(100), 100)
    assert rows.count() == 100 and not more


def test_present_tables_and_schemas(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS limpid_raw")
    spark.sql("DROP TABLE IF EXISTS limpid_raw.t1")
    spark.range(3).write.saveAsTable("limpid_raw.t1")
    try:
        assert [r[0] for r in catalog.present_tables(spark, ["limpid_raw"]).collect()] == ["LIMPID_RAW.T1"]
        assert catalog.present_tables(spark, ["ops"]).isEmpty()
        got = catalog.get_schema(spark, "limpid_raw.t1").first()
        assert (got["column_name"], got["type"], got["position"]) == ("id", "bigint", 1)
        assert catalog.get_schema(spark, "limpid_raw.nothing") is None
    finally:
        spark.sql("DROP TABLE limpid_raw.t1")
        spark.sql("DROP DATABASE limpid_raw")


def test_day_window(spark):
    w = ("2018-03-01", "2018-05-31")
    assert batches.day_window(spark, *w, w).count() == 92
    for a, b in (("2018-02-28", "2018-03-02"), ("2018-05-30", "2018-06-01"), ("2018-04-02", "2018-04-01")):
        with pytest.raises(ValueError):
            batches.day_window(spark, a, b, w)


def test_metric_series_count_batches_not_days(spark):
    rows = [("s", "T", b, None, "row_count", v) for b, v in (("2018-01-01", 1.0), ("2018-01-05", 2.0), ("2018-02-01", 3.0), ("2018-02-02", 4.0))]
    m = spark.createDataFrame(rows, schemas.PROFILE_METRIC)
    assert history.metric_history(m, "s", "T", "2018-02-02", 2).first()["series"] == [2.0, 3.0]
    assert history.metric_history(m, "s", "T").first()["series"] == [1.0, 2.0, 3.0, 4.0]
    assert history.metric_history(m, "s", "U").isEmpty()


def test_incidents_are_appended_and_read_newest_first(spark, tmp_path):
    names = schemas.INCIDENT.fieldNames()
    one = lambda i, d: spark.createDataFrame([tuple({"incident_id": str(i), "run_ts": datetime.datetime(2018, 1, i), "dataset": "s", "layer": "bronze", "table_name": "T", "batch_id": f"2018-01-{i:02d}", "human_decision": d}.get(n) for n in names)], schemas.INCIDENT)
    for i, d in ((1, "approved"), (2, None), (3, "rejected")):
        history.append_incidents(one(i, d), str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    assert [r["incident_id"] for r in history.decided_incidents(stored, "s", "T").collect()] == ["3", "1"]
    assert [r["incident_id"] for r in history.journal(stored, "s", since="2018-01-02", layer="bronze").collect()] == ["3", "2"]
    df = spark.createDataFrame([('{"a": 1}',), ("{broken",)], "j string")
    assert [r[0] and r[0]["a"] for r in df.select(history.decode_json("j", "struct<a:int>")).collect()] == [1, None]


def test_verdicts(spark, tmp_path):
    results = {"results": [
        {"unique_id": "test.p.not_null_x.1", "status": "fail", "failures": 5},
        {"unique_id": "test.p.unique_x.2", "status": "pass", "failures": 0},
        {"unique_id": "test.p.lost.3", "status": "error", "failures": None},
        {"unique_id": "model.p.m", "status": "error"},
    ]}
    nodes = {"nodes": {"test.p.not_null_x.1": {"name": "not_null_stg_orders", "column_name": "customer_id",
                                             "attached_node": "model.p.stg_orders", "test_metadata": {"name": "not_null"}}}}
    r, m = tmp_path / "run_results.json", tmp_path / "manifest.json"
    reg = catalog.registry(spark, "shop", [{"name": "STAGING.STG_ORDERS", "layer": "silver"}])
    assert verdicts.read_verdicts(spark, str(r), str(m), reg).isEmpty()
    r.write_text(json.dumps(results, indent=1))
    m.write_text(json.dumps(nodes, indent=1))
    got = {tuple(x) for x in verdicts.read_verdicts(spark, str(r), str(m), reg).collect()}
    assert got == {("STAGING.STG_ORDERS", "CUSTOMER_ID", "not_null_stg_orders", "not_null", "completude", 5, "fail"),
                   (None, None, "test.p.lost", None, "exactitude", None, "error")}
    r.write_text("{broken")
    assert verdicts.read_verdicts(spark, str(r), str(m), reg).isEmpty()


def test_stream_replaces_batches_by_deliveries(spark, tmp_path):
    folder, bronze, state = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "state")

    def run():
        ingest.ingest(spark, str(folder), "orders*", ["id", "v"], bronze, state).awaitTermination()
        return sorted(((r["_batch_id"], r["id"], r["v"]) for r in batches.read_batches(spark, bronze).collect()), key=str)

    put(folder / "2018-03-01", "orders", "id,v\n1,a\n2,NA\n")
    assert run() == [("2018-03-01", "1", "a"), ("2018-03-01", "2", None)]
    put(folder / "2018-03-02", "orders", "id,v\n3,c\n4,d\n")
    got = run()
    assert got == [("2018-03-01", "1", "a"), ("2018-03-01", "2", None), ("2018-03-02", "3", "c"), ("2018-03-02", "4", "d")]
    assert run() == got
    # another file of the same delivery adds, a new delivery replaces, also with fewer rows or none
    put(folder / "2018-03-01", "orders2", "id,v\n5,e\n")
    assert [r[1] for r in run()] == ["1", "2", "5", "3", "4"]
    put(folder / "2018-03-02" / "again", "orders", "id,v\n4,x\n")
    put(folder / "2018-03-01" / "again", "orders", "id,v\n")
    assert run() == [("2018-03-02", "4", "x")]


def test_a_write_counts_when_its_ledger_says_so(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda b, *ids: spark.createDataFrame([(i, b) for i in ids], "id int, _batch_id string")
    first = ledger.deliver(day("d1", 1, 2).unionByName(day(None, 9)), path, ["_batch_id"])
    assert first.rows == {("d1",): 2, (None,): 1}
    # files without an entry are not there: a write that failed before its switch
    day("d1", 7).drop("_batch_id").write.parquet(f"{path}/data/_version=lost/_batch_id=d1")
    ids = lambda: sorted((str(r["_batch_id"]), r["id"]) for r in ledger.read(spark, path).collect())
    assert ids() == [("None", 9), ("d1", 1), ("d1", 2)]
    # a write repeated under its version counts once, writes of one delivery add
    for _ in range(2):
        ledger.deliver(day("d2", 5), path, ["_batch_id"], delivery="x", version="v1")
    ledger.deliver(day("d2", 6), path, ["_batch_id"], delivery="x", version="v2")
    assert [i for b, i in ids() if b == "d2"] == [5, 6]
    ledger.deliver(day("d2", 8), path, ["_batch_id"], [("d1",)])
    assert ids() == [("None", 9), ("d2", 8)]
    ledger.drop(spark, path, (None,))
    assert ids() == [("d2", 8)]
    assert ledger.vacuum(spark, path) == 4 and ids() == [("d2", 8)]
    with pytest.raises(ValueError):
        ledger.deliver(day("d3", 1).select(F.col("id").cast("string"), "_batch_id"), path, ["_batch_id"])
        ledger.read(spark, path)


def test_closed_windows_are_stored_and_judged_once(spark, tmp_path):
    store, found, state = (str(tmp_path / x) for x in ("metrics", "found", "state"))
    schema, folder = "ts timestamp, kind string", tmp_path / "in"
    start = datetime.datetime(2024, 1, 1)

    def put_days(first, last, per_day=4):
        rows = [(start + datetime.timedelta(days=d, hours=h), None if d == 20 else "k") for d in range(first, last) for h in range(per_day)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(folder))
        metrics.watch(stream, "ts", ["kind"], "shop", "RAW.E", store, found, state).awaitTermination()
        rows = batches.read_batches(spark, store).where("metric = 'row_count'").collect()
        return {r["batch_id"]: r["value"] for r in rows}

    put_days(0, 19)
    days = [f"2024-01-{d:02d}" for d in range(1, 25)]
    assert run() == dict.fromkeys(days[:17], 4.0)
    put_days(2, 3)   # late: its day is closed
    put_days(19, 25)
    assert run() == dict.fromkeys(days[:23], 4.0)
    judged = batches.read_batches(spark, found).collect()
    assert {(r["batch_id"], r["column_name"], r["details"]["metric"], r["type"]) for r in judged} == {
        ("2024-01-21", "kind", m, "rupture_de_constante") for m in ("null_count", "distinct")}


def test_metrics_of_batch_and_stream_agree(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = metrics.windowed_metrics(e, "ts", ["event_type"])
    long = metrics.as_metric_rows(rows, "shop", "RAW.EVENTS", ["event_type"])
    assert long.schema.fieldNames() == schemas.PROFILE_METRIC.fieldNames() and long.count() == 3 * rows.count()
    e.write.parquet(str(tmp_path / "in"))
    stream = metrics.windowed_metrics(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    pick = lambda df: {(r["batch_id"], r["row_count"]) for r in df.collect()}
    assert pick(spark.table("windows")) == pick(rows)


def test_staging_follows_the_configured_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("limpid.session.configured_folder", lambda _: str(tmp_path))
    assert staging_root(spark) == str(tmp_path / "limpid" / spark.sparkContext.applicationId)
    assert stage(spark.range(5), "x").count() == 5 and list(tmp_path.rglob("*.parquet"))
    release_stages(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_daily_files_are_the_same_every_time(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("_batch_id"))

    def content(path, df):
        batches.write_days(df, str(path))
        out = spark.read.parquet(str(path)).withColumn("f", F.regexp_extract(F.input_file_name(), r"_batch_id=([^/]+)/part-(\d+)", 0))
        return sorted((r["f"], r["event_id"], r["event_type"]) for r in out.collect())

    assert content(tmp_path / "a", e) == content(tmp_path / "b", e.repartition(13))
