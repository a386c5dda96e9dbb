"""Reading and writing: text files, raw batches, verdict files, streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.catalogue.corruption import SQL_RAMPED, ramped_events
from limpid.operators import detect as D
from limpid.plans import gold, silver
from limpid.session import scratch_path
from limpid.sources import batches, catalog, history, verdicts
from limpid.streaming import ingest, metrics


@query("csv_missing_tokens", """
SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS first_key FROM customer GROUP BY 1
""")
def csv_missing_tokens(spark, d):
    """A text round trip: every column a string, several spellings of missing."""
    path = scratch_path(spark, "csv")
    segment = F.col("c_mktsegment")
    t.read(spark, d, "customer").select(
        "c_custkey", F.when(segment == "BUILDING", "N/A").when(segment == "FURNITURE", "null").otherwise(segment)
        .alias("c_mktsegment"),
    ).write.option("header", True).csv(path)
    return batches.read_text_table(spark, path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key")
    )


@query("raw_batches_replaced", f"""
WITH {t.SQL_EVENTS} SELECT b AS batch_id, count(*) AS "rows",
  count(*) FILTER (WHERE b >= '2024-01-20') AS with_amount, count(*) FILTER (WHERE b < '2024-01-20') AS with_value
FROM ev GROUP BY 1
""")
def raw_batches_replaced(spark, d):
    """Loaded twice and renamed on the way: same rows, two sparse columns."""
    path = scratch_path(spark, "bronze")
    e = t.events_by_day(spark, d).select("event_id", F.col("value").cast("string").alias("value"), t.BATCH)
    raw = batches.stamp(e, F.col(t.BATCH), "events.csv")
    batches.write_batches(raw, path)
    batches.write_batches(
        raw.where(F.col(t.BATCH) >= "2024-01-20").withColumnRenamed("value", "amount"), path
    )
    return batches.read_batches(spark, path).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("amount").alias("with_amount"),
        F.count("value").alias("with_value"),
    )


def _write_incoming(spark, d, folder: str) -> list[str]:
    """One folder per order status with an ``orders.csv`` each."""
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o.write.partitionBy("o_orderstatus").option("header", True).csv(folder + "/by_status")
    names = batches.child_names(spark, folder + "/by_status")
    return [n for n in names if n.startswith("o_orderstatus=")]


@query("loaded_batches", """
SELECT o_orderstatus AS batch_id, 'orders' AS table_name, count(*) AS "rows" FROM orders GROUP BY 1
""")
def loaded_batches(spark, d):
    """Batch folders of text files loaded into the raw layer, each one twice."""
    root = scratch_path(spark, "incoming")
    names = _write_incoming(spark, d, root)
    out = None
    for n in names:
        batch = n.split("=")[1]
        part = spark.read.option("header", True).csv(f"{root}/by_status/{n}")
        part.write.option("header", True).csv(f"{root}/{batch}/orders.csv")
        batches.load_batch(spark, root, batch, f"{root}/bronze")
        loaded = batches.load_batch(spark, root, batch, f"{root}/bronze")
        out = loaded if out is None else out.unionByName(loaded)
    return out.select("batch_id", "table_name", "rows")


@query("raw_batches_emptied", """
SELECT o_orderstatus AS batch_id, count(*) AS "rows" FROM orders WHERE o_orderstatus <> 'P' AND (o_orderstatus <> 'F' OR o_orderkey % 3 = 0) GROUP BY 1
""")
def raw_batches_emptied(spark, d):
    """Batches delivered again: one shorter, one with a header and no rows."""
    root = scratch_path(spark, "incoming")
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first, again = f"{root}/first", f"{root}/again"
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).write.option("header", True).csv(f"{first}/{status}/orders.csv")
        batches.load_batch(spark, first, status, f"{root}/bronze")
    o.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").write.option("header", True).csv(f"{again}/F/orders.csv")
    o.where("o_orderstatus = '-'").coalesce(1).write.option("header", True).csv(f"{again}/P/orders.csv")
    for status in ("F", "P"):
        batches.load_batch(spark, again, status, f"{root}/bronze")
    return batches.read_batches(spark, f"{root}/bronze/orders").groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"))


def _drifting(spark, d) -> str:
    """Events by day; from the 20th on ``value`` arrives as ``amount``, and ``props`` is new."""
    path = scratch_path(spark, "bronze")
    e = t.events_by_day(spark, d).select("event_id", F.col("value").cast("string").alias("value"), "props", t.BATCH)
    late = F.col(t.BATCH) >= "2024-01-20"
    batches.write_batches(e.where(~late).drop("props"), path)
    batches.write_batches(e.where(late).withColumnRenamed("value", "amount"), path)
    return path


@query("raw_table_as_of", f"""
WITH {t.SQL_EVENTS}, c AS (SELECT '2024-01-19' AS upto UNION ALL SELECT '2024-01-25')
SELECT upto, count(*) AS "rows", CASE WHEN upto < '2024-01-20' THEN 'event_id,value,_batch_id' ELSE 'event_id,value,amount,props,_batch_id' END AS columns
FROM c JOIN ev ON b <= upto GROUP BY upto
""")
def raw_table_as_of(spark, d):
    """A raw table as it was known at two batches: rows and columns of the deliveries until then."""
    path, out = _drifting(spark, d), None
    for upto in ("2024-01-19", "2024-01-25"):
        rows = batches.read_batches(spark, path, upto)
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(upto).alias("upto"), "rows", F.lit(",".join(rows.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("schema_history_read", """
SELECT s AS batch_id, 'orders' AS table_name, c AS column_name, CAST(p AS INTEGER) AS ordinal_position
FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (VALUES ('O_ORDERKEY', 1), ('O_TOTALPRICE', 2)) v(c, p)
""")
def schema_history_read(spark, d):
    """What loading noted about the columns of every batch; loaded twice, noted once."""
    root = scratch_path(spark, "incoming")
    for n in _write_incoming(spark, d, root):
        batch = n.split("=")[1]
        spark.read.option("header", True).csv(f"{root}/by_status/{n}").write.option("header", True).csv(f"{root}/{batch}/orders.csv")
        for _ in range(2):
            batches.load_batch(spark, root, batch, f"{root}/bronze")
    log = batches.read_batches(spark, f"{root}/bronze/_schema_history")
    return log.select("batch_id", "table_name", "column_name", "ordinal_position")


@query("stored_metrics_replaced", f"""
WITH {t.SQL_EVENTS} SELECT b AS batch_id, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY 1
""")
def stored_metrics_replaced(spark, d):
    """Metrics written twice per batch are there once."""
    path = scratch_path(spark, "metrics")
    rows = t.events_by_day(spark, d).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).select(
        F.lit("shop").alias("dataset"), F.lit("RAW.EVENTS").alias("table_name"), "batch_id",
        F.lit(None).cast("string").alias("column_name"), F.lit("row_count").alias("metric"), "value",
    )
    history.write_metrics(rows, path)
    history.write_metrics(rows, path)
    return batches.read_batches(spark, path).select("batch_id", "value")


@query("sorted_daily_files", f"""
WITH {t.SQL_EVENTS} SELECT b AS batch_id, count(*) AS "rows", min(event_id) AS first_id, max(event_id) AS last_id, 0 AS descents FROM ev GROUP BY 1
""")
def sorted_daily_files(spark, d):
    """Daily files: all rows of the day, and in none of them a row below the one before it."""
    path = scratch_path(spark, "days")
    batches.write_days(t.events_by_day(spark, d).select("event_id", "event_type", t.BATCH), path)
    stored = spark.read.schema(f"event_id bigint, event_type string, {t.BATCH} string").parquet(path)
    place = Window.partitionBy("file").orderBy("at")
    rows = stored.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    fell = F.struct("event_id", "event_type") < F.lag(F.struct("event_id", "event_type")).over(place)
    return rows.withColumn("fell", F.coalesce(fell, F.lit(False)).cast("int")).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        F.sum("fell").cast("int").alias("descents"))


@query("gold_view", """
WITH paid AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS amount FROM lineitem GROUP BY 1)
SELECT upper(c_mktsegment) AS customer_state, n_name AS customer_city, CAST(sum(amount) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN paid ON o_orderkey = k
GROUP BY 1, 2 ORDER BY revenue DESC NULLS LAST LIMIT 20
""")
def gold_view(spark, d):
    """A bounded look at a declared mart, in the order of the mart."""
    reg = catalog.registry(spark, "shop", [
        {"name": "MARTS.FCT_SALES_BY_CITY_STATE", "layer": "gold"},
        {"name": "RAW.ORDERS", "layer": "bronze", "batch_column": t.BATCH},
    ])
    mart = gold.sales_by_city_state(
        silver.orders(t.raw_orders(spark, d)), silver.customers(t.raw_customers(spark, d)),
        silver.order_payments(t.raw_payments(spark, d)),
    )
    rows, more = catalog.gold_view(reg, "MARTS.FCT_SALES_BY_CITY_STATE", lambda _: mart, 20)
    if not more:
        raise AssertionError("the mart has more rows than shown")
    return rows.select("customer_state", "customer_city", F.col("revenue").cast("double").alias("revenue"))


@query("day_window", f"""
WITH {t.SQL_EVENTS} SELECT strftime(g, '%Y-%m-%d') AS batch_id, (SELECT count(*) FROM ev WHERE b = strftime(g, '%Y-%m-%d')) AS "rows"
FROM range(DATE '2024-01-03', DATE '2024-02-04', INTERVAL 1 DAY) r(g)
""")
def day_window(spark, d):
    """Every day of a window, with the rows delivered for it, none included."""
    days = batches.day_window(spark, "2024-01-03", "2024-02-03", ("2024-01-01", "2024-02-28"))
    sizes = t.events_by_day(spark, d).groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return days.join(sizes, "batch_id", "left").select("batch_id", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("slice_of_day", """
WITH o AS (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03')
SELECT 'orders' AS part, count(*) AS n FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)
UNION ALL SELECT 'nation', count(*) FROM nation
""")
def slice_of_day(spark, d):
    """One day: its orders, the rows they refer to, and reference data on day one."""
    parts = batches.slice_of_day(
        t.read(spark, d, "orders"), F.col("o_orderdate"), "1998-10-03", "o_orderkey",
        {"lineitem": (t.read(spark, d, "lineitem"), "l_orderkey")},
        {"customer": (t.read(spark, d, "customer"), "c_custkey", "o_custkey")},
        {"nation": t.read(spark, d, "nation")}, "1998-10-03",
    )
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("external_verdicts", f"""
WITH {SQL_RAMPED}, r AS (SELECT b, count(*) - count(event_type) AS f FROM ramped GROUP BY 1)
SELECT 'RAW.EVENTS' AS table_name, 'EVENT_TYPE' AS column_name, 'not_null_' || b AS test, 'completude' AS dama,
       CAST(f AS DOUBLE) AS magnitude FROM r WHERE f > 0
""")
def external_verdicts(spark, d):
    """Result files of a test runner, one test per day, read back and translated."""
    root = scratch_path(spark, "runner")
    failures = ramped_events(spark, d).groupBy(t.BATCH).agg(
        F.count_if(F.col("event_type").isNull()).alias("failures")
    )
    uid = F.concat(F.lit("test.shop.not_null."), F.col(t.BATCH))
    # one small document per artefact, as the runner writes them: a test per day
    failures.agg(F.to_json(F.struct(F.collect_list(F.struct(
        uid.alias("unique_id"), F.when(F.col("failures") > 0, "fail").otherwise("pass").alias("status"), "failures"
    )).alias("results"))).alias("value")).write.text(root + "/run_results.json")
    node = F.struct(
        F.concat(F.lit("not_null_"), F.col(t.BATCH)).alias("name"), F.lit("event_type").alias("column_name"),
        F.lit("model.shop.events").alias("attached_node"),
        F.struct(F.lit("not_null").alias("name")).alias("test_metadata"),
    )
    failures.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(uid, node))).alias("nodes"))).alias(
        "value")).write.text(root + "/manifest.json")
    reg = catalog.registry(spark, "shop", [{"name": "RAW.EVENTS", "layer": "bronze"}])
    failing = verdicts.read_verdicts(spark, root + "/run_results.json", root + "/manifest.json", reg)
    found = D.external(failing, "2024-01-30", "RAW.EVENTS")
    return found.select(
        "table_name", "column_name", F.col("details")["test"].alias("test"), "dama", "magnitude"
    )


@query("windowed_event_metrics", f"""
WITH {SQL_RAMPED} SELECT b AS batch_id, count(*) AS row_count, count(*) - count(event_type) AS null_count__event_type FROM ramped GROUP BY 1
""")
def windowed_event_metrics(spark, d):
    rows = metrics.windowed_metrics(ramped_events(spark, d), "ts", ["event_type"])
    return rows.select("batch_id", "row_count", "null_count__event_type")


_CLOSED = "CAST(b AS DATE) + 2 <= (SELECT max(ts) FROM events)"


def _watched(spark, d) -> tuple[str, str]:
    """The damaged events as a stream: metrics and anomalies of the days that are closed."""
    folder, store, found, state = (scratch_path(spark, x) for x in ("stream-in", "stream-metrics", "stream-found", "stream-state"))
    source = ramped_events(spark, d).drop(t.BATCH)
    source.write.parquet(folder)
    # events of the first day that come after it was closed: dropped
    stream = spark.readStream.schema(source.schema).parquet(folder)
    metrics.watch(stream, "ts", ["event_type"], "shop", "RAW.EVENTS", store, found, state).awaitTermination()
    source.where("ts < TIMESTAMP '2024-01-02'").limit(50).write.mode("append").parquet(folder)
    metrics.watch(stream, "ts", ["event_type"], "shop", "RAW.EVENTS", store, found, state).awaitTermination()
    return store, found


@query("streamed_event_metrics", f"""
WITH {SQL_RAMPED}, m AS (SELECT b, count(*) AS n, count(*) - count(event_type) AS f FROM ramped WHERE {_CLOSED} GROUP BY 1)
SELECT b AS batch_id, CAST(NULL AS VARCHAR) AS column_name, 'row_count' AS metric, CAST(n AS DOUBLE) AS value FROM m
UNION ALL SELECT b, 'event_type', 'null_count', CAST(f AS DOUBLE) FROM m
""")
def streamed_event_metrics(spark, d):
    """Metrics of a stream, stored once per closed day; rows that come too late change nothing."""
    store, _ = _watched(spark, d)
    return batches.read_batches(spark, store).where("metric <> 'distinct'").select("batch_id", "column_name", "metric", "value")


@query("streamed_statistical", f"""
WITH {SQL_RAMPED}, m AS (SELECT b, count(*) AS n, count(*) - count(event_type) AS f FROM ramped WHERE {_CLOSED} GROUP BY 1),
v AS (SELECT b, CAST(NULL AS VARCHAR) AS c, 'row_count' AS metric, CAST(n AS DOUBLE) AS v FROM m UNION ALL SELECT b, 'event_type', 'null_count', CAST(f AS DOUBLE) FROM m),
no AS (SELECT b, row_number() OVER (ORDER BY b) AS r FROM m), vv AS (SELECT v.*, r FROM v JOIN no USING (b)),
ref AS (SELECT x.b, x.c, x.metric, x.v, count(*) AS batches, median(y.v) AS med, mad(y.v) AS mad
    FROM vv x JOIN vv y ON x.metric = y.metric AND y.r BETWEEN x.r - 30 AND x.r - 1 GROUP BY ALL)
SELECT b AS batch_id, c AS column_name, metric, v AS observed,
    CASE WHEN mad = 0 THEN 'rupture_de_constante' ELSE 'derive_statistique' END AS type,
    round(CASE WHEN mad = 0 THEN abs(v - med) ELSE abs(0.6745::DOUBLE * (v - med) / mad) END, 6) AS magnitude
FROM ref WHERE batches >= 15 AND CASE WHEN mad = 0 THEN v <> med ELSE abs(0.6745::DOUBLE * (v - med) / mad) > 3.5 END
""")
def streamed_statistical(spark, d):
    """Closed days of a stream against the days before them, judged as they close."""
    _, found = _watched(spark, d)
    rows = batches.read_batches(spark, found).withColumn("metric", F.col("details")["metric"]).where("metric <> 'distinct'")
    return rows.select("batch_id", "column_name", "metric", F.col("observed_num").alias("observed"), "type", F.round("magnitude", 6).alias("magnitude"))


@query("streamed_redelivery", """
SELECT o_orderstatus AS batch_id, count(*) AS "rows", max(o_orderkey) AS last_key FROM orders
WHERE o_orderstatus <> 'P' AND (o_orderstatus <> 'F' OR o_orderkey % 3 = 0) GROUP BY 1
""")
def streamed_redelivery(spark, d):
    """A stream that gets one batch again with fewer rows, and one with none, beside a batch of the daily load."""
    root, state = scratch_path(spark, "stream-batches"), scratch_path(spark, "stream-state")
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    columns = ["o_orderkey", "o_orderstatus"]

    def put(rows, folder):
        rows.write.option("header", True).csv(folder)

    def run():
        ingest.ingest(spark, f"{root}/in", "part-*", columns, f"{root}/bronze/orders", state).awaitTermination()

    for status in ("F", "P"):
        put(o.where(F.col("o_orderstatus") == status), f"{root}/in/{status}/1")
    put(o.where("o_orderstatus = 'O'"), f"{root}/load/O/orders.csv")
    run()
    batches.load_batch(spark, f"{root}/load", "O", f"{root}/bronze")
    put(o.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0"), f"{root}/in/F/2")
    put(o.where("o_orderstatus = '-'").coalesce(1), f"{root}/in/P/2")
    run()
    return batches.read_batches(spark, f"{root}/bronze/orders").groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("o_orderkey").cast("long")).alias("last_key"))


@query("streamed_ingestion", """
SELECT o_orderstatus AS batch_id, count(*) AS "rows", count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1
""")
def streamed_ingestion(spark, d):
    """Text batches taken in as they arrive; a second run finds nothing new."""
    root = scratch_path(spark, "stream-batches")
    _write_incoming(spark, d, root)
    bronze, state = root + "/bronze", scratch_path(spark, "stream-state")

    for _ in range(2):
        ingest.ingest(
            spark, root + "/by_status", "part-*", ["o_orderkey", "o_totalprice"], bronze, state
        ).awaitTermination()
    loaded = batches.read_batches(spark, bronze)
    status = F.element_at(F.split(t.BATCH, "="), -1)
    return loaded.groupBy(status.alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys")
    )
