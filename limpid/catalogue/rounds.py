"""Whole rounds: sweeps of a layer, full values, quarantine up to the marts, what is read and stored on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limpid import schemas
from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.catalogue.governance import SQL_SIGNED, _sql_clauses, incidents, signed_anomalies
from limpid.catalogue.detection import SQL_DAMAGED, damaged_profile, event_contract
from limpid.catalogue.marts import SQL_PAID
from limpid.functions import text
from limpid.operators import contracts as C, corrections as K, detect as D, impact, profile as P
from limpid.plans import gold, pipeline, silver
from limpid.session import scratch_path, stage
from limpid.sources import catalog, history

DAY = "2024-01-25"
HIGH = 60.0

# one day of events: a fourth without a type, a fourth in capitals
_SQL_DAY = f"""{t.SQL_EVENTS}, today AS (SELECT event_id, value,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(event_type) ELSE event_type END AS event_type FROM ev WHERE b = '{DAY}'),
type AS (SELECT event_type AS v, count(*) AS n FROM today WHERE event_type IS NOT NULL GROUP BY 1)"""


def _today(spark, d) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, F.upper("event_type")).otherwise(F.col("event_type"))
    return t.events_by_day(spark, d).select(t.BATCH, "event_id", kind.alias("event_type"), "value")


def _clause(table: str, column: str, clause: str, **given) -> tuple:
    values = {"dataset": "shop", "table_name": table, "version": 1, "status": "approved", "column_name": column, "clause": clause, **given}
    return tuple(values.get(f.name) for f in schemas.CONTRACT_CLAUSE.fields)


@t.shared
def swept(spark, d) -> DataFrame:
    """Anomalies of a layer of four declared tables, one of them gone under another name, and one that cannot be read."""
    registry = catalog.registry(spark, "shop", [
        {"name": n, "layer": "bronze", "batch_column": t.BATCH} for n in ("RAW.EVENTS", "RAW.CUSTOMERS", "RAW.LOST", "RAW.BROKEN")])
    customers = t.read(spark, d, "customer").select(F.lit(DAY).alias(t.BATCH), "c_nationkey", "c_mktsegment")

    def resolve(name: str) -> DataFrame:
        found = {"RAW.EVENTS": _today(spark, d), "RAW.CUSTOMERS": customers}
        # fails while it is read, not while it is planned
        found["RAW.BROKEN"] = customers.withColumn("c_mktsegment", F.raise_error(F.lit("unreadable")).cast("string"))
        return found[name]

    types = [r["event_type"] for r in t.read(spark, d, "events").select("event_type").where("event_type IS NOT NULL").distinct().collect()]
    contract = spark.createDataFrame([
        _clause("RAW.EVENTS", "event_type", "not_null"), _clause("RAW.EVENTS", "event_type", "accepted_values", values=types),
        _clause("RAW.EVENTS", "event_type", "no_semantic_collisions"), _clause("RAW.EVENTS", "value", "between", lo=0.0, hi=HIGH),
        _clause("RAW.CUSTOMERS", "c_nationkey", "unique"),
    ], schemas.CONTRACT_CLAUSE)
    days = [f"2024-01-{i:02d}" for i in range(1, 25)]
    log = spark.createDataFrame(
        [(days[-1], n, c, i + 1) for n, columns in (("events", "_BATCH_ID EVENT_ID EVENT_TYPE PRICE"), ("lost", "A B C")) for i, c in enumerate(columns.split())],
        "batch_id string, table_name string, column_name string, ordinal_position int")
    metrics = spark.createDataFrame(
        [("shop", "RAW.EVENTS", b, "event_type", "null_rate", 0.0) for b in days] + [("shop", "RAW.EVENTS", b, None, "row_count", 1.0 + i % 2) for i, b in enumerate(days)],
        schemas.PROFILE_METRIC)
    present = spark.createDataFrame([(n,) for n in ("RAW.EVENTS", "RAW.CUSTOMERS", "RAW.BROKEN", "RAW.FOUND")], "table_name string")
    columns = spark.createDataFrame([("RAW.FOUND", c) for c in "ABC"], "table_name string, column_name string")
    verdicts = spark.createDataFrame([("RAW.CUSTOMERS", "C_NATIONKEY", "unique_nation", "unique", "unicite", 7, "fail")],
                                     "table_name string, column_name string, test string, kind string, dama string, failures bigint, status string")
    refs = pipeline.References(metrics, log, contract, None, verdicts, present, columns)
    _, found, failures = pipeline.check_layer(spark, "shop", "bronze", DAY, registry, resolve, refs)
    # a declared table that is gone cannot be resolved either
    if sorted(f.split(":")[0] for f in failures) != ["RAW.BROKEN", "RAW.LOST"]:
        raise AssertionError(failures)
    return found


_SQL_SWEPT = f"""{_SQL_DAY}, x AS (
  SELECT 'RAW.LOST' AS table_name, 'inventory' AS family, 'table_absente' AS type, NULL AS column_name, NULL AS magnitude
  UNION ALL SELECT 'RAW.FOUND', 'inventory', 'table_non_declaree', NULL, NULL
  UNION ALL SELECT 'RAW.LOST', 'inventory', 'renommage_probable', NULL, NULL
  UNION ALL SELECT 'RAW.EVENTS', 'schema', 'colonne_disparue', 'PRICE', NULL
  UNION ALL SELECT 'RAW.EVENTS', 'schema', 'colonne_nouvelle', 'VALUE', NULL
  UNION ALL SELECT 'RAW.CUSTOMERS', 'schema', 'colonne_nouvelle', upper(c), NULL FROM (VALUES ('{t.BATCH}'), ('c_mktsegment')) v(c)
  UNION ALL SELECT 'RAW.EVENTS', 'contract', 'nulls_interdits', 'event_type', round((count(*) - count(event_type)) / count(*), 6) FROM today HAVING count(*) > count(event_type)
  UNION ALL SELECT 'RAW.EVENTS', 'contract', 'hors_bornes', 'value', round((max(value) - {HIGH}) / {HIGH}, 6) FROM today HAVING max(value) > {HIGH}
  UNION ALL SELECT 'RAW.EVENTS', 'contract', 'valeur_non_admise', 'event_type', CAST(count(*) AS DOUBLE) FROM type WHERE v <> lower(v) HAVING count(*) > 0
  UNION ALL SELECT 'RAW.CUSTOMERS', 'contract', 'doublons', 'c_nationkey', round((count(c_nationkey) - count(DISTINCT c_nationkey)) / count(c_nationkey), 6) FROM customer HAVING count(c_nationkey) > count(DISTINCT c_nationkey)
  UNION ALL SELECT 'RAW.EVENTS', 'statistical', 'rupture_de_constante', 'event_type', round((count(*) - count(event_type)) / count(*), 6) FROM today HAVING count(*) > count(event_type)
  UNION ALL SELECT 'RAW.EVENTS', 'statistical', 'derive_statistique', NULL, round(0.6745 * (count(*) - 1.5) / 0.5, 6) FROM today
  UNION ALL SELECT 'RAW.EVENTS', 'semantic', 'collision_semantique', 'event_type', CAST(sum(n) AS DOUBLE) FROM type GROUP BY lower(v) HAVING count(*) > 1
  UNION ALL SELECT 'RAW.CUSTOMERS', 'external', 'test_dbt_echoue', 'C_NATIONKEY', 7.0)"""


@query("layer_sweep", f"WITH {_SQL_SWEPT} SELECT table_name, family, type, column_name, magnitude FROM x")
def layer_sweep(spark, d):
    """All six families over a layer in one go; two tables fail, by name and by data, and cost the others nothing."""
    return swept(spark, d).select(
        "table_name", "family", "type", "column_name", F.round("magnitude", 6).alias("magnitude"))


@query("sweep_rename", """
SELECT 'RAW.LOST' AS table_name, 'RAW.FOUND' AS observed, '["A","B","C"]' AS common_columns
""")
def sweep_rename(spark, d):
    """A declared table whose last columns are those of an undeclared one, found by the sweep."""
    return swept(spark, d).where("type = 'renommage_probable'").select("table_name", "observed", F.col("details")["common_columns"].alias("common_columns"))


@query("anomalies_by_family", f"WITH {_SQL_SWEPT} SELECT family, count(*) AS anomalies FROM x GROUP BY family")
def anomalies_by_family(spark, d):
    """Counts of all six families."""
    return D.count_by_family(swept(spark, d))


@query("accepted_values_full", f"""
WITH {t.SQL_WORDS}, dv AS (SELECT source AS b, word AS v, count(*) AS n FROM w GROUP BY 1, 2)
SELECT b AS batch_id, CAST(count(*) AS BIGINT) AS kinds, CAST(sum(n) AS BIGINT) AS "rows" FROM dv WHERE length(v) > 3 GROUP BY 1
""")
def accepted_values_full(spark, d):
    """Accepted values judged on all values of a column, thousands of them, not on the frequent ones."""
    words = t.words(spark, d).select("source", "word")
    accepted = words.where(F.length("word") <= 3).select("word").distinct()
    listed = accepted.agg(F.collect_set("word").alias("values"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CONTRACT_CLAUSE.fields if f.name not in ("table_name", "column_name", "clause", "values", "status")]
    clause = listed.select(F.lit("RAW.WORDS").alias("table_name"), F.lit("word").alias("column_name"), F.lit("accepted_values").alias("clause"),
                           F.lit("approved").alias("status"), "values", *none)
    p, values = P.profile_tables({"RAW.WORDS": (words, "source")}, "shop", clause)
    found = D.contract_violations(stage(p, "profile"), clause, values)
    return found.select("batch_id", F.col("magnitude").cast("long").alias("kinds"), F.col("details")["rows"].cast("long").alias("rows"))


@query("semantic_full_round", f"""
WITH {t.SQL_WORDS}, dv AS (SELECT lang AS b, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS v, count(*) AS n FROM w GROUP BY 1, 2)
SELECT b AS batch_id, lower(v) AS reference, CAST(sum(n) AS DOUBLE) AS magnitude FROM dv GROUP BY 1, 2 HAVING count(*) > 1
""")
def semantic_full_round(spark, d):
    """Spellings of all values of a column as a round judges them."""
    words = t.words(spark, d).select("lang", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"))
    p, values = P.profile_tables({"RAW.WORDS": (words, "lang")}, "shop")
    return D.semantic_full(values, p).select("batch_id", "reference", "magnitude")


@query("profile_zeros_and_undated", """
WITH r AS (SELECT CASE WHEN l_linenumber > 2 THEN l_returnflag END AS b,
    CASE WHEN l_tax = 0 AND l_orderkey % 2 = 0 THEN CAST('-0.0' AS DOUBLE) ELSE l_tax END AS v FROM lineitem)
SELECT coalesce(b, '(none)') AS batch_id, count(*) AS row_count, count(DISTINCT v + 0.0) AS distinct_values, count(*) FILTER (WHERE v = 0) AS zeros FROM r GROUP BY 1
""")
def profile_zeros_and_undated(spark, d):
    """Both zeros are one value; rows that carry no batch form one of their own."""
    negative = (F.col("l_tax") == 0) & (F.col("l_orderkey") % 2 == 0)
    rows = t.read(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("b"), F.when(negative, F.lit(-0.0)).otherwise(F.col("l_tax")).alias("v"))
    p, values = P.profile_tables({"T": (rows, "b")}, "", spark.createDataFrame([("T", "v")], "table_name string, column_name string"))
    zeros = values.where("value = '0.0' AND column_name = 'v'").select("batch_id", F.col("n").alias("zeros"))
    return p.where("column_name = 'v'").join(zeros, "batch_id").select("batch_id", "row_count", F.col("distinct").alias("distinct_values"), "zeros")


@query("quarantine_to_marts", """
WITH kept AS (SELECT * FROM lineitem WHERE l_quantity <= 45),
paid AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS amount FROM kept GROUP BY 1)
SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS sales_date, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(amount) AS DOUBLE) AS revenue
FROM orders LEFT JOIN paid ON o_orderkey = k WHERE o_orderstatus <> 'P' GROUP BY 1
""")
def quarantine_to_marts(spark, d):
    """Isolated rows stay in raw and silver tables, marked, and are in no mart."""
    payments = K.isolate(t.raw_payments(spark, d), F.col("payment_installments").cast("double") > 45)
    orders = K.isolate(t.raw_orders(spark, d), F.col("order_status") == "P")
    mart = gold.build_mart("fct_daily_sales", {"orders": silver.orders(orders), "order_payments": silver.order_payments(payments)})
    return mart.select(F.col("sales_date").cast("string").alias("sales_date"), "n_orders", F.col("revenue").cast("double").alias("revenue"))


@query("stored_mart", f"""
WITH {SQL_PAID} SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS sales_date, count(*) AS n_orders, CAST(sum(amount) AS DOUBLE) / count(*) AS avg_order_value
FROM orders JOIN paid ON o_orderkey = k GROUP BY 1
""")
def stored_mart(spark, d):
    """A mart is rebuilt as a whole: written twice, the second time from all orders."""
    path = scratch_path(spark, "mart")
    orders, paid = silver.orders(t.raw_orders(spark, d)), silver.order_payments(t.raw_payments(spark, d))
    for some in (orders.where("order_status = 'F'"), orders):
        gold.write_mart(gold.build_mart("fct_avg_order_value", {"orders": some, "order_payments": paid}), path)
    return spark.read.parquet(path).select(F.col("sales_date").cast("string").alias("sales_date"), "n_orders", "avg_order_value")


@query("table_schemas", """
SELECT upper(table_name) AS table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS INTEGER) AS position
FROM (SELECT DISTINCT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('orders', 'customer', 'events'))
""")
def table_schemas(spark, d):
    """Columns of the tables that a database holds, found by listing it."""
    spark.sql("CREATE DATABASE IF NOT EXISTS limpid_listed")
    out = None
    try:
        for name in ("orders", "customer", "events"):
            spark.sql(f"CREATE TABLE IF NOT EXISTS limpid_listed.{name} USING parquet LOCATION '{d}/{name}.parquet'")
        for r in catalog.present_tables(spark, ["limpid_listed"]).collect():
            found = catalog.get_schema(spark, r["table_name"].lower())
            one = found.select(F.lit(r["table_name"].split(".")[1]).alias("table_name"), "column_name", "position")
            out = one if out is None else out.unionByName(one)
        return stage(out, "schemas")
    finally:
        spark.sql("DROP DATABASE limpid_listed CASCADE")


@query("profile_one_batch", f"""
WITH {t.SQL_EVENTS} SELECT column_name, count(*) AS row_count, count(DISTINCT v) AS distinct_values FROM (
  SELECT unnest(['event_id', 'event_type', 'value']) AS column_name, unnest([CAST(event_id AS VARCHAR), event_type, CAST(value AS VARCHAR)]) AS v FROM ev WHERE b = '{DAY}') GROUP BY 1
""")
def profile_one_batch(spark, d):
    """One batch of a table, by its column and id."""
    p = P.profile_table(t.events_by_day(spark, d).select(t.BATCH, "event_id", "event_type", "value"), "RAW.EVENTS", "shop", t.BATCH, DAY)
    return p.where(F.col("column_name") != t.BATCH).select("column_name", "row_count", F.col("distinct").alias("distinct_values"))


@query("shortened_texts", """
SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END AS shown FROM documents
""")
def shortened_texts(spark, d):
    return t.read(spark, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("shown"))


@query("run_sentences", f"""
WITH {SQL_DAMAGED} SELECT 'shop|RAW.EVENTS|' || b AS run, 'completude on event_type — ' || touched AS said FROM viol WHERE type = 'nulls_interdits'
""")
def run_sentences(spark, d):
    """Runs by name, and their missing values in words."""
    found = signed_anomalies(spark, d).where("type = 'nulls_interdits'")
    return found.select(text.run_id(F.lit("shop"), F.col("table_name"), F.col("batch_id")).alias("run"), D.sentence().alias("said"))


@query("impact_changes", f"""
WITH {SQL_DAMAGED} SELECT b AS batch_id, c AS column_name, type, CAST(CASE type WHEN 'nulls_interdits' THEN touched END AS DOUBLE) AS change,
  CAST(NULL AS DOUBLE) AS relative_change FROM viol WHERE type IN ('nulls_interdits', 'hors_bornes')
UNION ALL SELECT '{DAY}', 'v', 'derive', 3.0 - count(*), (3.0 - count(*)) / count(*) FROM ev
""")
def impact_changes(spark, d):
    """What changed against the reference, in numbers and as a share of it."""
    found = signed_anomalies(spark, d).where(F.col("type").isin("nulls_interdits", "hors_bornes")).drop("signature")
    moved = t.events_by_day(spark, d).agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        F.lit("RAW.EVENTS").alias("table_name"), F.lit(DAY).alias("batch_id"), F.col("n"))
    made = D.anomaly(moved, "statistical", "derive", "exactitude", column=F.lit("v"), observed_num=F.lit(3.0), reference_num=F.col("n"))
    return impact.per_anomaly(found.unionByName(made), damaged_profile(spark, d)).select(
        "batch_id", "column_name", "type", "change", "relative_change")


@query("incidents_appended", f"""
WITH {SQL_SIGNED}, r AS (SELECT DISTINCT b FROM ev), i AS (SELECT r.b, count(sg.b) AS n FROM r LEFT JOIN sg USING (b) GROUP BY 1)
SELECT b AS batch_id, CAST(n AS INTEGER) AS signatures FROM i
""")
def incidents_appended(spark, d):
    """Incidents stored in two appends and read back."""
    path = scratch_path(spark, "incidents")
    found = incidents(spark, d, signed_anomalies(spark, d))
    for part in (F.col("batch_id") < DAY, F.col("batch_id") >= DAY):
        history.append_incidents(found.where(part), path)
    stored = spark.read.schema(schemas.INCIDENT).parquet(path)
    return history.journal(stored, "shop").select("batch_id", F.size("signatures").alias("signatures"))


@query("discovered_contracts", f"""
WITH c AS ({_sql_clauses()}) SELECT table_name, column_name, clause, lo, hi, "values", 'approved' AS status FROM c WHERE table_name = 'RAW.CUSTOMERS'
UNION ALL SELECT table_name, column_name, clause, lo, hi, "values", 'proposed' FROM c WHERE table_name = 'RAW.ORDERS'
""")
def discovered_contracts(spark, d):
    """Contracts of all declared tables that can be read; one is signed, recorded and read back."""
    registry = catalog.registry(spark, "shop", [{"name": n, "layer": "bronze"} for n in ("RAW.ORDERS", "RAW.CUSTOMERS", "RAW.MISSING")])
    source = {"RAW.ORDERS": "orders", "RAW.CUSTOMERS": "customer"}
    clauses, warnings, failures = pipeline.discover("shop", registry, lambda name: t.read(spark, d, source[name]))
    if len(failures) != 1:
        raise AssertionError(failures)
    clauses = stage(clauses, "clauses")
    signed = C.approve(clauses, warnings, "shop", "RAW.CUSTOMERS", "ana", accept_warnings=True)
    return C.record(clauses.where("table_name = 'RAW.ORDERS'"), signed.where("table_name = 'RAW.CUSTOMERS'")).where(F.col("clause") != "role").select(
        "table_name", "column_name", "clause", "lo", "hi", F.array_join("values", ",").alias("values"), "status")
