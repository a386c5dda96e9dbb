"""Silver tables, gold marts and the joins and orders they rest on."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from limpid.catalogue import query
from limpid.catalogue import tables as t
from limpid.operators import corrupt
from limpid.plans import gold, silver
from limpid.sources.batches import daily_slices

SQL_PAID = (
    "paid AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS amount "
    "FROM lineitem GROUP BY 1)"
)


def _orders(spark, d):
    return silver.orders(t.raw_orders(spark, d))


def _payments(spark, d):
    return silver.order_payments(t.raw_payments(spark, d))


def _customers(spark, d):
    return silver.customers(t.raw_customers(spark, d))


@query("silver_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       o_orderstatus AS order_status, CAST(o_orderdate AS VARCHAR) AS order_purchase_ts,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_purchase_date,
       CAST(NULL AS VARCHAR) AS order_approved_ts,
       CAST(s.shipped AS VARCHAR) AS order_delivered_customer_ts,
       CAST(o_orderdate + INTERVAL 60 DAY AS VARCHAR) AS order_estimated_delivery_ts
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) s
  ON o_orderkey = l_orderkey
""")
def silver_orders(spark, d):
    o = _orders(spark, d)
    return o.select(
        "order_id", "customer_id", "order_status",
        *[F.col(c).cast("string").alias(c) for c in (
            "order_purchase_ts", "order_purchase_date", "order_approved_ts",
            "order_delivered_customer_ts", "order_estimated_delivery_ts")],
    )


@query("silver_order_items", """
SELECT l_orderkey || '-' || l_linenumber AS order_item_sk, l_linenumber AS order_item_id,
       CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_shipdate AS VARCHAR) AS shipping_limit_ts,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
       CAST(CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS freight_value
FROM lineitem
""")
def silver_order_items(spark, d):
    i = silver.order_items(t.raw_items(spark, d))
    return i.select(
        "order_item_sk", "order_item_id", "product_id",
        F.col("shipping_limit_ts").cast("string").alias("shipping_limit_ts"),
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
    )


@query("silver_payments_after_rename", """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS payment_sequential,
       l_returnflag AS payment_type, CAST(l_quantity AS INTEGER) AS payment_installments,
       CASE WHEN l_shipdate < TIMESTAMP '1998-01-01'
            THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS payment_amount
FROM lineitem
""")
def silver_payments_after_rename(spark, d):
    """From 1998 on the source calls the amount differently: it reads as NULL."""
    raw = t.raw_payments(spark, d)
    late = F.col(t.BATCH) >= "1998-01-01"
    drifted = raw.where(~late).unionByName(
        corrupt.rename_column(raw.where(late), "payment_value", "amount"), allowMissingColumns=True
    )
    p = silver.order_payments(drifted)
    return p.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments",
        F.col("payment_amount").cast("double").alias("payment_amount"),
    )


@query("silver_customers", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id,
       n_name AS customer_city, upper(c_mktsegment) AS customer_state
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def silver_customers(spark, d):
    return _customers(spark, d).select(
        "customer_id", "customer_unique_id", "customer_city", "customer_state"
    )


@query("silver_products", """
SELECT CAST(p_partkey AS VARCHAR) AS product_id, lower(p_type) AS product_category_name,
       CAST(length(p_name) AS INTEGER) AS product_name_length,
       CAST(length(p_brand) AS INTEGER) AS product_description_length,
       p_size AS product_photos_qty,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS product_weight_g,
       CAST(12.35 AS DOUBLE) AS product_length_cm, CAST(NULL AS DOUBLE) AS product_height_cm,
       CAST(100 AS DOUBLE) AS product_width_cm
FROM part
""")
def silver_products(spark, d):
    p = silver.products(t.raw_products(spark, d)).drop(*silver.TECHNICAL)
    money = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    return p.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in p.columns])


@query("silver_geolocation", """
SELECT '0' || right(c_name, 3) AS geolocation_zip_code_prefix, c_acctbal AS geolocation_lat,
       CAST(c_nationkey AS DOUBLE) AS geolocation_lng, n_name AS geolocation_city,
       upper(c_mktsegment) AS geolocation_state
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def silver_geolocation(spark, d):
    return silver.geolocation(t.raw_geolocation(spark, d)).drop(*silver.TECHNICAL)


@query("daily_sales", f"""
WITH {SQL_PAID}
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sales_date,
       count(DISTINCT o_orderkey) AS n_orders, CAST(sum(amount) AS DOUBLE) AS revenue
FROM orders LEFT JOIN paid ON o_orderkey = k
WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def daily_sales(spark, d):
    m = gold.daily_sales(_orders(spark, d), _payments(spark, d))
    return m.select(
        F.col("sales_date").cast("string").alias("sales_date"), "n_orders",
        F.col("revenue").cast("double").alias("revenue"),
    )


@query("avg_order_value", f"""
WITH {SQL_PAID}
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sales_date, count(*) AS n_orders,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_order_value
FROM orders JOIN paid ON o_orderkey = k WHERE o_orderdate IS NOT NULL GROUP BY 1
""")
def avg_order_value(spark, d):
    m = gold.avg_order_value(_orders(spark, d), _payments(spark, d))
    return m.withColumn("sales_date", F.col("sales_date").cast("string"))


@query("sales_by_city_state", f"""
WITH {SQL_PAID}
SELECT upper(c_mktsegment) AS customer_state, n_name AS customer_city,
       count(DISTINCT o_orderkey) AS n_orders, CAST(sum(amount) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN paid ON o_orderkey = k
GROUP BY 1, 2 ORDER BY revenue DESC NULLS LAST
""")
def sales_by_city_state(spark, d):
    m = gold.sales_by_city_state(_orders(spark, d), _customers(spark, d), _payments(spark, d))
    return m.withColumn("revenue", F.col("revenue").cast("double"))


@query("delivery_delays", """
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_purchase_date,
       CAST(date_diff('day', o_orderdate, shipped) AS INTEGER) AS delivery_days,
       CAST(date_diff('day', o_orderdate + INTERVAL 60 DAY, shipped) AS INTEGER) AS delay_vs_estimate
FROM orders JOIN s ON o_orderkey = l_orderkey WHERE shipped IS NOT NULL AND o_orderdate IS NOT NULL
""")
def delivery_delays(spark, d):
    m = gold.delivery_delays(_orders(spark, d))
    return m.withColumn("order_purchase_date", F.col("order_purchase_date").cast("string"))


@query("geolocation_by_city", """
SELECT upper(c_mktsegment) AS geolocation_state, n_name AS geolocation_city,
       count(*) AS n_points, count(DISTINCT right(c_name, 3)) AS n_zip_prefixes
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY n_points DESC
""")
def geolocation_by_city(spark, d):
    return gold.geolocation_by_city(silver.geolocation(t.raw_geolocation(spark, d)))


@query("split_word_rows", f"""
WITH {t.SQL_WORDS}, mart AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, {t.sql_fold('word')} AS folded, count(*) AS split_rows, max(n) AS largest_part,
       CAST(sum(n) AS BIGINT) AS whole, CAST(sum(n) - max(n) AS BIGINT) AS recovered
FROM mart GROUP BY 1, 2 HAVING count(*) > 1
""")
def split_word_rows(spark, d):
    mart = t.words(spark, d).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return gold.split_rows(mart, "word", "n", ["lang"])


@query("daily_slices", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS batch_id, count(*) AS lines,
       count(DISTINCT l_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def daily_slice_counts(spark, d):
    parts = daily_slices(
        t.read(spark, d, "orders"), F.col("o_orderdate"), "o_orderkey",
        {"lineitem": (t.read(spark, d, "lineitem"), "l_orderkey")},
    )
    return parts["lineitem"].groupBy(F.col(t.BATCH).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders")
    )


@query("latest_order_per_customer", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1
""")
def latest_order_per_customer(spark, d):
    """Latest version per key as an aggregate: no key is sorted in one task."""
    o = t.read(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return last.select(
        "o_custkey", "m.o_orderkey", F.col("m.o_orderdate").cast("string").alias("o_orderdate")
    )


@query("top_cities_by_revenue", f"""
WITH {SQL_PAID}, m AS (
  SELECT upper(c_mktsegment) AS customer_state, n_name AS customer_city, sum(amount) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN paid ON o_orderkey = k GROUP BY 1, 2)
SELECT customer_state, customer_city, CAST(revenue AS DOUBLE) AS revenue,
       CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_state ORDER BY revenue DESC NULLS LAST, customer_city) AS rn
  FROM m) WHERE rn <= 3
""")
def top_cities_by_revenue(spark, d):
    m = gold.sales_by_city_state(_orders(spark, d), _customers(spark, d), _payments(spark, d))
    order = Window.partitionBy("customer_state").orderBy(F.desc_nulls_last("revenue"), "customer_city")
    return m.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select(
        "customer_state", "customer_city", F.col("revenue").cast("double").alias("revenue"), "rank"
    )
