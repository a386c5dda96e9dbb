"""The test tables, and the raw text tables of the sales domain made from them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from limpid.session import stage

BATCH = "_batch_id"

_SHARED: dict[tuple, DataFrame] = {}


def shared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table once per session; later queries read it.

    Stands for what earlier jobs of a day leave behind (a damaged delivery, its
    profile, a signed contract). ``forget`` makes the next use build it again.
    """
    @functools.wraps(fn)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, fn.__module__, fn.__name__, sf_dir)
        if key not in _SHARED:
            _SHARED[key] = stage(fn(spark, sf_dir), fn.__name__.replace("_", "-"))
        return _SHARED[key]

    return build


def forget() -> None:
    _SHARED.clear()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered when the last line shipped; due sixty days after the order."""
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped")
    )
    return read(spark, sf_dir, "orders").join(
        shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).select(
        _text("o_orderkey").alias("order_id"), _text("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        _text("o_orderdate").alias("order_purchase_timestamp"),
        F.lit(None).cast("string").alias("order_approved_at"),
        F.lit(None).cast("string").alias("order_delivered_carrier_date"),
        _text("shipped").alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.expr("interval 60 days")).cast("string").alias("order_estimated_delivery_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias(BATCH),
    )


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        _text("l_orderkey").alias("order_id"), _text("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"), _text("l_quantity").alias("payment_installments"),
        _text("l_extendedprice").alias("payment_value"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias(BATCH),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        _text("l_orderkey").alias("order_id"), _text("l_linenumber").alias("order_item_id"),
        _text("l_partkey").alias("product_id"), _text("l_suppkey").alias("seller_id"),
        _text("l_shipdate").alias("shipping_limit_date"), _text("l_extendedprice").alias("price"),
        _text("l_tax").alias("freight_value"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias(BATCH),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        _text("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
        _text("c_nationkey").alias("customer_zip_code_prefix"), F.col("n_name").alias("customer_city"),
        F.lower("c_mktsegment").alias("customer_state"), F.lit("2018-03-01").alias(BATCH),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        _text("p_partkey").alias("product_id"), F.lower("p_type").alias("product_category_name"),
        F.length("p_name").cast("string").alias("product_name_lenght"),
        F.length("p_brand").cast("string").alias("product_description_lenght"),
        _text("p_size").alias("product_photos_qty"), _text("p_retailprice").alias("product_weight_g"),
        F.lit("12.345").alias("product_length_cm"), F.lit("n/a").alias("product_height_cm"),
        F.lit("1e2").alias("product_width_cm"), F.lit("2018-03-01").alias(BATCH),
    )


def raw_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.concat(F.lit("0"), F.right("c_name", F.lit(3))).alias("geolocation_zip_code_prefix"),
        _text("c_acctbal").alias("geolocation_lat"), _text("c_nationkey").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"), F.lower("c_mktsegment").alias("geolocation_state"),
        F.lit("2018-03-01").alias(BATCH),
    )


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn(BATCH, F.date_format("ts", "yyyy-MM-dd"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, split at blanks."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.explode(F.split("text", "[ \t\n\r]+")).alias("word")
    ).where(F.col("word") != "")


# DuckDB counterparts
SQL_EVENTS = "ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS b FROM events)"
SQL_WORDS = (
    "w AS (SELECT * FROM (SELECT doc_id, lang, source, "
    "unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM documents) WHERE word <> '')"
)
SQL_FOLD = "lower(trim(regexp_replace(strip_accents({0}), '\\s+', ' ', 'g')))"


def sql_fold(expression: str) -> str:
    return SQL_FOLD.format(expression)
