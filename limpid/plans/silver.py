"""Silver: the raw text tables typed. Values that do not read become NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.functions.text import integer_or_null, money_or_null
from limpid.operators.corrections import FLAG

TECHNICAL = ("_batch_id", "_ingested_at")


def _ts(name: str) -> Column:
    return F.col(name).try_cast("timestamp_ntz")


def _with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Columns a drifted source no longer delivers read as NULL text."""
    for n in names:
        if n.lower() not in (c.lower() for c in df.columns):
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def _technical(raw: DataFrame) -> list[str]:
    """Technical columns, and the mark of quarantined rows where a correction has set it."""
    return [*TECHNICAL, *(c for c in raw.columns if c == FLAG)]


def orders(raw: DataFrame) -> DataFrame:
    raw = _with_columns(raw, *TECHNICAL)
    return raw.select(
        "order_id", "customer_id", "order_status",
        _ts("order_purchase_timestamp").alias("order_purchase_ts"),
        F.to_date(_ts("order_purchase_timestamp")).alias("order_purchase_date"),
        _ts("order_approved_at").alias("order_approved_ts"),
        _ts("order_delivered_carrier_date").alias("order_delivered_carrier_ts"),
        _ts("order_delivered_customer_date").alias("order_delivered_customer_ts"),
        _ts("order_estimated_delivery_date").alias("order_estimated_delivery_ts"),
        *_technical(raw),
    )


def order_items(raw: DataFrame) -> DataFrame:
    """No deduplication: copies of a line must stay visible to the checks."""
    raw = _with_columns(raw, *TECHNICAL)
    return raw.select(
        F.concat("order_id", F.lit("-"), "order_item_id").alias("order_item_sk"),
        "order_id", integer_or_null(F.col("order_item_id")).alias("order_item_id"),
        "product_id", "seller_id", _ts("shipping_limit_date").alias("shipping_limit_ts"),
        money_or_null(F.col("price")).alias("price"),
        money_or_null(F.col("freight_value")).alias("freight_value"),
        *_technical(raw),
    )


def order_payments(raw: DataFrame) -> DataFrame:
    """A source that renamed ``payment_value`` gives NULL amounts, on purpose."""
    raw = _with_columns(raw, "payment_value", *TECHNICAL)
    return raw.select(
        "order_id", integer_or_null(F.col("payment_sequential")).alias("payment_sequential"),
        "payment_type",
        integer_or_null(F.col("payment_installments")).alias("payment_installments"),
        money_or_null(F.col("payment_value")).alias("payment_amount"),
        *_technical(raw),
    )


def customers(raw: DataFrame) -> DataFrame:
    raw = _with_columns(raw, *TECHNICAL)
    return raw.select(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
        F.upper("customer_state").alias("customer_state"), *_technical(raw),
    )


def geolocation(raw: DataFrame) -> DataFrame:
    raw = _with_columns(raw, *TECHNICAL)
    return raw.select(
        "geolocation_zip_code_prefix",
        F.col("geolocation_lat").try_cast("double").alias("geolocation_lat"),
        F.col("geolocation_lng").try_cast("double").alias("geolocation_lng"),
        "geolocation_city", F.upper("geolocation_state").alias("geolocation_state"), *_technical(raw),
    )


def products(raw: DataFrame) -> DataFrame:
    """The source misspells two of its names; the typed table does not."""
    raw = _with_columns(raw, *TECHNICAL)
    return raw.select(
        "product_id", "product_category_name",
        integer_or_null(F.col("product_name_lenght")).alias("product_name_length"),
        integer_or_null(F.col("product_description_lenght")).alias("product_description_length"),
        integer_or_null(F.col("product_photos_qty")).alias("product_photos_qty"),
        *[
            money_or_null(F.col(c)).alias(c)
            for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
        ],
        *_technical(raw),
    )
