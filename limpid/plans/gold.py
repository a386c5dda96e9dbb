"""Gold: the business marts over the silver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.functions.text import fold
from limpid.operators.corrections import FLAG


def _counted(df: DataFrame) -> DataFrame:
    """Rows that a mart may count: all but the quarantined ones, which stay in the tables below."""
    return df.where(~F.coalesce(F.col(FLAG), F.lit(False))) if FLAG in df.columns else df


def _paid_per_order(payments: DataFrame) -> DataFrame:
    return _counted(payments).groupBy("order_id").agg(F.sum("payment_amount").alias("order_amount"))


def daily_sales(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders and revenue per purchase date; unpaid orders count as orders."""
    return (
        _counted(orders).where(F.col("order_purchase_date").isNotNull())
        .select("order_id", "order_purchase_date")
        .join(_paid_per_order(payments), "order_id", "left")
        .groupBy(F.col("order_purchase_date").alias("sales_date"))
        .agg(F.count_distinct("order_id").alias("n_orders"), F.sum("order_amount").alias("revenue"))
        .orderBy("sales_date")
    )


def avg_order_value(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Mean paid amount per purchase date, paid orders only."""
    paid = _counted(orders).where(F.col("order_purchase_date").isNotNull()).join(
        _paid_per_order(payments), "order_id"
    )
    mean = F.sum("order_amount").cast("double") / F.count("order_amount")
    return (
        paid.groupBy(F.col("order_purchase_date").alias("sales_date"))
        .agg(F.count(F.lit(1)).alias("n_orders"), mean.alias("avg_order_value"))
        .orderBy("sales_date")
    )


def sales_by_city_state(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    return (
        _counted(orders).select("order_id", "customer_id")
        .join(_counted(customers).select("customer_id", "customer_city", "customer_state"), "customer_id")
        .join(_paid_per_order(payments), "order_id", "left")
        .groupBy("customer_state", "customer_city")
        .agg(F.count_distinct("order_id").alias("n_orders"), F.sum("order_amount").alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"))
    )


def delivery_delays(orders: DataFrame) -> DataFrame:
    """Day boundaries from purchase, and from the estimate, to delivery."""
    delivered = F.col("order_delivered_customer_ts")
    return _counted(orders).where(delivered.isNotNull() & F.col("order_purchase_ts").isNotNull()).select(
        "order_id", "order_purchase_date",
        F.datediff(delivered, "order_purchase_ts").alias("delivery_days"),
        F.datediff(delivered, "order_estimated_delivery_ts").alias("delay_vs_estimate"),
    )


def geolocation_by_city(geolocation: DataFrame) -> DataFrame:
    return (
        _counted(geolocation).groupBy("geolocation_state", "geolocation_city")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.count_distinct("geolocation_zip_code_prefix").alias("n_zip_prefixes"),
        )
        .orderBy(F.desc("n_points"))
    )


def split_rows(
    mart: DataFrame, name: str, mass: str, within: list[str] | None = None
) -> DataFrame:
    """What spelling variants do to an aggregate, per folded name.

    How many rows of the mart one name is split into, the mass of the largest
    of them, and the mass recovered when they are put together.
    """
    keys = [*(within or []), "folded"]
    return (
        mart.withColumn("folded", fold(F.col(name)))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("split_rows"),
            F.max(mass).alias("largest_part"),
            F.sum(mass).alias("whole"),
        )
        .where(F.col("split_rows") > 1)
        .withColumn("recovered", F.col("whole") - F.col("largest_part"))
    )


def variant_rows(mart: DataFrame, name: str, canonical: str, variants: list[str]) -> DataFrame:
    """Rows of a mart that carry one name or any listed variant of it."""
    c: Column = F.col(name)
    return mart.where(c.isin([canonical, *variants]) | (fold(c) == fold(F.lit(canonical))))


def write_mart(mart: DataFrame, path: str) -> None:
    """Marts are rebuilt as a whole."""
    mart.write.mode("overwrite").parquet(path)


MARTS = {
    "fct_daily_sales": (daily_sales, ("orders", "order_payments")),
    "fct_avg_order_value": (avg_order_value, ("orders", "order_payments")),
    "fct_sales_by_city_state": (sales_by_city_state, ("orders", "customers", "order_payments")),
    "fct_delivery_delays": (delivery_delays, ("orders",)),
    "fct_geolocation_by_city": (geolocation_by_city, ("geolocation",)),
}


def build_mart(name: str, silver: dict[str, DataFrame]) -> DataFrame:
    make, needs = MARTS[name]
    return make(*[silver[n] for n in needs])
