"""The five reporting views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import money
from tallyhouse.functions import status as st
from tallyhouse.operators.stats import PRODUCT, sold_items


def order_summary(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per order: number of items, quantity and price range; without items the count is 0, the rest null."""
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(
        F.count("*").alias("_n"),
        F.sum("quantity").alias("total_quantity"),
        money.mean(F.col("unit_price")).alias("avg_item_price"),
        F.max("unit_price").alias("max_item_price"),
        F.min("unit_price").alias("min_item_price"),
    )
    return orders.join(per_order, "id", "left").select(
        "id", "order_number", "user_id", "status", "total_amount", "created_at", "updated_at",
        F.coalesce("_n", F.lit(0)).alias("item_count"),
        "total_quantity", "avg_item_price", "max_item_price", "min_item_price",
    )


def sales_analytics(orders: DataFrame, items: DataFrame, dedupe_orders: bool = False) -> DataFrame:
    """Sold orders per state and day.

    As the view is defined, an order counts once per item line in the order columns, and orders
    without items do not count; ``dedupe_orders`` counts each order once.
    """
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(
        F.count("*").alias("lines"), F.sum("quantity").alias("quantity")
    )
    sold = (
        orders.where(st.is_sold(F.col("status")))
        .select("id", "status", "user_id", "total_amount", F.date_trunc("day", "created_at").alias("order_date"))
        .join(per_order, "id")
    )
    weight = F.lit(1) if dedupe_orders else F.col("lines")
    revenue = F.sum(F.col("total_amount") * weight)
    counted = F.sum(weight).cast("bigint")
    return sold.groupBy("status", "order_date").agg(
        counted.alias("order_count"),
        revenue.alias("total_revenue"),
        (revenue.cast("double") / counted.cast("double")).alias("avg_order_value"),
        F.sum("quantity").alias("total_items_sold"),
        F.count_distinct("user_id").alias("unique_customers"),
    )


def product_sales_performance(items: DataFrame, orders: DataFrame) -> DataFrame:
    return sold_items(items, orders).groupBy(*PRODUCT).agg(
        F.count_distinct("order_id").alias("order_count"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("total_price").alias("total_revenue"),
        money.mean(F.col("unit_price")).alias("avg_selling_price"),
        F.max("unit_price").alias("max_selling_price"),
        F.min("unit_price").alias("min_selling_price"),
    )


def customer_order_history(orders: DataFrame) -> DataFrame:
    """Amounts cover orders of every state, cancelled ones too."""
    amount = F.col("total_amount")
    return orders.groupBy("user_id").agg(
        F.count("*").alias("total_orders"),
        F.sum(amount).alias("total_spent"),
        money.mean(amount).alias("avg_order_value"),
        F.max(amount).alias("max_order_value"),
        F.min("created_at").alias("first_order_date"),
        F.max("created_at").alias("last_order_date"),
        F.count_if(F.col("status") == "DELIVERED").alias("completed_orders"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled_orders"),
    )


def order_status_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(
        F.count("*").alias("order_count"),
        F.sum("total_amount").alias("total_value"),
        money.mean(F.col("total_amount")).alias("avg_value"),
        F.min("created_at").alias("earliest_order"),
        F.max("created_at").alias("latest_order"),
    )
