"""Stored JSON addresses as columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import address

COLUMNS = ("shipping_address", "billing_address")


def parse_addresses(orders: DataFrame) -> DataFrame:
    """Both JSON columns as structs, with ``address_error`` where a text cannot be read."""
    broken = F.greatest(*(address.is_broken(F.col(name)).cast("int") for name in COLUMNS)) == 1
    parsed = {name: address.parse(F.col(name)) for name in COLUMNS}
    return orders.withColumn("address_error", broken).withColumns(parsed)


def render_addresses(df: DataFrame) -> DataFrame:
    """Both struct columns as JSON text."""
    return df.withColumns({name: address.render(F.col(name)) for name in COLUMNS})


def address_rollup(orders: DataFrame, which: str = "shipping_address", field: str = "country") -> DataFrame:
    """Orders and their value per country or state of the stored address."""
    return (
        orders.select(F.get_json_object(which, f"$.{field}").alias(field), "total_amount")
        .groupBy(field)
        .agg(F.count("*").alias("order_count"), F.sum("total_amount").alias("total_amount"))
    )
