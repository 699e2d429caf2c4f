"""Orders with their items, one row per item or as a nested list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import address
from tallyhouse.operators.skew import hot_keys

ITEM_FIELDS = ("id", "product_id", "product_name", "product_sku", "quantity", "unit_price", "total_price")


def order_lines(
    orders: DataFrame, items: DataFrame, keys: DataFrame | None = None, by: str = "id"
) -> DataFrame:
    """Orders with the columns of one item a row (``item_id`` and so on, null for an order without items),
    for all orders or for a table of keys.

    Items are joined as an inner join, whose hot orders Spark can split, and the orders without any follow.
    """
    if keys is not None:
        orders = orders.join(keys.select(by).distinct(), by, "left_semi")
    owned = items.where(F.col("order_id").isNotNull())
    lines = owned.select("order_id", *(F.col(field).alias(f"item_{field}") for field in ITEM_FIELDS))
    listed = orders.join(lines, F.col("id") == F.col("order_id")).drop("order_id")
    bare = orders.join(owned.select(F.col("order_id").alias("id")).distinct(), "id", "left_anti")
    return listed.unionByName(bare, allowMissingColumns=True)


def user_order_lines(orders: DataFrame, items: DataFrame, user: object | None = None) -> DataFrame:
    """A user's orders, one row per item, newest first; without ``user`` every user's, grouped by user."""
    if user is not None:
        orders = orders.where(F.col("user_id") == user)
    order = newest_first("item_id") if user is not None else [F.asc("user_id"), *newest_first("item_id")]
    return order_lines(orders, items).orderBy(*order)


def nest_items(items: DataFrame, items_per_row: int | None = None, in_place: bool = False) -> DataFrame:
    """(order_id, part, items): one row per order, whatever its size, with ``part`` 0.

    A list is held in memory as one value. With ``items_per_row`` an order above that many items is spread by
    the hash of the item id over as many parts as keep the lists near that length; ``order_lines`` has no
    lists at all. Nothing is cut but items without an order id. Rows are shuffled as they are: a list
    gathered ahead of the shuffle would be no smaller.

    ``in_place`` is for items bucketed on the order id (``save_bucketed``): they are listed where they lie, bucket by
    bucket in the order of the bucket's files, without any shuffle. One order must fit in memory either way.
    """
    items = items.where(F.col("order_id").isNotNull())
    long_orders = hot_keys(items, "order_id", items_per_row) if items_per_row is not None else None
    listed = F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items")
    if long_orders is None:
        nested = (items if in_place else items.repartition("order_id")).groupBy("order_id").agg(listed)
        return nested.select("order_id", F.lit(0).alias("part"), "items")
    parts = long_orders.select("order_id", F.ceil(F.col("rows") / items_per_row).alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0)).cast("int")
    parted = items.join(parts, "order_id", "left").withColumn("part", part)
    return parted.repartition("order_id", "part").groupBy("order_id", "part").agg(listed)


def orders_with_items(
    orders: DataFrame, items: DataFrame, keys: DataFrame | None = None, by: str = "id",
    items_per_row: int | None = None, in_place: bool = False,
) -> DataFrame:
    """Orders with their item list (empty without items), for all orders or for a table of keys."""
    if keys is not None:
        orders = orders.join(keys.select(by).distinct(), by, "left_semi")
        items = items.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    nested = nest_items(items, items_per_row, in_place).withColumnRenamed("order_id", "id")
    empty = F.array().cast(nested.schema["items"].dataType)
    return orders.join(nested, "id", "left").withColumns(
        {"part": F.coalesce("part", F.lit(0)), "items": F.coalesce("items", empty)}
    )


def newest_first(*extra: str) -> list[Column]:
    return [F.desc("created_at"), F.asc("id"), *map(F.asc, extra)]


def order_response(
    orders: DataFrame, items: DataFrame, items_per_row: int | None = None, in_place: bool = False
) -> DataFrame:
    """The full order, one row: parsed addresses, nested items, number of lines and summed quantity.

    With ``in_place`` items bucketed on the order id are not shuffled, nor are orders bucketed alike on their id.

    With ``items_per_row`` a longer list is spread over several parts; both totals cover the whole order.
    """
    nested = orders_with_items(orders, items, items_per_row=items_per_row, in_place=in_place)
    if items_per_row is None:
        whole = nested.withColumns({
            "total_items": F.size("items").cast("bigint"),
            "total_quantity": F.aggregate(
                "items", F.lit(0).cast("bigint"), lambda n, item: n + F.coalesce(item["quantity"], F.lit(0))
            ),
        })
    else:
        totals = items.where(F.col("order_id").isNotNull()).groupBy(F.col("order_id").alias("id")).agg(
            F.count("*").alias("total_items"), F.sum("quantity").alias("total_quantity")
        )
        whole = nested.join(totals, "id", "left")
    return whole.select(
        "id", "order_number", "user_id", "status", "total_amount",
        address.parse(F.col("shipping_address")).alias("shipping_address"),
        address.parse(F.col("billing_address")).alias("billing_address"),
        "part", "items",
        F.coalesce("total_items", F.lit(0)).alias("total_items"),
        F.coalesce("total_quantity", F.lit(0)).alias("total_quantity"),
        "created_at", "updated_at",
    )
