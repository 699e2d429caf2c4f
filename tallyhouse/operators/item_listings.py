"""Item listings over the order items table, most of them in the order of the parent's creation."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.paging import first_per_key, page_of, page_per_key

# Where items come without their product columns, this adds them to the rows that are left: only narrow rows
# are then shuffled to meet their orders. Rows of a product share its columns.
Snapshot = Callable[[DataFrame], DataFrame]


def _with_created(items: DataFrame, orders: DataFrame, *extra: str) -> DataFrame:
    parent = orders.select(F.col("id").alias("order_id"), F.col("created_at").alias("order_created_at"), *extra)
    return items.join(parent, "order_id")


def _newest() -> list[Column]:
    return [F.desc("order_created_at"), F.asc("id")]


def _of_key(
    rows: DataFrame, key: str, value: object | None, page: int | None, size: int | None
) -> DataFrame:
    if value is not None:
        return page_of(rows, _newest(), page, size)
    if page is None or size is None:
        return rows.orderBy(key, *_newest())
    return page_per_key(rows, [key], _newest(), page, size, "position")


def items_by_order(items: DataFrame, order: object | None = None) -> DataFrame:
    """Items of one order by product name; without ``order`` of every order."""
    if order is not None:
        return items.where(F.col("order_id") == order).orderBy("product_name", "id")
    return items.orderBy("order_id", "product_name", "id")


def items_by_product(
    items: DataFrame, orders: DataFrame, product: object | None = None,
    page: int | None = None, size: int | None = None, snapshot: Snapshot | None = None,
) -> DataFrame:
    if product is not None:
        items = items.where(F.col("product_id") == product)
    rows = _with_created(items, orders)
    if snapshot is not None:
        if product is None and page is not None and size is not None:
            # narrow rows are cut to those a page may have; the snapshot may repeat or drop rows, so it is ranked again
            rows = first_per_key(rows, ["product_id"], _newest(), (page + 1) * size, "position").drop("position")
        rows = snapshot(rows)
    return _of_key(rows, "product_id", product, page, size)


def items_by_sku(items: DataFrame, orders: DataFrame, sku: str | None = None) -> DataFrame:
    if sku is not None:
        items = items.where(F.col("product_sku") == sku)
    return _of_key(_with_created(items, orders), "product_sku", sku, None, None)


def items_by_order_and_product(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items whose (order_id, product_id) is among the keys."""
    return items.join(keys, ["order_id", "product_id"], "left_semi")


def items_by_orders(items: DataFrame, orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Items of many orders: newest order first, then product name. ``keys`` holds ``order_id``."""
    wanted = items.join(keys, "order_id", "left_semi")
    return _with_created(wanted, orders).orderBy(
        F.desc("order_created_at"), F.asc("product_name"), F.asc("id")
    )


def high_quantity_items(items: DataFrame, threshold: int) -> DataFrame:
    return items.where(F.col("quantity") >= threshold).orderBy(F.desc("quantity"), F.asc("id"))


def high_value_items(items: DataFrame, threshold: Decimal) -> DataFrame:
    return items.where(F.col("total_price") >= threshold).orderBy(F.desc("total_price"), F.asc("id"))


def items_by_price_range(items: DataFrame, low: Decimal, high: Decimal) -> DataFrame:
    wanted = F.col("unit_price").between(low, high)
    return items.where(wanted).orderBy(F.desc("unit_price"), F.asc("id"))


def purchase_history(
    items: DataFrame, orders: DataFrame, product: object | None = None, user: object | None = None
) -> DataFrame:
    """What a user bought of a product, newest first; an open key lists all its values."""
    if product is not None:
        items = items.where(F.col("product_id") == product)
    if user is not None:
        orders = orders.where(F.col("user_id") == user)
    bought = _with_created(items, orders, "user_id")
    return bought.orderBy("user_id", "product_id", *_newest())


def items_by_order_status(
    items: DataFrame, orders: DataFrame, status: str, page: int | None = None, size: int | None = None,
    snapshot: Snapshot | None = None,
) -> DataFrame:
    rows = _with_created(items, orders.where(F.col("status") == status))
    return page_of(rows if snapshot is None else snapshot(rows), _newest(), page, size)


def delete_items_for_orders(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items that remain once the given orders are deleted. ``keys`` holds ``order_id``."""
    return items.join(keys, "order_id", "left_anti")
