"""Order listings: lookups, filters and pages over the orders table.

A listing for one user takes ``user``; without it the same listing is given for every user in one
pass. Every sort ends with the order id, so equal timestamps have one order.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import status as st
from tallyhouse.operators.paging import first_per_key, page_of, page_per_key


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def _of_user(orders: DataFrame, user: object | None, page: int | None, size: int | None) -> DataFrame:
    if user is not None:
        return page_of(orders.where(F.col("user_id") == user), _newest(), page, size)
    if page is None or size is None:
        return orders.orderBy("user_id", *_newest())
    return page_per_key(orders, ["user_id"], _newest(), page, size, "position")


# --- lookups -----------------------------------------------------------------------------------


def lookup_orders(orders: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Orders whose id (or ``order_number``) is among the keys."""
    return orders.join(keys, by, "left_semi")


def lookup_missing(orders: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Keys without an order: what a single lookup reports as not found."""
    return keys.select(by).distinct().join(orders, by, "left_anti")


def order_exists(orders: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per distinct number with whether an order carries it."""
    asked = numbers.select("order_number").distinct()
    known = (
        orders.select("order_number").join(asked, "order_number", "left_semi").distinct()
        .withColumn("known", F.lit(True))
    )
    return (
        asked.join(known, "order_number", "left")
        .select("order_number", F.col("known").isNotNull().alias("exists"))
    )


# --- listings ----------------------------------------------------------------------------------


def orders_by_user(
    orders: DataFrame, user: object | None = None, page: int | None = None, size: int | None = None
) -> DataFrame:
    return _of_user(orders, user, page, size)


def orders_by_user_status(
    orders: DataFrame, status: str, user: object | None = None, page: int | None = None, size: int | None = None
) -> DataFrame:
    return _of_user(orders.where(F.col("status") == status), user, page, size)


def orders_by_status(orders: DataFrame, status: str, page: int | None = None, size: int | None = None) -> DataFrame:
    return page_of(orders.where(F.col("status") == status), _newest(), page, size)


def orders_by_statuses(
    orders: DataFrame, statuses: list[str], page: int | None = None, size: int | None = None
) -> DataFrame:
    return page_of(orders.where(F.col("status").isin(*statuses)), _newest(), page, size)


def created_between(start: datetime, end: datetime) -> Column:
    """Both ends included."""
    return F.col("created_at").between(start, end)


def orders_by_date_range(
    orders: DataFrame, start: datetime, end: datetime, page: int | None = None, size: int | None = None
) -> DataFrame:
    return page_of(orders.where(created_between(start, end)), _newest(), page, size)


def orders_by_user_date_range(
    orders: DataFrame, start: datetime, end: datetime, user: object | None = None,
    page: int | None = None, size: int | None = None,
) -> DataFrame:
    return _of_user(orders.where(created_between(start, end)), user, page, size)


def orders_by_amount_range(
    orders: DataFrame, low: Decimal, high: Decimal, page: int | None = None, size: int | None = None
) -> DataFrame:
    return page_of(orders.where(F.col("total_amount").between(low, high)), _newest(), page, size)


def orders_by_user_status_date(
    orders: DataFrame, status: str, start: datetime, end: datetime, user: object | None = None,
    page: int | None = None, size: int | None = None,
) -> DataFrame:
    wanted = (F.col("status") == status) & created_between(start, end)
    return _of_user(orders.where(wanted), user, page, size)


def recent_orders_per_user(orders: DataFrame, n: int, user: object | None = None) -> DataFrame:
    """The newest ``n`` orders of each user, ranked from 1."""
    if user is not None:
        orders = orders.where(F.col("user_id") == user)
    return first_per_key(orders, ["user_id"], _newest(), n, "recency")


def orders_containing_product(
    orders: DataFrame, items: DataFrame, product: object, page: int | None = None, size: int | None = None
) -> DataFrame:
    """Orders with at least one item of the product; a semi join, so no row is ever doubled."""
    holders = items.where(F.col("product_id") == product).select(F.col("order_id").alias("id"))
    return page_of(orders.join(holders, "id", "left_semi"), _newest(), page, size)


def orders_per_product(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The same listing for every product at once: (product_id, order), newest first per product."""
    pairs = items.select("product_id", F.col("order_id").alias("id")).distinct()
    return pairs.join(orders, "id").orderBy("product_id", *_newest())


def processing_queue(orders: DataFrame) -> DataFrame:
    """Confirmed orders, oldest first."""
    return orders.where(F.col("status") == "CONFIRMED").orderBy(F.asc("created_at"), F.asc("id"))


def overdue_orders(orders: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Orders in processing, last touched more than ``hours`` before ``as_of``; stalest first."""
    cutoff = F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    stale = (F.col("status") == "PROCESSING") & (F.col("updated_at") < cutoff)
    return orders.where(stale).orderBy(F.asc("updated_at"), F.asc("id"))


def high_value_orders(orders: DataFrame, threshold: Decimal, n: int | None = None) -> DataFrame:
    order = [F.desc("total_amount"), F.asc("id")]
    wanted = orders.where(F.col("total_amount") >= threshold)
    return page_of(wanted, order, None if n is None else 0, n)


def cancellable_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status").isin(*st.CANCELLABLE)).orderBy(*_newest())


def cancellable_orders_by_user(orders: DataFrame, user: object | None = None) -> DataFrame:
    return _of_user(orders.where(F.col("status").isin(*st.CANCELLABLE)), user, None, None)
