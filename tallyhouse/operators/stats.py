"""Sales and order statistics.

Items meet their orders only where a result needs both; the orders side is cut to sold rows and to
the columns in use before the join, and the item side is aggregated first where the result allows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import money
from tallyhouse.functions import status as st

PRODUCT = ("product_id", "product_name", "product_sku")


def month_of(ts: str) -> Column:
    return F.date_trunc("month", ts)


def sold_items(
    items: DataFrame, orders: DataFrame, start: datetime | None = None, end: datetime | None = None,
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Items of delivered or shipped orders, optionally created within [start, end]."""
    sold = orders.where(st.is_sold(F.col("status")))
    if start is not None:
        sold = sold.where(F.col("created_at") >= start)
    if end is not None:
        sold = sold.where(F.col("created_at") <= end)
    return items.join(sold.select(F.col("id").alias("order_id"), *columns), "order_id")


def _top(df: DataFrame, by: str, ties: tuple[str, ...], n: int | None) -> DataFrame:
    ranked = df.orderBy(F.desc(by), *map(F.asc, ties))
    return ranked if n is None else ranked.limit(n)


# --- orders ------------------------------------------------------------------------------------


def count_by_status(orders: DataFrame) -> DataFrame:
    """Orders per stored state, 0 for a state without orders."""
    counts = orders.groupBy("status").agg(F.count("*").alias("n"))
    states = orders.sparkSession.createDataFrame([(s,) for s in st.STORED], "status string")
    return states.join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("order_count")
    )


def count_by_user_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id", "status").agg(F.count("*").alias("order_count"))


def daily_order_count(orders: DataFrame, start_of_day: datetime) -> DataFrame:
    """Orders created since the given UTC midnight."""
    return orders.where(F.col("created_at") >= start_of_day).agg(F.count("*").alias("order_count"))


def total_sales(orders: DataFrame, start: datetime, end: datetime) -> DataFrame:
    wanted = st.is_sold(F.col("status")) & F.col("created_at").between(start, end)
    return orders.where(wanted).agg(money.total_or_zero(F.col("total_amount")).alias("total_sales"))


def total_sales_by_user(orders: DataFrame, user: object | None = None) -> DataFrame:
    """Sold amount per user, 0 for a user with no sold order."""
    if user is not None:
        orders = orders.where(F.col("user_id") == user)
    sold = F.when(st.is_sold(F.col("status")), F.col("total_amount"))
    return orders.groupBy("user_id").agg(money.total_or_zero(sold).alias("total_sales"))


def top_customers_by_count(orders: DataFrame, n: int | None = None) -> DataFrame:
    per_user = (
        orders.where(st.is_sold(F.col("status")))
        .groupBy("user_id").agg(F.count("*").alias("order_count"))
    )
    return _top(per_user, "order_count", ("user_id",), n)


def top_customers_by_amount(orders: DataFrame, n: int | None = None) -> DataFrame:
    per_user = (
        orders.where(st.is_sold(F.col("status")))
        .groupBy("user_id").agg(F.sum("total_amount").alias("total_amount"))
    )
    return _top(per_user, "total_amount", ("user_id",), n)


def order_stats_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(
        F.count("*").alias("order_count"),
        money.mean(F.col("total_amount")).alias("avg_amount"),
        F.sum("total_amount").alias("total_amount"),
    )


def order_stats_overall(orders: DataFrame) -> DataFrame:
    """The statistics per state and, in one row of level ``all``, over every order of any state."""
    return (
        orders.rollup("status")
        .agg(
            F.grouping("status").alias("_all"),
            F.count("*").alias("total_orders"),
            money.total_or_zero(F.col("total_amount")).alias("total_revenue"),
        )
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("status")).alias("level"),
            "status", "total_orders", "total_revenue",
        )
    )


def monthly_summary(orders: DataFrame, start: datetime) -> DataFrame:
    return (
        orders.where(F.col("created_at") >= start)
        .groupBy(month_of("created_at").alias("month"))
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount").alias("total_amount"),
            money.mean(F.col("total_amount")).alias("avg_amount"),
        )
        .orderBy(F.desc("month"))
    )


def user_summary(orders: DataFrame, user: object | None = None) -> DataFrame:
    """Per user: all, pending and delivered orders, and the sold amount."""
    if user is not None:
        orders = orders.where(F.col("user_id") == user)
    state = F.col("status")
    return orders.groupBy("user_id").agg(
        F.count("*").alias("total_orders"),
        F.count_if(state == "PENDING").alias("pending_orders"),
        F.count_if(state == "DELIVERED").alias("completed_orders"),
        money.total_or_zero(F.when(st.is_sold(state), F.col("total_amount"))).alias("total_spent"),
    )


# --- products ----------------------------------------------------------------------------------


def _sold_per_product(
    items: DataFrame, orders: DataFrame, value: str, name: str, product: object | None,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Sold sum of ``value`` for every product that has items, 0 where none was sold."""
    if product is not None:
        items = items.where(F.col("product_id") == product)
    sold = orders.where(st.is_sold(F.col("status")))
    if start is not None:
        sold = sold.where(F.col("created_at").between(start, end))
    sold = sold.select(F.col("id").alias("order_id"), F.lit(True).alias("_sold"))
    return (
        items.select("order_id", "product_id", value)
        .join(sold, "order_id", "left")
        .groupBy("product_id")
        .agg(money.total_or_zero(F.when(F.col("_sold"), F.col(value))).alias(name))
    )


def quantity_sold_by_product(items: DataFrame, orders: DataFrame, product: object | None = None) -> DataFrame:
    return _sold_per_product(items, orders, "quantity", "total_quantity", product)


def revenue_by_product(items: DataFrame, orders: DataFrame, product: object | None = None) -> DataFrame:
    return _sold_per_product(items, orders, "total_price", "total_revenue", product)


def quantity_sold_in_range(
    items: DataFrame, orders: DataFrame, start: datetime, end: datetime, product: object | None = None
) -> DataFrame:
    return _sold_per_product(items, orders, "quantity", "total_quantity", product, start, end)


def top_products_by_quantity(items: DataFrame, orders: DataFrame, n: int | None = None) -> DataFrame:
    per_product = sold_items(items, orders).groupBy(*PRODUCT).agg(F.sum("quantity").alias("total_quantity"))
    return _top(per_product, "total_quantity", PRODUCT, n)


def top_products_by_revenue(items: DataFrame, orders: DataFrame, n: int | None = None) -> DataFrame:
    per_product = sold_items(items, orders).groupBy(*PRODUCT).agg(F.sum("total_price").alias("total_revenue"))
    return _top(per_product, "total_revenue", PRODUCT, n)


def top_products_in_range(
    items: DataFrame, orders: DataFrame, start: datetime, end: datetime, n: int | None = None
) -> DataFrame:
    per_product = sold_items(items, orders, start, end).groupBy(*PRODUCT).agg(
        F.sum("quantity").alias("total_quantity"), F.sum("total_price").alias("total_revenue")
    )
    return _top(per_product, "total_quantity", PRODUCT, n)


def product_sales_summary(items: DataFrame, orders: DataFrame) -> DataFrame:
    return sold_items(items, orders).groupBy(*PRODUCT).agg(
        F.count_distinct("order_id").alias("order_count"),
        F.sum("quantity").alias("total_quantity"),
        money.mean(F.col("unit_price")).alias("avg_price"),
        F.sum("total_price").alias("total_revenue"),
    )


def avg_item_value(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Null when nothing was sold."""
    return sold_items(items, orders).agg(money.mean(F.col("total_price")).alias("avg_item_value"))


def avg_item_quantity(items: DataFrame, orders: DataFrame) -> DataFrame:
    return sold_items(items, orders).agg(money.mean(F.col("quantity")).alias("avg_item_quantity"))


def distinct_products_sold(items: DataFrame, orders: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return sold_items(items, orders).agg(distinct("product_id").alias("distinct_products"))


def order_item_stats(items: DataFrame, orders: DataFrame) -> DataFrame:
    return sold_items(items, orders).agg(
        F.count("*").alias("item_count"),
        F.sum("quantity").alias("total_quantity"),
        money.mean(F.col("quantity")).alias("avg_quantity"),
        F.sum("total_price").alias("total_revenue"),
        money.mean(F.col("total_price")).alias("avg_value"),
    )


def count_items_by_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(F.count("*").alias("item_count"))


def monthly_product_sales(items: DataFrame, orders: DataFrame, start: datetime) -> DataFrame:
    return (
        sold_items(items, orders, start, columns=("created_at",))
        .groupBy("product_id", "product_name", month_of("created_at").alias("month"))
        .agg(F.sum("quantity").alias("total_quantity"), F.sum("total_price").alias("total_revenue"))
        .orderBy(F.desc("month"), F.desc("total_revenue"), "product_id", "product_name")
    )


def replenishment_candidates(
    items: DataFrame, orders: DataFrame, since: datetime, n: int | None = None, products: DataFrame | None = None
) -> DataFrame:
    """Best sellers since a date; with ``products`` their current stock is added."""
    per_product = sold_items(items, orders, since).groupBy(*PRODUCT).agg(F.sum("quantity").alias("total_sold"))
    top = _top(per_product, "total_sold", PRODUCT, n)
    if products is None:
        return top
    stock = products.select(F.col("id").alias("product_id"), "in_stock", "available_quantity")
    return top.join(stock, "product_id", "left").orderBy(F.desc("total_sold"), *PRODUCT)


# --- bought together ---------------------------------------------------------------------------

PAIR_SLICE = 1_000
PAIR_KEY = ("product_id", "product_name")
PAIR = ("product1_id", "product1_name", "product2_id", "product2_name")


def bought_together(
    items: DataFrame, orders: DataFrame, min_frequency: int, n: int | None = None, pair_slice: int = PAIR_SLICE
) -> DataFrame:
    """Pairs of products within one sold order, counted per pair of lines, at least ``min_frequency``.

    The lines are first collapsed to one row per order and product with their count; a pair then adds the
    product of both counts, so repeated lines never multiply rows. Products that no frequent pair can have
    are left out of every order. An order's pairs arise in as many tasks as it has slices of ``pair_slice``
    products.
    """
    sold = sold_items(items.select("order_id", *PAIR_KEY), orders)
    # said here already, so that every use of the lines has the same plan and the items are read once
    paired = sold.where(F.col("order_id").isNotNull() & F.col("product_id").isNotNull())
    lines = paired.groupBy("order_id", *PAIR_KEY).agg(F.count("*").alias("lines"))
    if min_frequency > 1:
        lines = _within_reach(lines, min_frequency)
    counted = _pairs(lines, pair_slice).groupBy(*PAIR).agg(F.sum("frequency").alias("frequency"))
    return _top(counted.where(F.col("frequency") >= min_frequency), "frequency", PAIR, n)


def _within_reach(lines: DataFrame, min_frequency: int) -> DataFrame:
    """Drop products no pair of which can be frequent: the lines of the product times the largest line
    count in the order, summed over all orders, bounds the count of each of its pairs from above."""
    most = F.max("lines").over(Window.partitionBy("order_id"))
    reach = (
        lines.withColumn("most", most)
        .groupBy(*PAIR_KEY).agg(F.sum(F.col("lines") * F.col("most")).alias("reach"))
        .where(F.col("reach") >= min_frequency)
        .select(*(F.col(name).alias(f"reached_{name}") for name in PAIR_KEY))
    )
    same = [F.col(name).eqNullSafe(F.col(f"reached_{name}")) for name in PAIR_KEY]
    return lines.join(reach, same, "left_semi")


def _pairs(lines: DataFrame, pair_slice: int) -> DataFrame:
    """Every pair of different products of an order, in the order of their ids.

    One side of an order is dealt into slices of about ``pair_slice`` products, the other is repeated for
    each of them. How many slices an order has is counted inside the plan.
    """
    products = F.count("*").over(Window.partitionBy("order_id"))
    sliced = lines.withColumn("_slices", F.ceil(products / pair_slice).cast("int"))

    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.drop("_slices").withColumnsRenamed(
            {"product_id": f"product{n}_id", "product_name": f"product{n}_name", "lines": f"lines{n}"}
        )

    own = F.pmod(F.xxhash64("product_id"), F.col("_slices")).cast("int")
    first = side(sliced.withColumn("slice", own), 1)
    second = side(sliced.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))), 2)
    return (
        first.join(second, ["order_id", "slice"])
        .where(F.col("product1_id") < F.col("product2_id"))
        .select(*PAIR, (F.col("lines1") * F.col("lines2")).alias("frequency"))
    )
