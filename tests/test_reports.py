from collections import Counter
from decimal import Decimal
from itertools import combinations
from random import Random

import pytest
from conftest import SMALL, at, rows
from pyspark.sql import functions as F

from tallyhouse import schema
from tallyhouse.operators import stats, views
from tallyhouse.plans import QUERIES
from tallyhouse.plans.base import Shop


def test_seed_rows(seed):
    orders, items = seed
    assert rows(views.order_summary(orders, items), "id", "item_count", "total_quantity") == [
        ("o1", 1, 2), ("o2", 1, 1), ("o3", 1, 1)
    ]
    assert rows(views.product_sales_performance(items, orders), "product_id", "total_revenue") == [
        ("p1", Decimal("299.98"))
    ]
    assert dict(rows(stats.count_by_status(orders)))["CANCELLED"] == 0
    assert rows(stats.user_summary(orders, "u3")) == [("u3", 1, 1, 0, Decimal("0.00"))]


def test_overall_statistics_cover_every_state(make_orders):
    pending = [(f"p{n}", "u", "PENDING", "100.00", "2024-01-01") for n in range(5)]
    done = [(f"c{n}", "u", "COMPLETED", "150.00", "2024-01-01") for n in range(10)]
    overall = stats.order_stats_overall(make_orders(*pending, *done))
    assert rows(overall.where("level = 'all'"), "total_orders", "total_revenue") == [(15, Decimal("2000.00"))]
    per_status = rows(overall.where("level != 'all'"), "total_orders")
    assert sum(n for n, in per_status) == 15


def test_empty_tables(spark):
    orders, items = spark.createDataFrame([], schema.ORDERS), spark.createDataFrame([], schema.ORDER_ITEMS)
    assert rows(stats.total_sales(orders, at("2024-01-01"), at("2024-02-01"))) == [(Decimal("0.00"),)]
    assert rows(stats.avg_item_value(items, orders)) == [(None,)]
    assert rows(stats.order_item_stats(items, orders)) == [(0, None, None, None, None)]
    assert rows(stats.bought_together(items, orders, 1)) == []
    assert {n for _, n in rows(stats.count_by_status(orders))} == {0}


def test_sales_between_is_inclusive(make_orders):
    orders = make_orders(
        ("a", "u", "SHIPPED", "1.00", "2024-01-01"), ("b", "u", "DELIVERED", "2.00", "2024-01-31"),
        ("c", "u", "SHIPPED", "4.00", "2024-01-31 00:00:01"), ("d", "v", "PENDING", "8.00", "2024-01-15"),
    )
    assert rows(stats.total_sales(orders, at("2024-01-01"), at("2024-01-31"))) == [(Decimal("3.00"),)]
    assert rows(stats.total_sales_by_user(orders)) == [("u", Decimal("7.00")), ("v", Decimal("0.00"))]


def test_months_break_at_utc_midnight(make_orders):
    orders = make_orders(
        ("a", "u", "PENDING", "1.00", "2024-01-31 23:59:59"), ("b", "u", "PENDING", "2.00", "2024-02-01"),
    )
    got = [(r["month"], r["order_count"]) for r in stats.monthly_summary(orders, at("2024-01-01")).collect()]
    assert got == [(at("2024-02-01"), 1), (at("2024-01-01"), 1)]


def test_renamed_product_forms_two_groups(make_orders, make_items):
    orders = make_orders(("a", "u", "SHIPPED", "1.00", "2024-01-01"))
    items = make_items(("1", "a", "p", "Old", 1, "1.00"), ("2", "a", "p", "New", 1, "1.00"))
    assert stats.top_products_by_quantity(items, orders).count() == 2


def test_sales_view_counts_per_line_unless_told_otherwise(make_orders, make_items):
    orders = make_orders(("a", "u", "SHIPPED", "10.00", "2024-01-01"), ("b", "v", "SHIPPED", "20.00", "2024-01-01"))
    items = make_items(("1", "a", "p", "P", 1, "1.00"), ("2", "a", "q", "Q", 2, "1.00"), ("3", "b", "p", "P", 4, "1.00"))
    columns = ("order_count", "total_revenue", "avg_order_value", "total_items_sold", "unique_customers")
    assert rows(views.sales_analytics(orders, items), *columns) == [(3, Decimal("40.00"), 40 / 3, 7, 2)]
    assert rows(views.sales_analytics(orders, items, dedupe_orders=True), *columns) == [(2, Decimal("30.00"), 15.0, 7, 2)]


def test_order_without_items_in_summary(make_orders, make_items):
    orders = make_orders(("a", "u", "SHIPPED", "10.00", "2024-01-01"))
    items = make_items(("1", "other", "p", "P", 1, "1.00"))
    got = rows(views.order_summary(orders, items), "item_count", "total_quantity", "avg_item_price")
    assert got == [(0, None, None)]


@pytest.mark.parametrize("min_frequency", [1, 2, 4])
@pytest.mark.parametrize("pair_slice, broadcast", [(3, True), (3, False), (1_000, True)])
def test_pairs_against_brute_force(spark, make_orders, make_items, min_frequency, pair_slice, broadcast):
    if not broadcast:  # all joins by sorting, as on large tables
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    random = Random(5)
    states = ["SHIPPED", "DELIVERED", "PENDING"]
    orders = [(f"o{n}", "u", states[n % 3], "1.00", "2024-01-01") for n in range(30)]
    lines = [(f"o{random.randrange(30)}", random.randrange(12)) for _ in range(100)]
    lines += [("o0", random.randrange(40)) for _ in range(150)]  # one order with most of the lines
    items = [(str(n), order, f"p{p:02d}", f"name{p % 5}", 1, "1.00") for n, (order, p) in enumerate(lines)]

    sold = {i for i, _, status, *_ in orders if status != "PENDING"}
    per_order = {}
    for order, p in lines:
        if order in sold:
            per_order.setdefault(order, []).append((f"p{p:02d}", f"name{p % 5}"))
    expected = Counter()
    for products in per_order.values():
        for x, y in combinations(products, 2):
            if x[0] != y[0]:
                expected[tuple(sorted((x, y)))] += 1
    got = stats.bought_together(make_items(*items), make_orders(*orders), min_frequency, pair_slice=pair_slice)
    want = sorted(((*x, *y, n) for (x, y), n in expected.items() if n >= min_frequency), key=repr)
    try:
        assert rows(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_an_order_with_thousands_of_products(make_orders, make_items):
    """Only the products that another order has too can be in a frequent pair; the others form none at all."""
    orders = make_orders(("big", "u", "SHIPPED", "1.00", "2024-01-01"), ("small", "v", "DELIVERED", "1.00", "2024-01-02"))
    shared = range(0, 5_000, 170)
    items = make_items(
        *((f"b{n}", "big", f"p{n:04d}", "P", 1, "1.00") for n in range(5_000)),
        *((f"s{n}", "small", f"p{n:04d}", "P", 1, "1.00") for n in shared),
    )
    got = stats.bought_together(items, orders, 2, pair_slice=10)
    want = sorted((f"p{x:04d}", "P", f"p{y:04d}", "P", 2) for x, y in combinations(shared, 2))
    assert rows(got) == want
    pairs = stats._pairs(stats._within_reach(items.groupBy("order_id", *stats.PAIR_KEY).agg(F.count("*").alias("lines")), 2), 10)
    assert pairs.count() == 2 * len(want)


def test_replenishment_with_and_without_stock(make_orders, make_items, make_products):
    orders = make_orders(("a", "u", "SHIPPED", "1.00", "2024-01-01"))
    items = make_items(("1", "a", "p", "P", 5, "1.00"), ("2", "a", "q", "Q", 7, "1.00"))
    assert rows(stats.replenishment_candidates(items, orders, at("2024-01-01"), 1), "product_id") == [("q",)]
    products = make_products(("q", "Q", "1.00", True, 3))
    with_stock = stats.replenishment_candidates(items, orders, at("2024-01-01"), products=products)
    assert rows(with_stock, "product_id", "available_quantity") == [("p", None), ("q", 3)]


def test_all_pairs_are_all_pairs(spark):
    """The registered query lists every pair, not the most frequent ones."""
    shop = Shop(spark, SMALL)
    sold = shop.item_keys.join(shop.orders.where("status IN ('SHIPPED', 'DELIVERED')").selectExpr("id AS order_id"), "order_id")
    lines = sold.select("order_id", "product_id")
    pairs = lines.join(lines.withColumnRenamed("product_id", "other"), "order_id").where("product_id < other")
    want = pairs.select("product_id", "other").distinct().count()
    assert want > 500 and QUERIES["bought_together_all"](spark, SMALL).count() == want
