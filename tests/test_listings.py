from decimal import Decimal

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tallyhouse.operators import item_listings, listings, nesting
from tallyhouse.operators.paging import By, first_per_key, last_place, page_after, page_of, page_with_total


@pytest.fixture(scope="module")
def orders(make_orders):
    return make_orders(
        ("a", "u1", "PENDING", "10.00", "2024-01-01"),
        ("b", "u1", "CONFIRMED", "20.00", "2024-01-03"),
        ("c", "u1", "PROCESSING", "30.00", "2024-01-03"),
        ("d", "u2", "SHIPPED", "40.00", "2024-01-05", "2024-01-06"),
        ("e", "u2", "PROCESSING", "50.00", "2024-01-07"),
    )


def ids(df):
    return [row["id"] for row in df.collect()]


def test_newest_first_with_id_as_tie_break(orders):
    assert ids(listings.orders_by_user(orders, "u1")) == ["b", "c", "a"]
    assert ids(listings.orders_by_user(orders, "u1", page=0, size=1)) == ["b"]
    assert ids(listings.orders_by_user(orders)) == ["b", "c", "a", "e", "d"]


def test_between_includes_both_ends(orders):
    assert ids(listings.orders_by_date_range(orders, at("2024-01-03"), at("2024-01-05"))) == ["d", "b", "c"]
    assert ids(listings.orders_by_amount_range(orders, Decimal("20.00"), Decimal("40.00"))) == ["d", "b", "c"]


def test_queue_and_overdue(orders):
    assert ids(listings.processing_queue(orders)) == ["b"]
    # exactly 24 hours is not overdue
    assert ids(listings.overdue_orders(orders, at("2024-01-08"), 24)) == ["c"]
    assert ids(listings.overdue_orders(orders, at("2024-01-08 00:00:01"), 24)) == ["c", "e"]


def test_missing_and_existing_numbers(spark, orders):
    numbers = spark.createDataFrame([("ORD-1234567890-0001",), ("nope",), ("nope",)], "order_number string")
    assert rows(listings.order_exists(orders, numbers)) == [("ORD-1234567890-0001", True), ("nope", False)]
    assert rows(listings.lookup_missing(orders, numbers, "order_number")) == [("nope",)]


def test_orders_containing_product_are_not_doubled(orders, make_items):
    items = make_items(("1", "a", "p", "P", 1, "1.00"), ("2", "a", "p", "P", 2, "1.00"), ("3", "d", "q", "Q", 1, "1.00"))
    assert ids(listings.orders_containing_product(orders, items, "p")) == ["a"]


def test_pages_concatenate_to_the_listing(orders):
    order = [F.desc("created_at"), F.asc("id")]
    paged = [i for page in range(3) for i in ids(page_of(orders, order, page, 2))]
    assert paged == ids(page_of(orders, order))
    third = page_with_total(orders, order, 2, 2).collect()
    assert [(r["id"], r["total_elements"], r["total_pages"]) for r in third] == [("a", 5, 3)]


@pytest.mark.parametrize("directions", [(False, False), (True, False), (False, True), (True, True)])
def test_pages_by_place_walk_the_whole_listing(spark, directions):
    """Mixed directions, nulls and ties; every page starts where the client's last row was."""
    data = [(n % 4 or None, n % 3 or None, n) for n in range(37)]
    table = spark.createDataFrame(data, "a int, b int, id int").repartition(5)
    order = [By("a", directions[0]), By("b", directions[1]), By("id", True)]
    whole = table.orderBy(*(by.sorted() for by in order)).collect()
    walked, last = [], None
    while page := page_after(table, order, 8, last).collect():
        walked += page
        last = page[-1].asDict()
    assert walked == whole


def test_a_page_starts_without_the_rows_before_it(spark, make_orders):
    table = spark.range(5_000).select(F.xxhash64("id").alias("value"), "id").repartition(7)
    order = [By("value"), By("id")]
    want = table.orderBy("value", "id").collect()
    assert page_after(table, order, 15, want[3_209].asDict()).collect() == want[3_210:3_225]
    first = page_after(table, order, 15)
    assert page_after(table, order, 15, last_place(first, order)).collect() == want[15:30]
    nothing = page_after(table, order, 15, want[-1].asDict())
    assert nothing.collect() == [] and page_after(table, order, 15, last_place(nothing, order)).collect() == []


@pytest.mark.parametrize("n", [3, 1_200])
def test_first_per_key_of_a_hot_key(spark, n):
    # two thirds of the rows have one key
    table = spark.range(6_000).select(F.when(F.col("id") < 4_000, 0).otherwise(F.col("id") % 7 + 1).alias("k"), "id")
    got = rows(first_per_key(table, ["k"], [F.desc("id")], n, "r"))
    by_key = {}
    for i in range(6_000):
        by_key.setdefault(0 if i < 4_000 else i % 7 + 1, []).append(i)
    expected = [(k, i, r + 1) for k, all_ids in by_key.items() for r, i in enumerate(sorted(all_ids, reverse=True)[:n])]
    assert got == sorted(expected, key=repr)


def test_nested_items(orders, make_items):
    items = make_items(("2", "a", "p", "P", 2, "1.00"), ("1", "a", "q", "Q", 3, "2.00"))
    got = {r["id"]: r for r in nesting.orders_with_items(orders, items).collect()}
    assert [i["id"] for i in got["a"]["items"]] == ["1", "2"]
    assert got["b"]["items"] == [] and got["b"]["part"] == 0
    response = {r["id"]: r for r in nesting.order_response(orders, items).collect()}
    assert (response["a"]["total_items"], response["a"]["total_quantity"]) == (2, 5)
    assert (response["b"]["total_items"], response["b"]["total_quantity"]) == (0, 0)
    assert response["a"]["shipping_address"]["city"] == "New York"


def test_long_order_is_spread_and_kept_whole(orders, make_items):
    items = make_items(*((str(n), "a" if n < 400 else "d", "p", "P", 1, "1.00") for n in range(403)))
    parts = nesting.order_response(orders, items, items_per_row=50).where("id = 'a'").collect()
    assert len(parts) == 8 and all(r["total_items"] == 400 for r in parts)
    assert sorted(int(i["id"]) for r in parts for i in r["items"]) == list(range(400))
    assert max(len(r["items"]) for r in parts) < 100


def test_response_is_one_row_at_every_size(orders, make_items):
    items = make_items(*((str(n), "a" if n < 10_100 else None, "p", "P", 1, "1.00") for n in range(10_110)))
    (long,) = nesting.order_response(orders, items).where("id = 'a'").collect()
    assert (long["part"], len(long["items"]), long["total_items"], long["total_quantity"]) == (0, 10_100, 10_100, 10_100)
    lines = nesting.order_lines(orders, items)
    assert lines.where("id = 'a'").count() == 10_100 and lines.where("item_id IS NULL").count() == orders.count() - 1
    assert [r["item_id"] for r in nesting.user_order_lines(orders, items.limit(0)).collect()] == [None] * orders.count()


def test_item_listings(orders, make_items, spark):
    items = make_items(
        ("1", "a", "p", "B", 2, "5.00"), ("2", "a", "q", "A", 9, "1.00"), ("3", "e", "p", "B", 4, "5.00"),
    )
    assert ids(item_listings.items_by_order(items, "a")) == ["2", "1"]
    assert ids(item_listings.items_by_product(items, orders, "p")) == ["3", "1"]
    assert ids(item_listings.items_by_sku(items, orders, "SKU-p")) == ["3", "1"]
    assert ids(item_listings.high_quantity_items(items, 4)) == ["2", "3"]
    assert ids(item_listings.high_value_items(items, Decimal("10.00"))) == ["3", "1"]
    assert ids(item_listings.purchase_history(items, orders, "p", "u2")) == ["3"]
    assert ids(item_listings.items_by_order_status(items, orders, "PROCESSING")) == ["3"]
    keys = spark.createDataFrame([("a", "p")], "order_id string, product_id string")
    assert ids(item_listings.items_by_order_and_product(items, keys)) == ["1"]
    assert ids(item_listings.delete_items_for_orders(items, keys.select("order_id"))) == ["3"]
    assert ids(item_listings.items_by_orders(items, orders, keys.select("order_id"))) == ["2", "1"]


def test_products_join_the_rows_that_are_left(make_orders, make_items, spark):
    """Items without their product columns give what whole items give; one product is listed twice, one unknown."""
    orders = make_orders(*((f"o{n}", "u", "PENDING" if n % 3 else "SHIPPED", "1.00", f"2024-01-{n + 1:02d}") for n in range(9)))
    items = make_items(*((f"i{n}", f"o{n % 10}", f"p{n % 4}", "", 1, "1.00") for n in range(40)))
    catalogue = spark.createDataFrame([("p0", "A"), ("p1", "B"), ("p1", "B"), ("p3", "C")], "product_id string, product_name string")

    def snapshot(lines):
        return lines.join(catalogue, "product_id")

    narrow = items.select("id", "order_id", "product_id")
    for size in (3, 2_000):
        whole = item_listings.items_by_product(snapshot(narrow), orders, page=0, size=size)
        assert rows(item_listings.items_by_product(narrow, orders, page=0, size=size, snapshot=snapshot), *whole.columns) == rows(whole)
    whole = item_listings.items_by_order_status(snapshot(narrow), orders, "PENDING")
    assert rows(item_listings.items_by_order_status(narrow, orders, "PENDING", snapshot=snapshot), *whole.columns) == rows(whole)
