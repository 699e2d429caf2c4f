"""Order and item listings."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import addresses, enrich, listings, nesting
from tallyhouse.operators import item_listings as il
from tallyhouse.operators.paging import By, last_place, page_after, page_with_total
from tallyhouse.plans.base import AS_OF, Registered, Shop, with_sql

START, END = datetime(1996, 1, 1), datetime(1998, 12, 31)
SPAN = "created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-12-31'"
PARENT = "JOIN o ON i.order_id = o.id"

ORDER = """id, order_number, user_id, status, cast(total_amount AS double) AS total_amount, created_at, updated_at"""
ITEM = """i.id, i.order_id, i.product_id, i.product_name, i.product_sku, cast(i.quantity AS bigint) AS quantity,
          cast(i.unit_price AS double) AS unit_price, cast(i.total_price AS double) AS total_price"""


def _orders(where: str, columns: str = ORDER) -> str:
    return with_sql(f"SELECT {columns} FROM o WHERE {where}", "o")


def _items(where: str, tail: str = "", extra: str = "") -> str:
    return with_sql(f"SELECT {ITEM}{extra} FROM i {tail} WHERE {where}", "i", "o")


# keys from other tables, some of which match nothing
def _event_numbers(shop: Shop) -> DataFrame:
    number = F.concat(F.lit("ORD-"), F.lpad((F.col("event_id") * 2).cast("string"), 10, "0"))
    return shop.events.select(number.alias("order_number"))


EVENT_NUMBERS = "SELECT 'ORD-' || lpad(cast(event_id * 2 AS varchar), 10, '0') AS order_number FROM events"


def _event_ids(shop: Shop) -> DataFrame:
    return shop.events.select((F.col("event_id") * 2).alias("id"))


LINE = tuple(f"item_{field}" for field in nesting.ITEM_FIELDS)

NESTED_ITEM = """i.id AS item_id, i.product_id AS item_product_id, i.product_name AS item_product_name,
    i.product_sku AS item_product_sku, cast(i.quantity AS bigint) AS item_quantity,
    cast(i.unit_price AS double) AS item_unit_price, cast(i.total_price AS double) AS item_total_price"""
NESTED_ORDER = "o.id, o.order_number, o.user_id, o.status, cast(o.total_amount AS double) AS total_amount"
KEPT = ("id", "order_number", "user_id", "status", "total_amount")

def _third_page(shop: Shop) -> DataFrame:
    """Two pages are walked by the place where each ends."""
    order = [By("created_at", descending=True), By("status"), By("id")]
    listing = shop.orders.select("id", "status", "created_at")
    page = page_after(listing, order, 25)
    for _ in range(2):
        page = page_after(listing, order, 25, last_place(page, order))
    return page


# single keys
USER, PRODUCT = 7, 11

QUERIES: dict[str, Registered] = {
    "orders_of_user": Registered(lambda s: listings.orders_by_user(s.orders, USER), _orders(f"user_id = {USER}")),
    "orders_of_user_page": Registered(
        lambda s: listings.orders_by_user(s.orders, USER, page=1, size=3),
        with_sql(
            f"SELECT {ORDER} FROM o WHERE user_id = {USER} ORDER BY o.created_at DESC, id LIMIT 3 OFFSET 3", "o"
        ),
    ),
    "orders_of_product": Registered(
        lambda s: listings.orders_containing_product(s.orders, s.item_keys, PRODUCT),
        _orders(f"id IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = {PRODUCT})"),
    ),
    "items_of_product": Registered(
        lambda s: il.items_by_product(s.items, s.orders, PRODUCT),
        _items(f"i.product_id = {PRODUCT}", PARENT, ", o.created_at AS order_created_at"),
    ),
    "items_of_order": Registered(lambda s: il.items_by_order(s.items, USER), _items(f"i.order_id = {USER}")),
    "purchase_history_of_product": Registered(
        lambda s: il.purchase_history(s.items, s.orders, PRODUCT).select(
            "user_id", "product_id", "id", "order_created_at", "quantity"
        ),
        with_sql(
            f"""SELECT o.user_id, i.product_id, i.id, o.created_at AS order_created_at,
                       cast(i.quantity AS bigint) AS quantity FROM i {PARENT} WHERE i.product_id = {PRODUCT}""",
            "i", "o",
        ),
    ),
    "items_for_product": Registered(
        lambda s: s.item_keys.select("id", enrich.is_for_product(PRODUCT).alias("is_for_product")),
        with_sql(f"SELECT id, product_id = {PRODUCT} AS is_for_product FROM i", "i"),
    ),

    # lookups
    "lookup_orders_by_id": Registered(
        lambda s: listings.lookup_orders(s.orders, _event_ids(s)),
        _orders("id IN (SELECT event_id * 2 FROM events)"),
    ),
    "lookup_orders_by_number": Registered(
        lambda s: listings.lookup_orders(s.orders, _event_numbers(s), "order_number"),
        _orders(f"order_number IN ({EVENT_NUMBERS})"),
    ),
    "lookup_missing": Registered(
        lambda s: listings.lookup_missing(s.orders, _event_ids(s)),
        with_sql("SELECT DISTINCT event_id * 2 AS id FROM events WHERE event_id * 2 NOT IN (SELECT id FROM o)", "o"),
    ),
    "order_exists": Registered(
        lambda s: listings.order_exists(s.orders, _event_numbers(s)),
        with_sql(
            f"""SELECT DISTINCT order_number, order_number IN (SELECT order_number FROM o) AS "exists"
                FROM ({EVENT_NUMBERS})""",
            "o",
        ),
    ),
    # orders with items
    "orders_with_items": Registered(
        lambda s: nesting.order_lines(s.orders, s.items).select(*KEPT, *LINE),
        with_sql(f"SELECT {NESTED_ORDER}, {NESTED_ITEM} FROM o LEFT JOIN i ON o.id = i.order_id", "o", "i"),
    ),
    "orders_with_items_by_number": Registered(
        lambda s: nesting.order_lines(s.orders, s.items, _event_numbers(s), "order_number").select(*KEPT, *LINE),
        with_sql(
            f"""SELECT {NESTED_ORDER}, {NESTED_ITEM} FROM o LEFT JOIN i ON o.id = i.order_id
                WHERE o.order_number IN ({EVENT_NUMBERS})""",
            "o", "i",
        ),
    ),
    "user_orders_with_items": Registered(
        lambda s: nesting.user_order_lines(s.orders, s.items).select("user_id", "id", "created_at", *LINE),
        with_sql(
            f"SELECT o.user_id, o.id, o.created_at, {NESTED_ITEM} FROM o LEFT JOIN i ON o.id = i.order_id",
            "o", "i",
        ),
    ),
    "order_response": Registered(
        lambda s: nesting.order_response(s.addressed, s.items).select(
            "*",
            F.size("items").alias("listed"),
            F.concat_ws("|", F.transform("items", lambda x: x["id"])).alias("item_ids"),
        ).drop("items"),
        with_sql(
            """SELECT id, order_number, user_id, status, cast(total_amount AS double) AS total_amount,
                      shipping_address, billing_address, 0 AS part, cast(coalesce(n, 0) AS bigint) AS listed,
                      coalesce(ids, '') AS item_ids, cast(coalesce(n, 0) AS bigint) AS total_items,
                      cast(coalesce(q, 0) AS bigint) AS total_quantity, created_at, updated_at
               FROM oj LEFT JOIN (SELECT order_id, count(*) AS n, sum(quantity) AS q,
                                         string_agg(id, '|' ORDER BY id) AS ids
                                  FROM i GROUP BY order_id) ON id = order_id""",
            "oj", "i",
        ),
    ),
    # order listings
    "orders_by_user": Registered(lambda s: listings.orders_by_user(s.orders), _orders("user_id IS NOT NULL")),
    "orders_by_user_page": Registered(
        lambda s: listings.orders_by_user(s.orders, page=1, size=3),
        with_sql(
            f"""SELECT {ORDER}, position FROM (
                  SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM o)
                WHERE position BETWEEN 4 AND 6""",
            "o",
        ),
    ),
    "orders_by_user_status": Registered(
        lambda s: listings.orders_by_user_status(s.orders, "PENDING"), _orders("status = 'PENDING'")
    ),
    "orders_by_status": Registered(
        lambda s: listings.orders_by_status(s.orders, "SHIPPED"), _orders("status = 'SHIPPED'")
    ),
    "orders_by_statuses": Registered(
        lambda s: listings.orders_by_statuses(s.orders, ["RETURNED", "REFUNDED", "CANCELLED"]),
        _orders("status = 'RETURNED' OR status = 'REFUNDED' OR status = 'CANCELLED'"),
    ),
    "orders_by_date_range": Registered(
        lambda s: listings.orders_by_date_range(s.orders, START, END), _orders(SPAN)
    ),
    "orders_by_user_date_range": Registered(
        lambda s: listings.orders_by_user_date_range(s.orders, START, END, page=0, size=5),
        with_sql(
            f"""SELECT {ORDER}, position FROM (
                  SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
                  FROM o WHERE {SPAN})
                WHERE position <= 5""",
            "o",
        ),
    ),
    "orders_by_amount_range": Registered(
        lambda s: listings.orders_by_amount_range(s.orders, Decimal("100000.00"), Decimal("250000.00")),
        _orders("total_amount >= 100000 AND total_amount <= 250000"),
    ),
    "orders_by_user_status_date": Registered(
        lambda s: listings.orders_by_user_status_date(s.orders, "DELIVERED", START, END),
        _orders(f"status = 'DELIVERED' AND {SPAN}"),
    ),
    "orders_page_after": Registered(
        _third_page,
        with_sql(
            "SELECT id, status, created_at FROM o ORDER BY created_at DESC NULLS LAST, status NULLS FIRST, id LIMIT 25 OFFSET 50",
            "o",
        ),
    ),
    "orders_page_with_total": Registered(
        lambda s: page_with_total(s.orders, [F.desc("created_at"), F.asc("id")], page=2, size=20),
        with_sql(
            f"""SELECT {ORDER}, (SELECT count(*) FROM o) AS total_elements,
                       cast(ceil((SELECT count(*) FROM o) / 20.0) AS bigint) AS total_pages
                FROM o ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""",
            "o",
        ),
    ),
    "recent_orders_per_user": Registered(
        lambda s: listings.recent_orders_per_user(s.orders, 3),
        with_sql(
            f"""SELECT {ORDER}, recency FROM (
                  SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS recency FROM o)
                WHERE recency <= 3""",
            "o",
        ),
    ),
    "orders_containing_product": Registered(
        lambda s: listings.orders_per_product(s.orders, s.item_keys),
        with_sql(
            f"""SELECT DISTINCT i.product_id, {", ".join("o." + c for c in (
                "id", "order_number", "user_id", "status"))}, cast(o.total_amount AS double) AS total_amount,
                o.created_at, o.updated_at FROM o JOIN i ON i.order_id = o.id""",
            "o", "i",
        ),
    ),
    "processing_queue": Registered(lambda s: listings.processing_queue(s.orders), _orders("status = 'CONFIRMED'")),
    "overdue_orders": Registered(
        lambda s: listings.overdue_orders(s.orders, AS_OF, 24),
        _orders("status = 'PROCESSING' AND updated_at < TIMESTAMP '2001-08-01 00:00:00'"),
    ),
    "high_value_orders": Registered(
        lambda s: listings.high_value_orders(s.orders, Decimal("400000.00")), _orders("total_amount >= 400000")
    ),
    "high_value_orders_top": Registered(
        lambda s: listings.high_value_orders(s.orders, Decimal("400000.00"), 25),
        with_sql(
            f"SELECT {ORDER} FROM o WHERE total_amount >= 400000 ORDER BY o.total_amount DESC, id LIMIT 25", "o"
        ),
    ),
    "cancellable_orders": Registered(
        lambda s: listings.cancellable_orders(s.orders), _orders("status = 'PENDING' OR status = 'CONFIRMED'")
    ),
    "cancellable_orders_by_user": Registered(
        lambda s: listings.cancellable_orders_by_user(s.orders).select("user_id", "id", "status", "created_at"),
        _orders("status = 'PENDING' OR status = 'CONFIRMED'", "user_id, id, status, created_at"),
    ),
    # item listings
    "items_by_order": Registered(lambda s: il.items_by_order(s.items), _items("true")),
    "items_by_product": Registered(
        lambda s: il.items_by_product(s.item_keys, s.orders, snapshot=s.snapshot), _items("true", PARENT, ", o.created_at AS order_created_at")
    ),
    "items_by_product_page": Registered(
        lambda s: il.items_by_product(s.item_keys, s.orders, page=0, size=4, snapshot=s.snapshot),
        with_sql(
            f"""SELECT {ITEM}, i.order_created_at, i.position FROM (
                  SELECT i.*, o.created_at AS order_created_at,
                         row_number() OVER (PARTITION BY product_id ORDER BY o.created_at DESC, i.id) AS position
                  FROM i {PARENT}) AS i
                WHERE i.position <= 4""",
            "i", "o",
        ),
    ),
    "items_by_sku": Registered(
        lambda s: il.items_by_sku(s.items, s.orders).select("product_sku", "id", "order_created_at"),
        with_sql(f"SELECT i.product_sku, i.id, o.created_at AS order_created_at FROM i {PARENT}", "i", "o"),
    ),
    "items_by_order_and_product": Registered(
        lambda s: il.items_by_order_and_product(
            s.items, s.events.select((F.col("event_id") * 2).alias("order_id")).distinct().join(
                s.item_keys.groupBy("order_id").agg(F.min("product_id").alias("product_id")), "order_id"
            ),
        ),
        _items(
            """(i.order_id, i.product_id) IN (
                 SELECT l_orderkey, min(l_partkey) FROM lineitem
                 WHERE l_orderkey IN (SELECT event_id * 2 FROM events) GROUP BY l_orderkey)"""
        ),
    ),
    "items_by_orders": Registered(
        lambda s: il.items_by_orders(s.items, s.orders, _event_ids(s).withColumnRenamed("id", "order_id")),
        _items(
            "i.order_id IN (SELECT event_id * 2 FROM events)", PARENT, ", o.created_at AS order_created_at"
        ),
    ),
    "high_quantity_items": Registered(lambda s: il.high_quantity_items(s.items, 40), _items("quantity >= 40")),
    "high_value_items": Registered(
        lambda s: il.high_value_items(s.items, Decimal("40000.00")), _items("total_price >= 40000")
    ),
    "items_by_price_range": Registered(
        lambda s: il.items_by_price_range(s.items, Decimal("950.00"), Decimal("1000.00")),
        _items("unit_price >= 950 AND unit_price <= 1000"),
    ),
    "purchase_history": Registered(
        lambda s: il.purchase_history(s.items, s.orders).select(
            "user_id", "product_id", "id", "order_created_at", "quantity"
        ),
        with_sql(
            f"""SELECT o.user_id, i.product_id, i.id, o.created_at AS order_created_at,
                       cast(i.quantity AS bigint) AS quantity FROM i {PARENT}""",
            "i", "o",
        ),
    ),
    "items_by_order_status": Registered(
        lambda s: il.items_by_order_status(s.item_keys, s.orders, "CONFIRMED", snapshot=s.snapshot),
        _items("o.status = 'CONFIRMED'", PARENT, ", o.created_at AS order_created_at"),
    ),
    "items_by_order_status_page": Registered(
        lambda s: il.items_by_order_status(s.item_keys, s.orders, "CONFIRMED", page=1, size=50, snapshot=s.snapshot),
        with_sql(
            f"""SELECT {ITEM}, o.created_at AS order_created_at FROM i {PARENT} WHERE o.status = 'CONFIRMED'
                ORDER BY o.created_at DESC, i.id LIMIT 50 OFFSET 50""",
            "i", "o",
        ),
    ),
    "delete_items_for_orders": Registered(
        lambda s: il.delete_items_for_orders(s.items, _event_ids(s).withColumnRenamed("id", "order_id")),
        _items("i.order_id NOT IN (SELECT event_id * 2 FROM events)"),
    ),
    # stored addresses
    "parse_addresses": Registered(
        lambda s: addresses.parse_addresses(s.addressed).select(
            "id", "address_error",
            *(F.col(f"{side}_address.{field}").alias(f"{side}_{field}")
              for side in ("shipping", "billing") for field in ("addressLine1", "addressLine2", "city", "postalCode")),
        ),
        with_sql(
            """SELECT id, false AS address_error, line1 AS "shipping_addressLine1",
                      cast(NULL AS varchar) AS "shipping_addressLine2", city AS shipping_city,
                      postal AS "shipping_postalCode", billing_line1 AS "billing_addressLine1",
                      cast(NULL AS varchar) AS "billing_addressLine2", city AS billing_city,
                      postal AS "billing_postalCode" FROM oa""",
            "oa",
        ),
    ),
    "render_addresses": Registered(
        lambda s: addresses.render_addresses(addresses.parse_addresses(s.addressed)).select(
            "id", "shipping_address", "billing_address"
        ),
        with_sql("SELECT id, shipping_address, billing_address FROM oj", "oj"),
    ),
    "address_rollup_country": Registered(
        lambda s: addresses.address_rollup(s.addressed, "shipping_address", "country"),
        with_sql(
            """SELECT country, count(*) AS order_count, cast(sum(total_amount) AS double) AS total_amount
               FROM oa GROUP BY country""",
            "oa",
        ),
    ),
    "address_rollup_billing_state": Registered(
        lambda s: addresses.address_rollup(s.addressed, "billing_address", "state"),
        with_sql(
            """SELECT state, count(*) AS order_count, cast(sum(total_amount) AS double) AS total_amount
               FROM oa GROUP BY state""",
            "oa",
        ),
    ),
}
