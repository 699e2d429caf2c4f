"""Statistics and reporting views."""

from __future__ import annotations

from datetime import datetime

from tallyhouse.operators import stats, views
from tallyhouse.plans.base import Registered, with_sql

START, END = datetime(1996, 1, 1), datetime(1998, 12, 31)
IN_SPAN = "created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1998-12-31'"
SINCE = datetime(1999, 1, 1)
AFTER = "created_at >= TIMESTAMP '1999-01-01'"
DAY = datetime(2001, 8, 1)
IS_SOLD = "status IN ('SHIPPED', 'DELIVERED')"


def _mean(column: str) -> str:
    return f"cast(sum({column}) AS double) / count({column})"


def _money(column: str) -> str:
    return f"cast(coalesce(sum({column}), 0) AS double)"


def _whole(column: str) -> str:
    return f"cast(coalesce(sum({column}), 0) AS bigint)"


PRODUCT = "product_id, product_name, product_sku"

QUERIES: dict[str, Registered] = {
    # orders
    "count_by_status": Registered(
        lambda s: stats.count_by_status(s.orders),
        with_sql(
            """SELECT t.status, count(o.id) AS order_count
               FROM unnest(['PENDING', 'CONFIRMED', 'PROCESSING', 'SHIPPED', 'DELIVERED', 'CANCELLED',
                            'RETURNED', 'REFUNDED']) AS t(status)
               LEFT JOIN o ON o.status = t.status GROUP BY t.status""",
            "o",
        ),
    ),
    "count_by_user_status": Registered(
        lambda s: stats.count_by_user_status(s.orders),
        with_sql("SELECT user_id, status, count(id) AS order_count FROM o GROUP BY ALL", "o"),
    ),
    "daily_order_count": Registered(
        lambda s: stats.daily_order_count(s.orders, DAY),
        with_sql("SELECT count(id) AS order_count FROM o WHERE created_at >= TIMESTAMP '2001-08-01'", "o"),
    ),
    "total_sales": Registered(
        lambda s: stats.total_sales(s.orders, START, END),
        with_sql(f"SELECT {_money('total_amount')} AS total_sales FROM o WHERE {IS_SOLD} AND {IN_SPAN}", "o"),
    ),
    "total_sales_by_user": Registered(
        lambda s: stats.total_sales_by_user(s.orders),
        with_sql(
            f"""SELECT u.user_id, {_money('o.total_amount')} AS total_sales
                FROM (SELECT DISTINCT user_id FROM o) u
                LEFT JOIN o ON o.user_id = u.user_id AND {IS_SOLD} GROUP BY u.user_id""",
            "o",
        ),
    ),
    "top_customers_by_count": Registered(
        lambda s: stats.top_customers_by_count(s.orders, 20),
        with_sql(
            f"""SELECT user_id, count(id) AS order_count FROM o WHERE {IS_SOLD}
                GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 20""",
            "o",
        ),
    ),
    "top_customers_by_amount": Registered(
        lambda s: stats.top_customers_by_amount(s.orders, 20),
        with_sql(
            f"""SELECT user_id, {_money('total_amount')} AS total_amount FROM o WHERE {IS_SOLD}
                GROUP BY user_id ORDER BY sum(o.total_amount) DESC, user_id LIMIT 20""",
            "o",
        ),
    ),
    "order_stats_by_status": Registered(
        lambda s: stats.order_stats_by_status(s.orders),
        with_sql(
            f"""SELECT status, count(id) AS order_count, {_mean('o.total_amount')} AS avg_amount,
                       {_money('o.total_amount')} AS total_amount FROM o GROUP BY status""",
            "o",
        ),
    ),
    "order_stats_overall": Registered(
        lambda s: stats.order_stats_overall(s.orders),
        with_sql(
            f"""SELECT status AS level, status, count(id) AS total_orders, {_money('total_amount')} AS total_revenue
                FROM o GROUP BY status
                UNION ALL SELECT 'all', NULL, count(id), {_money('total_amount')} FROM o""",
            "o",
        ),
    ),
    "monthly_summary": Registered(
        lambda s: stats.monthly_summary(s.orders, SINCE),
        with_sql(
            f"""SELECT cast(date_trunc('month', created_at) AS timestamp) AS month, count(id) AS order_count,
                       {_money('o.total_amount')} AS total_amount, {_mean('o.total_amount')} AS avg_amount
                FROM o WHERE {AFTER} GROUP BY 1""",
            "o",
        ),
    ),
    "user_summary": Registered(
        lambda s: stats.user_summary(s.orders),
        with_sql(
            f"""SELECT user_id, count(id) AS total_orders,
                       count(id) FILTER (status = 'PENDING') AS pending_orders,
                       count(id) FILTER (status = 'DELIVERED') AS completed_orders,
                       cast(coalesce(sum(total_amount) FILTER ({IS_SOLD}), 0) AS double) AS total_spent
                FROM o GROUP BY user_id""",
            "o",
        ),
    ),
    # products
    "quantity_sold_by_product": Registered(
        lambda s: stats.quantity_sold_by_product(s.item_keys, s.orders),
        with_sql(
            f"""SELECT u.product_id, {_whole('quantity')} AS total_quantity
                FROM (SELECT DISTINCT product_id FROM i) u LEFT JOIN sold ON sold.product_id = u.product_id
                GROUP BY u.product_id""",
            "sold",
        ),
    ),
    "revenue_by_product": Registered(
        lambda s: stats.revenue_by_product(s.items, s.orders),
        with_sql(
            f"""SELECT u.product_id, {_money('total_price')} AS total_revenue
                FROM (SELECT DISTINCT product_id FROM i) u LEFT JOIN sold ON sold.product_id = u.product_id
                GROUP BY u.product_id""",
            "sold",
        ),
    ),
    "quantity_sold_in_range": Registered(
        lambda s: stats.quantity_sold_in_range(s.item_keys, s.orders, START, END),
        with_sql(
            f"""SELECT u.product_id, {_whole('quantity')} AS total_quantity
                FROM (SELECT DISTINCT product_id FROM i) u
                LEFT JOIN sold ON sold.product_id = u.product_id AND {IN_SPAN}
                GROUP BY u.product_id""",
            "sold",
        ),
    ),
    "top_products_by_quantity": Registered(
        lambda s: stats.top_products_by_quantity(s.items, s.orders, 25),
        with_sql(
            f"""SELECT {PRODUCT}, {_whole('quantity')} AS total_quantity FROM sold
                GROUP BY {PRODUCT} ORDER BY 4 DESC, {PRODUCT} LIMIT 25""",
            "sold",
        ),
    ),
    "top_products_by_revenue": Registered(
        lambda s: stats.top_products_by_revenue(s.items, s.orders, 25),
        with_sql(
            f"""SELECT {PRODUCT}, {_money('total_price')} AS total_revenue FROM sold
                GROUP BY {PRODUCT} ORDER BY sum(total_price) DESC, {PRODUCT} LIMIT 25""",
            "sold",
        ),
    ),
    "top_products_in_range": Registered(
        lambda s: stats.top_products_in_range(s.items, s.orders, START, END, 25),
        with_sql(
            f"""SELECT {PRODUCT}, {_whole('quantity')} AS total_quantity, {_money('total_price')} AS total_revenue
                FROM sold WHERE {IN_SPAN} GROUP BY {PRODUCT} ORDER BY 4 DESC, {PRODUCT} LIMIT 25""",
            "sold",
        ),
    ),
    "product_sales_summary": Registered(
        lambda s: stats.product_sales_summary(s.items, s.orders),
        with_sql(
            f"""SELECT {PRODUCT}, count(DISTINCT order_id) AS order_count, {_whole('quantity')} AS total_quantity,
                       {_mean('unit_price')} AS avg_price, {_money('total_price')} AS total_revenue
                FROM sold GROUP BY {PRODUCT}""",
            "sold",
        ),
    ),
    "avg_item_value": Registered(
        lambda s: stats.avg_item_value(s.items, s.orders),
        with_sql(f"SELECT {_mean('total_price')} AS avg_item_value FROM sold", "sold"),
    ),
    "avg_item_quantity": Registered(
        lambda s: stats.avg_item_quantity(s.item_keys, s.orders),
        with_sql(f"SELECT {_mean('quantity')} AS avg_item_quantity FROM sold", "sold"),
    ),
    "distinct_products_sold": Registered(
        lambda s: stats.distinct_products_sold(s.item_keys, s.orders),
        with_sql("SELECT count(DISTINCT product_id) AS distinct_products FROM sold", "sold"),
    ),
    "order_item_stats": Registered(
        lambda s: stats.order_item_stats(s.items, s.orders),
        with_sql(
            f"""SELECT count(*) AS item_count, {_whole('quantity')} AS total_quantity,
                       {_mean('quantity')} AS avg_quantity, {_money('total_price')} AS total_revenue,
                       {_mean('total_price')} AS avg_value FROM sold""",
            "sold",
        ),
    ),
    "count_items_by_product": Registered(
        lambda s: stats.count_items_by_product(s.item_keys),
        with_sql("SELECT l_partkey AS product_id, count(*) AS item_count FROM lineitem GROUP BY l_partkey"),
    ),
    "monthly_product_sales": Registered(
        lambda s: stats.monthly_product_sales(s.items, s.orders, SINCE),
        with_sql(
            f"""SELECT product_id, product_name, cast(date_trunc('month', created_at) AS timestamp) AS month,
                       {_whole('quantity')} AS total_quantity, {_money('total_price')} AS total_revenue
                FROM sold WHERE {AFTER} GROUP BY 1, 2, 3""",
            "sold",
        ),
    ),
    "replenishment_candidates": Registered(
        lambda s: stats.replenishment_candidates(s.items, s.orders, SINCE, 30, s.products),
        with_sql(
            f"""SELECT t.*, p.in_stock, cast(p.available_quantity AS bigint) AS available_quantity FROM (
                  SELECT {PRODUCT}, {_whole('quantity')} AS total_sold FROM sold WHERE {AFTER}
                  GROUP BY {PRODUCT} ORDER BY 4 DESC, {PRODUCT} LIMIT 30) t
                LEFT JOIN p ON p.id = t.product_id""",
            "sold", "p",
        ),
    ),
    "bought_together": Registered(
        lambda s: stats.bought_together(s.items, s.orders, 2),
        with_sql(
            """SELECT x.product_id AS product1_id, x.product_name AS product1_name,
                      y.product_id AS product2_id, y.product_name AS product2_name, count(*) AS frequency
               FROM i x, i y, o
               WHERE x.order_id = y.order_id AND x.product_id < y.product_id AND o.id = x.order_id
                 AND o.status IN ('SHIPPED', 'DELIVERED')
               GROUP BY ALL HAVING count(*) >= 2""",
            "i", "o",
        ),
    ),
    "bought_together_sliced": Registered(
        lambda s: stats.bought_together(s.items, s.orders, 2, pair_slice=6),
        with_sql(
            """SELECT x.product_id AS product1_id, x.product_name AS product1_name,
                      y.product_id AS product2_id, y.product_name AS product2_name, count(*) AS frequency
               FROM i x, i y, o
               WHERE x.order_id = y.order_id AND x.product_id < y.product_id AND o.id = x.order_id
                 AND o.status IN ('SHIPPED', 'DELIVERED')
               GROUP BY ALL HAVING count(*) >= 2""",
            "i", "o",
        ),
    ),
    "bought_together_all": Registered(
        lambda s: stats.bought_together(s.items, s.orders, 1),
        with_sql(
            """SELECT x.product_id AS product1_id, x.product_name AS product1_name,
                      y.product_id AS product2_id, y.product_name AS product2_name, count(*) AS frequency
               FROM sold x JOIN sold y ON x.order_id = y.order_id AND x.product_id < y.product_id
               GROUP BY ALL""",
            "sold",
        ),
    ),
    # views
    "order_summary": Registered(
        lambda s: views.order_summary(s.orders, s.items),
        with_sql(
            f"""SELECT o.id, any_value(order_number) AS order_number, any_value(user_id) AS user_id,
                       any_value(status) AS status, cast(any_value(total_amount) AS double) AS total_amount,
                       any_value(created_at) AS created_at, any_value(updated_at) AS updated_at,
                       count(i.id) AS item_count, cast(sum(quantity) AS bigint) AS total_quantity,
                       CASE WHEN count(i.id) > 0 THEN {_mean('unit_price')} END AS avg_item_price,
                       cast(max(unit_price) AS double) AS max_item_price,
                       cast(min(unit_price) AS double) AS min_item_price
                FROM o LEFT JOIN i ON i.order_id = o.id GROUP BY o.id""",
            "o", "i",
        ),
    ),
    "sales_analytics": Registered(
        lambda s: views.sales_analytics(s.orders, s.item_keys),
        with_sql(
            f"""SELECT status, cast(date_trunc('day', created_at) AS timestamp) AS order_date,
                       count(*) AS order_count, {_money('total_amount')} AS total_revenue,
                       {_mean('total_amount')} AS avg_order_value, {_whole('quantity')} AS total_items_sold,
                       count(DISTINCT user_id) AS unique_customers
                FROM sold GROUP BY 1, 2""",
            "sold",
        ),
    ),
    "sales_analytics_per_order": Registered(
        lambda s: views.sales_analytics(s.orders, s.item_keys, dedupe_orders=True),
        with_sql(
            f"""SELECT status, cast(date_trunc('day', created_at) AS timestamp) AS order_date,
                       count(*) AS order_count, {_money('total_amount')} AS total_revenue,
                       {_mean('total_amount')} AS avg_order_value, {_whole('q')} AS total_items_sold,
                       count(DISTINCT user_id) AS unique_customers
                FROM (SELECT order_id, any_value(status) AS status, any_value(created_at) AS created_at,
                             any_value(user_id) AS user_id, any_value(total_amount) AS total_amount,
                             sum(quantity) AS q FROM sold GROUP BY order_id)
                GROUP BY 1, 2""",
            "sold",
        ),
    ),
    "product_sales_performance": Registered(
        lambda s: views.product_sales_performance(s.items, s.orders),
        with_sql(
            f"""SELECT {PRODUCT}, count(DISTINCT order_id) AS order_count,
                       {_whole('quantity')} AS total_quantity_sold, {_money('total_price')} AS total_revenue,
                       {_mean('unit_price')} AS avg_selling_price, cast(max(unit_price) AS double) AS max_selling_price,
                       cast(min(unit_price) AS double) AS min_selling_price
                FROM sold GROUP BY {PRODUCT}""",
            "sold",
        ),
    ),
    "customer_order_history": Registered(
        lambda s: views.customer_order_history(s.orders),
        with_sql(
            f"""SELECT user_id, count(id) AS total_orders, {_money('total_amount')} AS total_spent,
                       {_mean('total_amount')} AS avg_order_value, cast(max(total_amount) AS double) AS max_order_value,
                       min(created_at) AS first_order_date, max(created_at) AS last_order_date,
                       count(id) FILTER (status = 'DELIVERED') AS completed_orders,
                       count(id) FILTER (status = 'CANCELLED') AS cancelled_orders
                FROM o GROUP BY user_id""",
            "o",
        ),
    ),
    "order_status_summary": Registered(
        lambda s: views.order_status_summary(s.orders),
        with_sql(
            f"""SELECT status, count(id) AS order_count, {_money('total_amount')} AS total_value,
                       {_mean('total_amount')} AS avg_value, min(created_at) AS earliest_order,
                       max(created_at) AS latest_order FROM o GROUP BY status""",
            "o",
        ),
    ),
}
