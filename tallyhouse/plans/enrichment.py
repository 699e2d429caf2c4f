"""Derived columns and data quality."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import status as st
from tallyhouse.operators import enrich, quality
from tallyhouse.operators.addresses import parse_addresses
from tallyhouse.plans.base import AS_OF, Registered, Shop, with_sql

BULK, HIGH_VALUE = 25, Decimal("20000.00")
AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
CAN_CANCEL = "status IN ('PENDING', 'CONFIRMED')"
NEXT = """CASE status WHEN 'PENDING' THEN 'CONFIRMED,CANCELLED' WHEN 'CONFIRMED' THEN 'PROCESSING,CANCELLED'
          WHEN 'PROCESSING' THEN 'SHIPPED,CANCELLED' WHEN 'SHIPPED' THEN 'DELIVERED,RETURNED'
          WHEN 'DELIVERED' THEN 'RETURNED' ELSE '' END"""


def _list_prices(shop: Shop) -> DataFrame:
    """Catalogue prices around the price paid: lower, equal and higher ones."""
    shift = (F.coalesce("available_quantity", F.lit(0)) - 20) * F.lit(Decimal("7.77"))
    return shop.products.withColumn("price", (F.col("price") + shift).cast("decimal(10,2)"))


LIST = """SELECT id, cast(price + (coalesce(available_quantity, 0) - 20) * 7.77 AS decimal(10,2)) AS list FROM p"""


def _percent(part: str, whole: str) -> str:
    """Half-up rounding to four places in whole numbers: exact, whatever the engine's division does."""
    cents, base = f"cast({part} * 100 AS hugeint)", f"cast({whole} * 100 AS hugeint)"
    return f"cast(({cents} * 20000 + {base}) // (2 * {base}) AS double) / 100"


def _with_strays(items: DataFrame) -> DataFrame:
    """All items, and some more whose order does not exist."""
    strays = items.where(F.col("order_id") % 13 == 0)
    return items.unionByName(
        strays.withColumn("id", F.concat(F.lit("stray-"), "id")).withColumn("order_id", -F.col("order_id"))
    )


def _updates(shop: Shop) -> DataFrame:
    """One update per event, for orders some of which do not exist; every third gives an address."""
    given = F.struct(*(F.lit(text).alias(name) for name, text in NEW_ADDRESS.items()))
    return shop.events.select(
        F.expr("event_id div 3 * 5").alias("order_id"),
        F.col("event_id").alias("update_id"),
        F.col("to_status").alias("status"),
        F.when(F.col("event_id") % 3 == 0, given).alias("shipping_address"),
        F.when(F.col("event_id") % 4 == 0, given).alias("billing_address"),
    )


NEW_ADDRESS = {
    "addressLine1": "1 New Street", "addressLine2": "Floor 2", "city": "Springfield",
    "state": "IL", "postalCode": "62701", "country": "USA",
}
UPDATES = """SELECT event_id // 3 * 5 AS order_id, event_id AS update_id, to_status AS target,
                    event_id % 3 = 0 AS ship, event_id % 4 = 0 AS bill FROM ev"""

QUERIES: dict[str, Registered] = {
    "enrich_orders": Registered(
        lambda s: enrich.enrich_orders(s.addressed, s.items, AS_OF, Decimal("300000.00"), 500, product=7).drop(
            "shipping_address", "billing_address"
        ),
        with_sql(
            f"""SELECT id, order_number, user_id, status, cast(total_amount AS double) AS total_amount, created_at,
                       updated_at, status IN ('DELIVERED', 'CANCELLED', 'RETURNED', 'REFUNDED') AS is_final,
                       {CAN_CANCEL} AS can_cancel, status = 'PENDING' AS can_modify,
                       status NOT IN ('CANCELLED', 'RETURNED', 'REFUNDED') AS is_active, {NEXT} AS next_statuses,
                       cast(coalesce(q, 0) AS bigint) AS total_quantity, coalesce(n, 0) AS distinct_items,
                       coalesce(mean, 0.0) AS avg_item_value,
                       total_amount >= 300000 AS is_high_value, datediff('hour', created_at, {AS_OF_SQL}) // 24 AS age_days,
                       datediff('hour', updated_at, {AS_OF_SQL}) // 24 > 500 AS is_overdue,
                       coalesce(has7, false) AS contains_product, id % 2 = 0 AS same_address
                FROM oj LEFT JOIN (
                  SELECT order_id, count(*) AS n, sum(quantity) AS q, bool_or(product_id = 7) AS has7,
                         cast((cast(sum(total_price) * 100 AS hugeint) * 2 + count(*)) // (2 * count(*)) AS double)
                           / 100 AS mean
                  FROM i GROUP BY order_id) ON id = order_id""",
            "oj", "i",
        ),
    ),
    "enrich_items": Registered(
        lambda s: enrich.enrich_items(s.dirty_items, s.orders, _list_prices(s), BULK, HIGH_VALUE),
        with_sql(
            f"""SELECT i.id, i.order_id, i.product_id, i.product_name, i.product_sku,
                       cast(i.quantity AS bigint) AS quantity, cast(i.unit_price AS double) AS unit_price,
                       cast(i.dirty_price AS double) AS total_price,
                       cast(i.total_price AS double) AS calculated_total,
                       true AS valid_quantity, true AS valid_unit_price, i.dirty_price > 0 AS valid_pricing,
                       i.dirty_price = i.total_price AS total_price_correct,
                       CASE WHEN l.list > i.unit_price THEN cast((l.list - i.unit_price) * i.quantity AS double)
                            ELSE 0.0 END AS discount_amount,
                       CASE WHEN l.list > i.unit_price THEN {_percent('(l.list - i.unit_price)', 'l.list')}
                            ELSE 0.0 END AS discount_pct,
                       i.quantity >= 25 AS is_bulk, i.dirty_price >= 20000 AS is_high_value,
                       cast(i.unit_price AS double) AS average_price_per_unit,
                       {_percent('i.dirty_price', 'o.total_amount')} AS contribution_pct,
                       i.product_name || ' (' || i.product_sku || ')' AS display_name,
                       true AS complete_product_info
                FROM i JOIN o ON o.id = i.order_id JOIN ({LIST}) l ON l.id = i.product_id""",
            "i", "o", "p",
        ),
    ),
    "enrich_addresses": Registered(
        lambda s: enrich.enrich_addresses(s.addressed, "billing_address", "usa").drop(
            "order_number", "status", "total_amount", "created_at", "updated_at", "shipping_address",
            "billing_address",
        ),
        with_sql(
            """SELECT id, user_id, billing_line1 || ', ' || city || ', ' || state || ' ' || postal || ', ' || country
                        AS full_address,
                      billing_line1 || chr(10) || city || ', ' || state || ' ' || postal || chr(10) || country
                        AS formatted_address,
                      country = 'USA' AS is_domestic, country <> 'USA' AS is_international,
                      false AS has_secondary_line, city || ', ' || state AS city_state,
                      state || ' ' || postal AS state_postal, true AS is_complete,
                      country = 'USA' AND length(postal) = 5 AS valid_postal,
                      billing_line1 || ', ' || city || ', ' || state AS address_summary,
                      postal AS normalized_postal, '{"addressLine1":"' || billing_line1 || tail AS normalized
               FROM oa""",
            "oa",
        ),
    ),
    "enrich_products": Registered(
        lambda s: enrich.enrich_products(s.products, 10),
        with_sql(
            """SELECT id, name, sku, cast(price AS double) AS price, in_stock,
                      cast(available_quantity AS bigint) AS available_quantity,
                      coalesce(in_stock, false) AS is_in_stock,
                      cast(coalesce(available_quantity, 0) AS bigint) AS safe_quantity,
                      coalesce(in_stock AND available_quantity >= 10, false) AS is_available,
                      cast(price * 10 AS double) AS line_total, name || ' (' || sku || ')' AS display_name,
                      true AS is_complete
               FROM p""",
            "p",
        ),
    ),
    "enrich_payments": Registered(
        lambda s: enrich.enrich_payments(s.payments).drop("processed_at", "created_at", "updated_at"),
        with_sql(
            """SELECT id, payment_number, order_id, user_id, cast(amount AS double) AS amount, currency,
                      payment_method, status, gateway_transaction_id, failure_reason,
                      status = 'COMPLETED' AS is_completed, status IN ('PENDING', 'PROCESSING') AS is_pending,
                      status = 'FAILED' AS is_failed, status = 'CANCELLED' AS is_cancelled,
                      status = 'REFUNDED' AS is_refunded, status NOT IN ('PENDING', 'PROCESSING') AS is_final,
                      cast(amount AS varchar) || ' USD' AS formatted_amount,
                      upper(status[1]) || lower(status[2:]) AS status_name,
                      CASE payment_method WHEN 'CREDIT_CARD' THEN 'Credit Card' WHEN 'DEBIT_CARD' THEN 'Debit Card'
                           WHEN 'PAYPAL' THEN 'PayPal' WHEN 'STRIPE' THEN 'Stripe'
                           WHEN 'BANK_TRANSFER' THEN 'Bank Transfer' WHEN 'DIGITAL_WALLET' THEN 'Digital Wallet'
                           ELSE payment_method END AS method_name,
                      gateway_transaction_id IS NOT NULL AS has_gateway_id,
                      failure_reason IS NOT NULL AS has_failure_reason
               FROM pay""",
            "pay",
        ),
    ),
    "enrich_request_lines": Registered(
        lambda s: enrich.enrich_request_lines(s.lines, BULK),
        with_sql(
            """SELECT request_id, cast(line_no AS bigint) AS line_no, product_id, cast(quantity AS bigint) AS quantity,
                      product_id IS NOT NULL AND quantity > 0 AS is_valid, quantity >= 25 AS is_bulk FROM rl""",
            "rl",
        ),
    ),
    "enrich_requests": Registered(
        lambda s: enrich.enrich_requests(s.headers, s.lines, product=7).drop("shipping_address", "billing_address"),
        with_sql(
            """SELECT o.id AS request_id, o.user_id, o.created_at AS requested_at, count(rl.request_id) AS line_count,
                      cast(coalesce(sum(quantity), 0) AS bigint) AS total_quantity, o.id % 2 = 0 AS same_address,
                      coalesce(bool_or(product_id = 7), false) AS contains_product
               FROM o LEFT JOIN rl ON rl.request_id = o.id GROUP BY 1, 2, 3""",
            "o", "rl",
        ),
    ),
    "enrich_updates": Registered(
        lambda s: enrich.enrich_updates(_updates(s), s.orders).drop("shipping_address", "billing_address"),
        with_sql(
            f"""SELECT u.order_id, u.update_id, u.target AS status, o.status AS current_status,
                       NOT ship AND NOT bill AS is_status_only, ship OR bill AS is_address_update,
                       ship AS is_shipping_update, bill AS is_billing_update, legal.f IS NOT NULL AS is_valid_move,
                       coalesce(o.status IN ('DELIVERED', 'CANCELLED', 'RETURNED', 'REFUNDED'), false)
                         AS modifies_final
                FROM ({UPDATES}) u LEFT JOIN o ON o.id = u.order_id
                LEFT JOIN legal ON legal.f = o.status AND legal.t = u.target""",
            "o", "ev", "legal",
        ),
    ),
    "status_moves": Registered(
        lambda s: s.orders.select("id", F.col("status").alias("old")).withColumn(
            "new", F.explode(F.array(*map(F.lit, st.STORED)))
        ).withColumn("allowed", st.is_move(F.col("old"), F.col("new"))),
        with_sql(
            """SELECT o.id, o.status AS old, t.new, legal.f IS NOT NULL AS allowed
               FROM o, unnest(['PENDING', 'CONFIRMED', 'PROCESSING', 'SHIPPED', 'DELIVERED', 'CANCELLED',
                               'RETURNED', 'REFUNDED']) AS t(new)
               LEFT JOIN legal ON legal.f = o.status AND legal.t = t.new""",
            "o", "legal",
        ),
    ),
    # data quality
    "dq_orders": Registered(
        lambda s: quality.dq_orders(
            s.orders.withColumn("total_amount", F.col("total_amount") - 50000).withColumn(
                "status", F.when(F.col("status") == "REFUNDED", "LOST").otherwise(F.col("status"))
            )
        ),
        with_sql(
            """SELECT id, 'total_amount_negative' AS rule FROM o WHERE total_amount < 50000
               UNION ALL SELECT id, 'status_unknown' FROM o WHERE status = 'REFUNDED'""",
            "o",
        ),
    ),
    "dq_items": Registered(
        lambda s: quality.dq_items(s.dirty_items),
        with_sql("SELECT id, order_id, 'total_price_wrong' AS rule FROM i WHERE dirty_price <> total_price", "i"),
    ),
    "dq_duplicate_numbers": Registered(
        lambda s: quality.dq_duplicate_numbers(
            s.orders.select("order_number").unionByName(s.events.select(
                F.concat(F.lit("ORD-"), F.lpad(F.col("order_id").cast("string"), 10, "0")).alias("order_number")
            ))
        ),
        with_sql(
            """SELECT order_number, count(*) AS uses FROM (
                 SELECT order_number FROM o UNION ALL
                 SELECT 'ORD-' || lpad(cast(order_id AS varchar), 10, '0') FROM ev)
               GROUP BY order_number HAVING count(*) > 1""",
            "o", "ev",
        ),
    ),
    "dq_orphan_items": Registered(
        lambda s: quality.dq_orphan_items(_with_strays(s.item_keys), s.orders),
        with_sql(
            """SELECT x.id, x.order_id, x.product_id, cast(x.quantity AS bigint) AS quantity
               FROM (SELECT id, order_id, product_id, quantity FROM i
                     UNION ALL
                     SELECT 'stray-' || id, -order_id, product_id, quantity FROM i WHERE order_id % 13 = 0) x
               WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = x.order_id)""",
            "i", "o",
        ),
    ),
    "dq_addresses": Registered(
        lambda s: quality.dq_addresses(
            parse_addresses(s.addressed).withColumn(
                "shipping_address",
                F.col("shipping_address")
                .withField("postalCode", F.concat(F.col("shipping_address.postalCode"), F.lit("#")))
                .withField("state", F.when(F.col("shipping_address.state") != "ASIA", F.col("shipping_address.state"))),
            ),
            "shipping_address", "id",
        ),
        with_sql(
            """SELECT id, 'postalCode_characters' AS rule FROM oa
               UNION ALL SELECT id, 'state_blank' FROM oa WHERE state = 'ASIA'""",
            "oa",
        ),
    ),
    "dq_requests": Registered(
        lambda s: quality.dq_requests(
            s.headers.withColumn(
                "billing_address", F.when(F.col("billing_address.state") != "ASIA", F.col("billing_address"))
            ),
            s.lines.withColumn("quantity", F.col("quantity") - 3),
        ),
        with_sql(
            """SELECT id AS request_id, cast(NULL AS bigint) AS line_no, 'items_missing' AS rule FROM o
               WHERE id NOT IN (SELECT request_id FROM rl)
               UNION ALL SELECT id, NULL, 'billing_missing' FROM oa WHERE state = 'ASIA'
               UNION ALL SELECT request_id, line_no, 'quantity_below_one' FROM rl WHERE quantity <= 3""",
            "oa", "rl",
        ),
    ),
    "reconcile_totals": Registered(
        lambda s: quality.reconcile_totals(s.orders, s.items),
        with_sql(
            """SELECT o.id, o.status, cast(o.total_amount AS double) AS old_total,
                      cast(coalesce(t, 0) AS double) AS new_total,
                      CASE WHEN o.total_amount = coalesce(t, 0) THEN 'KEEP'
                           WHEN o.status IN ('DELIVERED', 'CANCELLED', 'RETURNED', 'REFUNDED') THEN 'REFUSE'
                           ELSE 'UPDATE' END AS action
               FROM o LEFT JOIN (SELECT order_id, sum(total_price) AS t FROM i GROUP BY order_id) ON order_id = o.id""",
            "o", "i",
        ),
    ),
    "reconcile_touched": Registered(
        lambda s: quality.reconcile_totals(
            s.orders, s.dirty_items, quality.dq_items(s.dirty_items).select("order_id").distinct()
        ),
        with_sql(
            """SELECT o.id, o.status, cast(o.total_amount AS double) AS old_total, cast(t AS double) AS new_total,
                      CASE WHEN o.total_amount = t THEN 'KEEP'
                           WHEN o.status IN ('DELIVERED', 'CANCELLED', 'RETURNED', 'REFUNDED') THEN 'REFUSE'
                           ELSE 'UPDATE' END AS action
               FROM o JOIN (SELECT order_id, sum(dirty_price) AS t FROM i GROUP BY order_id
                            HAVING bool_or(dirty_price <> total_price)) ON order_id = o.id""",
            "o", "i",
        ),
    ),
    "apply_reconciled": Registered(
        lambda s: quality.apply_reconciled(s.orders, quality.reconcile_totals(s.orders, s.items), AS_OF).select(
            "id", "total_amount", "updated_at"
        ),
        with_sql(
            f""", sums AS (SELECT order_id, sum(total_price) AS t FROM i GROUP BY order_id),
               c AS (SELECT o.*, coalesce(t, 0) AS new,
                            o.status NOT IN ('DELIVERED', 'CANCELLED', 'RETURNED', 'REFUNDED')
                              AND o.total_amount <> coalesce(t, 0) AS changed
                     FROM o LEFT JOIN sums ON order_id = o.id)
               SELECT id, cast(CASE WHEN changed THEN new ELSE total_amount END AS double) AS total_amount,
                      CASE WHEN changed THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM c""",
            "o", "i",
        ),
    ),
}
