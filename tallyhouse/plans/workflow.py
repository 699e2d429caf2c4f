"""Order processing: requests, updates, history, stock, payments, notifications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import effects, history, ledger, requests, updates
from tallyhouse.plans.base import Registered, Shop, with_sql
from tallyhouse.plans.enrichment import NEW_ADDRESS, UPDATES, _updates
from tallyhouse.session import shared_folder
from tallyhouse.sources import tables

NOW = datetime(2024, 6, 1)


def _lines(shop: Shop) -> DataFrame:
    """All request lines; some of them ask for a product that the catalogue does not have."""
    unknown = (F.col("request_id") + F.col("line_no")) % 29 == 0
    return shop.lines.withColumn("product_id", F.when(unknown, -F.col("product_id")).otherwise(F.col("product_id")))


# all request lines as above, judged against the catalogue, and the verdict per request
LINES = """rq AS (
  SELECT request_id, line_no, CASE WHEN (request_id + line_no) % 29 = 0 THEN -product_id ELSE product_id END AS product_id,
         quantity FROM rl)"""
JUDGED = f"""{LINES},
judged AS (
  SELECT rq.*, p.name, p.sku, p.price, coalesce(p.available_quantity, 0) AS stock,
         CASE WHEN p.id IS NULL THEN 'PRODUCT_NOT_FOUND'
              WHEN p.in_stock IS DISTINCT FROM true THEN 'PRODUCT_OUT_OF_STOCK'
              WHEN p.available_quantity < rq.quantity THEN 'INSUFFICIENT_INVENTORY' END AS code,
         CASE WHEN p.id IS NULL THEN 1 ELSE 2 END AS phase
  FROM rq LEFT JOIN p ON p.id = rq.product_id),
worded AS (
  SELECT *, CASE code
    WHEN 'PRODUCT_NOT_FOUND' THEN 'Product not found: ' || cast(product_id AS varchar)
    WHEN 'PRODUCT_OUT_OF_STOCK' THEN 'Product is out of stock: ' || name
    WHEN 'INSUFFICIENT_INVENTORY' THEN 'Insufficient inventory for product ' || name || '. Requested: '
      || cast(quantity AS varchar) || ', Available: ' || cast(stock AS varchar) END AS message
  FROM judged),
first_reason AS (
  SELECT request_id, code, message FROM worded WHERE code IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY phase, line_no, code, cast(product_id AS varchar), quantity) = 1),
verdict AS (
  SELECT o.id AS request_id, o.user_id, o.created_at,
         CASE WHEN o.id NOT IN (SELECT request_id FROM rq) THEN 'EMPTY_ORDER' ELSE code END AS code,
         CASE WHEN o.id NOT IN (SELECT request_id FROM rq) THEN 'Order must contain at least one item'
              ELSE message END AS message
  FROM o LEFT JOIN first_reason r ON r.request_id = o.id),
accepted AS (SELECT * FROM verdict WHERE code IS NULL),
stamped AS (
  SELECT request_id, user_id, created_at, 'ORD-' || cast(epoch_ms(created_at) AS varchar) || '-'
         || CASE WHEN r < 1000 THEN lpad(cast(r AS varchar), 4, '0') ELSE cast(r AS varchar) END AS order_number
  FROM (SELECT *, row_number() OVER (PARTITION BY created_at ORDER BY request_id) AS r FROM accepted))"""


def _judged(select: str) -> str:
    return with_sql("", "o", "rl", "p").rstrip() + f",\n{JUDGED}\n{select}"


VERDICT = """SELECT request_id, code IS NULL AS accepted, code AS reject_code,
    CASE WHEN code = 'PRODUCT_NOT_FOUND' THEN 'PRODUCT_VALIDATION_FAILED'
         WHEN code IS NOT NULL THEN 'ORDER_CREATION_FAILED' END AS outer_code, message FROM verdict"""


def _created(shop: Shop) -> requests.Created:
    numbers = shop.orders.select("order_number")
    return requests.create_orders(shop.headers, _lines(shop), shop.products, numbers)


def _confirmed(shop: Shop) -> DataFrame:
    """All confirmed orders, and some more that no payment knows."""
    confirmed = shop.orders.where(F.col("status") == "CONFIRMED")
    return confirmed.unionByName(confirmed.where(F.col("id") % 7 == 0).withColumn("id", -F.col("id")))


def _numbered(shop: Shop) -> DataFrame:
    """New numbers for every order, where number 2 is taken in the milliseconds of the pending orders."""
    taken = shop.orders.where(F.col("status") == "PENDING").select(
        F.concat(
            F.lit("ORD-"), F.unix_millis(F.col("created_at").cast("timestamp")).cast("string"), F.lit("-0002")
        ).alias("order_number")
    ).distinct()
    new = shop.orders.select("id", "created_at")
    return requests.assign_order_numbers(new, taken)


def _changes(shop: Shop) -> DataFrame:
    return effects.changes_from(shop.orders, history.status_history(shop.events))


MOVED = """CASE WHEN via = 'create' THEN 'RESERVE'
     WHEN to_status = 'SHIPPED' THEN 'CONFIRM_SALE'
     WHEN to_status = 'CANCELLED' AND from_status IN ('PENDING', 'CONFIRMED', 'PROCESSING') THEN 'RELEASE' END"""


def _outbox(shop: Shop) -> DataFrame:
    counts = shop.item_keys.groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("_n"))
    orders = shop.addressed.join(counts, "id", "left").withColumn("item_count", F.coalesce("_n", F.lit(0)))
    return effects.notification_outbox(_changes(shop), orders, shop.payments)


def _readable(variables: str = "variables"):
    """The map as text, sorted by name."""
    pairs = F.transform(F.map_entries(variables), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("; ", F.array_sort(pairs)).alias(variables)


OUTBOX = """
base AS (
  SELECT ch.*, oj.order_number, oj.user_id, 'user-' || cast(oj.user_id AS varchar) || '@example.com' AS recipient,
         'customerName=Customer ' || cast(oj.user_id AS varchar) AS customer,
         'orderNumber=' || oj.order_number AS number,
         '{"totalAmount":"' || cast(oj.total_amount AS varchar) || '","itemCount":'
           || cast((SELECT count(*) FROM lineitem WHERE l_orderkey = oj.id) AS varchar)
           || ',"shippingAddress":"' || replace(oj.shipping_address, '"', '\\"')
           || '","billingAddress":"' || replace(oj.billing_address, '"', '\\"') || '"}' AS details
  FROM ch JOIN oj ON oj.id = ch.order_id),
sent AS (
  SELECT order_id, event_id, 'ORDER_CONFIRMATION' AS type, recipient,
         'Order Confirmation - ' || order_number AS subject,
         customer || '; orderDetails=' || details || '; ' || number AS variables
  FROM base WHERE via = 'create'
  UNION ALL
  SELECT order_id, event_id, 'ORDER_STATUS_UPDATE', recipient, 'Order Status Update - ' || order_number,
         customer || '; newStatus=' || to_status || '; oldStatus=' || from_status || '; ' || number
  FROM base WHERE via = 'status'
  UNION ALL
  SELECT order_id, event_id, 'ORDER_CANCELLATION', recipient, 'Order Cancelled - ' || order_number,
         customer || '; ' || number || '; reason=Order cancelled by customer request'
  FROM base WHERE via = 'status' AND to_status = 'CANCELLED'
  UNION ALL
  SELECT order_id, event_id, 'ORDER_SHIPPED', recipient, 'Order Shipped - ' || order_number,
         'carrier=Standard Shipping; ' || customer || '; ' || number || '; trackingNumber=TRK-' || order_number
  FROM base WHERE via = 'status' AND to_status = 'SHIPPED'
  UNION ALL
  SELECT order_id, event_id, 'ORDER_DELIVERED', recipient, 'Order Delivered - ' || order_number,
         customer || '; ' || number
  FROM base WHERE via = 'status' AND to_status = 'DELIVERED'
  UNION ALL
  SELECT base.order_id, event_id, 'PAYMENT_CONFIRMATION', recipient, 'Payment Confirmed - ' || order_number,
         'amount=' || cast(pay.amount AS varchar) || ' USD; ' || customer || '; ' || number
           || '; paymentNumber=' || pay.payment_number
  FROM base JOIN pay ON pay.order_id = base.order_id
  WHERE via = 'status' AND to_status = 'CONFIRMED' AND pay.status = 'COMPLETED'
  UNION ALL
  SELECT base.order_id, event_id, 'PAYMENT_FAILURE', recipient, 'Payment Failed - ' || order_number,
         customer || '; ' || number || '; reason=' || coalesce(pay.failure_reason, 'Payment processing failed')
  FROM base JOIN pay ON pay.order_id = base.order_id
  WHERE via = 'status' AND to_status = 'CONFIRMED' AND pay.status = 'FAILED')"""


def _sent(select: str) -> str:
    return with_sql("", "ch", "oj", "pay").rstrip() + f",{OUTBOX}\n{select}"


LAST = """SELECT order_id, CASE WHEN accepted THEN to_status ELSE from_status END AS status
          FROM replay QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC) = 1"""
WON = f"""u AS ({UPDATES}),
won AS (SELECT u.order_id, min(update_id) AS first FROM u JOIN o ON o.id = u.order_id
        WHERE o.status = 'PENDING' AND u.target IN ('CONFIRMED', 'CANCELLED') GROUP BY u.order_id)"""


def _won(select: str, *names: str) -> str:
    return with_sql("", "ev", *names).rstrip() + f",\n{WON}\n{select}"


def _ledger(shop: Shop) -> DataFrame:
    """The movements of orders and of two halves of their events, in three batches; one is delivered twice, and
    a snapshot is taken in between."""
    moved = effects.inventory_movements(_changes(shop), shop.item_keys)
    stock = ledger.StockLedger(shop.spark, shared_folder(shop.spark, "ledger"), "bigint")
    early = F.col("event_id") % 2 == 0
    stock.commit("created", moved.where(F.col("event_id").isNull()))
    stock.commit("early", moved.where(early))
    stock.compact()
    stock.commit("late", moved.where(~early))
    stock.commit("early", moved.where(early))
    return ledger.position(stock.stock(), shop.products)


def _merged_orders(shop: Shop) -> DataFrame:
    """Orders written by month, the updated ones merged in and every 97th deleted, read again."""
    path, orders = shared_folder(shop.spark, "merged"), shop.addressed
    tables.write_table(orders, path, month_of="created_at", sort_by=("status",))
    updated = updates.apply_order_updates(orders, _updates(shop), NOW).where(F.col("updated_at") == F.lit(NOW))
    tables.merge_months(
        path, orders.schema, "created_at", updated.select(orders.columns), orders.where("id % 97 = 5").select("id"), sort_by=("status",)
    )
    return tables.read_table(shop.spark, path, orders.schema).select(orders.columns)


def _merged_items(shop: Shop) -> DataFrame:
    """Items written by the month of their order, those of every 97th order deleted, read again."""
    path, created = shared_folder(shop.spark, "merged"), shop.orders.select(F.col("id").alias("order_id"), "created_at")
    items = shop.snapshot(shop.item_keys.join(created, "order_id"))
    tables.write_table(items, path, month_of="created_at")
    gone = shop.orders.where("id % 97 = 5").select(F.col("id").alias("order_id"))
    tables.merge_months(path, items.schema, "created_at", deleted=gone, delete_by="order_id")
    return tables.read_table(shop.spark, path, items.schema).select("id", "order_id", "quantity")


NEW_JSON = "{" + ",".join(f'"{name}":"{text}"' for name, text in NEW_ADDRESS.items()) + "}"

POSITION = f""", m AS (SELECT {MOVED} AS kind, l_partkey AS product_id, cast(l_quantity AS int) AS q
                        FROM ch JOIN lineitem ON l_orderkey = order_id),
                 t AS (SELECT product_id,
                              cast(coalesce(sum(q) FILTER (kind = 'RESERVE'), 0)
                                   - coalesce(sum(q) FILTER (kind <> 'RESERVE'), 0) AS bigint) AS reserved,
                              cast(coalesce(sum(q) FILTER (kind = 'CONFIRM_SALE'), 0) AS bigint) AS sold
                       FROM m GROUP BY product_id)
                SELECT p.id AS product_id, cast(coalesce(available_quantity, 0) AS bigint) AS on_hand,
                       coalesce(reserved, 0) AS reserved, coalesce(t.sold, 0) AS sold,
                       coalesce(available_quantity, 0) - coalesce(reserved, 0) - coalesce(t.sold, 0) AS available
                FROM p LEFT JOIN t ON t.product_id = p.id"""

QUERIES: dict[str, Registered] = {
    # requests
    "price_requests": Registered(
        lambda s: requests.price_requests(_lines(s), s.products),
        with_sql(
            f""", {LINES}
               SELECT request_id, count(*) AS line_count,
                      CASE WHEN count(*) = count(p.id) THEN cast(sum(price * quantity) AS double) END AS total_amount
               FROM rq LEFT JOIN p ON p.id = rq.product_id GROUP BY request_id""",
            "rl", "p",
        ),
    ),
    "check_stock": Registered(
        lambda s: requests.check_stock(s.headers, _lines(s), s.products), _judged(VERDICT)
    ),
    "check_stock_cumulative": Registered(
        lambda s: requests.check_stock(s.headers, _lines(s), s.products, cumulative=True).select(
            "request_id", "accepted"
        ),
        with_sql(
            f""", {LINES}
               SELECT o.id AS request_id, coalesce(bool_and(ok), false) AS accepted
               FROM o LEFT JOIN (
                 SELECT request_id, coalesce(p.in_stock AND p.available_quantity >= q, false) AS ok
                 FROM (SELECT request_id, product_id, sum(quantity) AS q FROM rq GROUP BY ALL) w
                 LEFT JOIN p ON p.id = w.product_id) ON request_id = o.id
               GROUP BY o.id""",
            "o", "rl", "p",
        ),
    ),
    "check_inventory": Registered(
        lambda s: requests.check_inventory(_lines(s), s.products),
        with_sql(
            f""", {LINES}
               SELECT request_id, cast(line_no AS bigint) AS line_no, product_id, cast(quantity AS bigint) AS quantity,
                      coalesce(p.in_stock AND p.available_quantity >= quantity, false) AS sufficient
               FROM rq LEFT JOIN p ON p.id = rq.product_id""",
            "rl", "p",
        ),
    ),
    "create_orders": Registered(
        lambda s: _created(s).orders.drop("shipping_address", "billing_address"),
        _judged(
            """SELECT request_id AS id, order_number, user_id, 'PENDING' AS status, created_at,
                      created_at AS updated_at,
                      cast((SELECT sum(price * quantity) FROM judged j WHERE j.request_id = stamped.request_id)
                           AS double) AS total_amount
               FROM stamped"""
        ),
    ),
    "create_orders_items": Registered(
        lambda s: _created(s).items,
        _judged(
            """SELECT concat_ws('-', request_id, line_no, product_id) AS id, request_id AS order_id, product_id,
                      name AS product_name, sku AS product_sku, cast(quantity AS bigint) AS quantity,
                      cast(price AS double) AS unit_price, cast(price * quantity AS double) AS total_price
               FROM judged WHERE request_id IN (SELECT request_id FROM stamped)"""
        ),
    ),
    "create_orders_rejects": Registered(
        lambda s: _created(s).rejects,
        _judged(f"SELECT request_id, reject_code, outer_code, message FROM ({VERDICT}) WHERE NOT accepted"),
    ),
    "assign_order_numbers": Registered(
        _numbered,
        with_sql(
            """, taken AS (SELECT DISTINCT created_at FROM o WHERE status = 'PENDING'),
               ranked AS (
                 SELECT id, created_at, row_number() OVER (PARTITION BY created_at ORDER BY id)
                        + CASE WHEN created_at IN (SELECT created_at FROM taken) THEN 2 ELSE 0 END AS r FROM o)
               SELECT id, created_at, 'ORD-' || cast(epoch_ms(created_at) AS varchar) || '-'
                      || CASE WHEN r < 1000 THEN lpad(cast(r AS varchar), 4, '0') ELSE cast(r AS varchar) END AS order_number
               FROM ranked""",
            "o",
        ),
    ),
    # updates
    "order_update_outcomes": Registered(
        lambda s: updates.order_update_outcomes(s.orders, _updates(s)),
        _won(
            """SELECT u.order_id, u.update_id,
                      CASE WHEN o.id IS NULL THEN 'ORDER_NOT_FOUND'
                           WHEN o.status <> 'PENDING' OR u.update_id > won.first THEN 'ORDER_NOT_MODIFIABLE'
                           WHEN u.update_id = won.first THEN 'DONE' ELSE 'INVALID_STATUS_TRANSITION' END AS outcome
               FROM u LEFT JOIN o ON o.id = u.order_id LEFT JOIN won ON won.order_id = u.order_id""",
            "o",
        ),
    ),
    "apply_order_updates": Registered(
        lambda s: updates.apply_order_updates(s.addressed, _updates(s), NOW),
        _won(
            f"""SELECT oj.id, order_number, user_id, coalesce(u.target, oj.status) AS status,
                       cast(total_amount AS double) AS total_amount, created_at,
                       CASE WHEN u.target IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at,
                       CASE WHEN u.ship THEN '{NEW_JSON}' ELSE shipping_address END AS shipping_address,
                       CASE WHEN u.bill THEN '{NEW_JSON}' ELSE billing_address END AS billing_address
                FROM oj LEFT JOIN won ON won.order_id = oj.id LEFT JOIN u ON u.update_id = won.first
                  AND u.order_id = won.order_id""",
            "oj",
        ),
    ),
    "merged_orders": Registered(
        _merged_orders,
        _won(
            f"""SELECT oj.id, order_number, user_id, coalesce(u.target, oj.status) AS status,
                       cast(total_amount AS double) AS total_amount, created_at,
                       CASE WHEN u.target IS NOT NULL THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at,
                       CASE WHEN u.ship THEN '{NEW_JSON}' ELSE shipping_address END AS shipping_address,
                       CASE WHEN u.bill THEN '{NEW_JSON}' ELSE billing_address END AS billing_address
                FROM oj LEFT JOIN won ON won.order_id = oj.id LEFT JOIN u ON u.update_id = won.first
                  AND u.order_id = won.order_id
                WHERE oj.id % 97 <> 5""",
            "oj",
        ),
    ),
    "merged_items": Registered(
        _merged_items,
        with_sql("SELECT id, order_id, cast(quantity AS bigint) AS quantity FROM i WHERE order_id % 97 <> 5", "i"),
    ),
    "bulk_status_outcomes": Registered(
        lambda s: updates.bulk_status_outcomes(
            s.orders, _updates(s).select("order_id", F.lit("RETURNED").alias("new_status"))
        ),
        with_sql(
            f"""SELECT u.order_id, o.status AS current_status, 'RETURNED' AS new_status, count(*) AS requested,
                       CASE WHEN o.id IS NULL THEN 'ORDER_NOT_FOUND'
                            WHEN o.status IN ('SHIPPED', 'DELIVERED') THEN 'DONE'
                            ELSE 'INVALID_STATUS_TRANSITION' END AS outcome,
                       cast(coalesce(o.status IN ('SHIPPED', 'DELIVERED'), false) AS bigint) AS successful,
                       count(*) - cast(coalesce(o.status IN ('SHIPPED', 'DELIVERED'), false) AS bigint) AS failed
                FROM ({UPDATES}) u LEFT JOIN o ON o.id = u.order_id GROUP BY u.order_id, o.id, o.status""",
            "o", "ev",
        ),
    ),
    "bulk_status_update": Registered(
        lambda s: updates.bulk_status_update(
            s.orders, s.orders.select(F.col("id").alias("order_id"), F.lit("CANCELLED").alias("new_status"))
        ),
        with_sql(
            """SELECT count(*) AS total_requested,
                      count(*) FILTER (status IN ('PENDING', 'CONFIRMED', 'PROCESSING')) AS total_successful,
                      count(*) FILTER (status NOT IN ('PENDING', 'CONFIRMED', 'PROCESSING')) AS total_failed FROM o""",
            "o",
        ),
    ),
    "bulk_status_update_enforced": Registered(
        lambda s: updates.bulk_status_update(
            s.orders, s.orders.select(F.col("id").alias("order_id"), F.lit("RETURNED").alias("new_status")),
            enforce_final=True,
        ),
        with_sql(
            """SELECT count(*) AS total_requested, count(*) FILTER (status = 'SHIPPED') AS total_successful,
                      count(*) FILTER (status <> 'SHIPPED') AS total_failed FROM o""",
            "o",
        ),
    ),
    "cancel_orders": Registered(
        lambda s: updates.cancel_orders(s.orders, _updates(s)),
        with_sql(
            f"""SELECT DISTINCT u.order_id, o.status AS old_status,
                       CASE WHEN o.id IS NULL THEN 'ORDER_NOT_FOUND'
                            WHEN o.status IN ('PENDING', 'CONFIRMED') THEN 'DONE'
                            ELSE 'ORDER_NOT_CANCELLABLE' END AS outcome
                FROM ({UPDATES}) u LEFT JOIN o ON o.id = u.order_id""",
            "o", "ev",
        ),
    ),
    "apply_cancellations": Registered(
        lambda s: updates.apply_cancellations(s.orders, _updates(s), NOW),
        with_sql(
            f"""SELECT id, order_number, user_id, cast(total_amount AS double) AS total_amount, created_at,
                       CASE WHEN hit THEN 'CANCELLED' ELSE status END AS status,
                       CASE WHEN hit THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at
                FROM (SELECT *, status IN ('PENDING', 'CONFIRMED')
                                AND id IN (SELECT order_id FROM ({UPDATES})) AS hit FROM o)""",
            "o", "ev",
        ),
    ),
    # history
    "status_history": Registered(
        lambda s: history.status_history(s.events),
        with_sql("SELECT order_id, event_id, ts, from_status, to_status, accepted FROM replay", "replay"),
    ),
    "status_history_long": Registered(
        lambda s: history.status_history(s.events, ranges=64),
        with_sql("SELECT order_id, event_id, ts, from_status, to_status, accepted FROM replay", "replay"),
    ),
    "status_changes": Registered(
        lambda s: history.status_changes(history.status_history(s.events)),
        with_sql(
            """SELECT order_id, to_status AS status, ts AS timestamp, from_status || ' -> ' || to_status AS notes
               FROM replay WHERE accepted""",
            "replay",
        ),
    ),
    "final_states": Registered(
        lambda s: history.final_states(history.status_history(s.events)),
        with_sql(
            f"""SELECT last.*, n.accepted_events, n.rejected_events FROM ({LAST}) last
                JOIN (SELECT order_id, count(*) FILTER (accepted) AS accepted_events,
                             count(*) FILTER (NOT accepted) AS rejected_events FROM replay GROUP BY order_id) n
                  ON n.order_id = last.order_id""",
            "replay",
        ),
    ),
    # stock
    "inventory_movements": Registered(
        lambda s: effects.inventory_movements(_changes(s), s.item_keys),
        with_sql(
            f"""SELECT ch.order_id, ch.event_id, ch.ts, {MOVED} AS movement, i.id AS item_id, i.product_id,
                       cast(i.quantity AS bigint) AS quantity
                FROM ch JOIN i ON i.order_id = ch.order_id WHERE {MOVED} IS NOT NULL""",
            "ch", "i",
        ),
    ),
    "inventory_position": Registered(
        lambda s: effects.inventory_position(effects.inventory_movements(_changes(s), s.item_keys), s.products),
        with_sql(POSITION, "ch", "p"),
    ),
    "inventory_ledger": Registered(_ledger, with_sql(POSITION, "ch", "p")),
    # payments
    "payment_requests": Registered(
        lambda s: effects.payment_requests(_changes(s), s.orders),
        with_sql(
            """SELECT ch.order_id, o.user_id, cast(o.total_amount AS double) AS amount, 'USD' AS currency,
                      'CREDIT_CARD' AS payment_method, ch.ts AS requested_at
               FROM ch JOIN o ON o.id = ch.order_id WHERE via = 'status' AND to_status = 'CONFIRMED'""",
            "ch",
        ),
    ),
    "payment_outcomes": Registered(
        lambda s: effects.payment_outcomes(_confirmed(s), s.payments),
        with_sql(
            """, confirmed AS (
                 SELECT id FROM o WHERE status = 'CONFIRMED'
                 UNION ALL SELECT -id FROM o WHERE status = 'CONFIRMED' AND id % 7 = 0)
               SELECT c.id AS order_id, pay.payment_number,
                      CASE pay.status WHEN 'COMPLETED' THEN 'PAID' WHEN 'FAILED' THEN 'FAILED'
                           ELSE CASE WHEN pay.id IS NULL THEN 'UNAVAILABLE' ELSE 'OTHER' END END AS outcome,
                      pay.id IS NULL OR pay.status = 'FAILED' AS payment_failed, 'CONFIRMED' AS final_status,
                      pay.failure_reason
               FROM confirmed c LEFT JOIN pay ON pay.order_id = c.id""",
            "pay",
        ),
    ),
    "refund_requests": Registered(
        lambda s: effects.refund_requests(s.payments, "Order returned"),
        with_sql(
            "SELECT id AS payment_id, cast(amount AS double) AS amount, 'Order returned' AS reason FROM pay", "pay"
        ),
    ),
    # notifications
    "notification_outbox": Registered(
        lambda s: _outbox(s).withColumn("variables", _readable()), _sent("SELECT * FROM sent")
    ),
    "enrich_notifications": Registered(
        lambda s: effects.enrich_notifications(_outbox(s)).drop("variables"),
        _sent(
            """SELECT order_id, event_id, type, recipient, subject,
                      CASE WHEN type IN ('PAYMENT_FAILURE', 'ORDER_CANCELLATION') THEN 'HIGH'
                           WHEN type LIKE '%CONFIRMATION' THEN 'MEDIUM' ELSE 'NORMAL' END AS priority,
                      type IN ('PAYMENT_FAILURE', 'ORDER_CANCELLATION') OR type LIKE '%CONFIRMATION' AS is_immediate,
                      true AS is_email, false AS is_sms FROM sent"""
        ),
    ),
    "low_inventory_alerts": Registered(
        lambda s: effects.low_inventory_alerts(s.products, 10).withColumn("variables", _readable()),
        with_sql(
            """SELECT 'LOW_INVENTORY_ALERT' AS type, 'admin@ecommerce.com' AS recipient,
                      'Low Inventory Alert - ' || name AS subject,
                      'currentStock=' || cast(coalesce(available_quantity, 0) AS varchar) || '; productName=' || name
                        || '; productSku=' || sku || '; threshold=10' AS variables
               FROM p WHERE coalesce(available_quantity, 0) < 10""",
            "p",
        ),
    ),
}
