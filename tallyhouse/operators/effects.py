"""What follows from order changes: stock movements, payments, notifications.

``changes`` is one row per change of an order: order_id, event_id, ts, from_status, to_status and
``via``: ``create`` (from_status null), ``status`` for a status change, ``cancel`` for the
cancellation route, which changes the state and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import address
from tallyhouse.operators import ledger
from tallyhouse.operators.enrich import formatted_amount

# Payment defaults, notification types with subject and priority, default texts.
CURRENCY = "USD"
PAYMENT_METHOD = "CREDIT_CARD"
SUBJECTS = {
    "ORDER_CONFIRMATION": "Order Confirmation - ",
    "ORDER_STATUS_UPDATE": "Order Status Update - ",
    "ORDER_CANCELLATION": "Order Cancelled - ",
    "PAYMENT_CONFIRMATION": "Payment Confirmed - ",
    "PAYMENT_FAILURE": "Payment Failed - ",
    "ORDER_SHIPPED": "Order Shipped - ",
    "ORDER_DELIVERED": "Order Delivered - ",
    "LOW_INVENTORY_ALERT": "Low Inventory Alert - ",
}
PRIORITIES = {
    "HIGH": ("PAYMENT_FAILURE", "ORDER_CANCELLATION"),
    "MEDIUM": ("ORDER_CONFIRMATION", "PAYMENT_CONFIRMATION"),
    "NORMAL": ("ORDER_STATUS_UPDATE", "ORDER_SHIPPED", "ORDER_DELIVERED"),
    "LOW": ("LOW_INVENTORY_ALERT",),
}
CANCELLATION_REASON = "Order cancelled by customer request"
PAYMENT_FAILURE_REASON = "Payment processing failed"
CARRIER = "Standard Shipping"
TRACKING_PREFIX = "TRK-"
ADMIN = "admin@ecommerce.com"
PHONE = r"^\+?[1-9]\d{1,14}$"

RELEASABLE = ("PENDING", "CONFIRMED", "PROCESSING")


def changes_from(orders: DataFrame, history: DataFrame) -> DataFrame:
    """The creation of every order and the accepted events of its history."""
    none = F.lit(None)
    created = orders.select(
        F.col("id").alias("order_id"), none.cast("bigint").alias("event_id"),
        F.col("created_at").cast("timestamp").alias("ts"), none.cast("string").alias("from_status"),
        F.lit("PENDING").alias("to_status"), F.lit("create").alias("via"),
    )
    moved = history.where("accepted").select(
        "order_id", "event_id", "ts", "from_status", "to_status", F.lit("status").alias("via")
    )
    return created.unionByName(moved)


# --- stock -------------------------------------------------------------------------------------


def _movement() -> Column:
    by_status = F.col("via") == "status"
    released = (F.col("to_status") == "CANCELLED") & F.col("from_status").isin(*RELEASABLE)
    return (
        F.when(F.col("via") == "create", "RESERVE")
        .when(by_status & (F.col("to_status") == "SHIPPED"), "CONFIRM_SALE")
        .when(by_status & released, "RELEASE")
    )


def inventory_movements(changes: DataFrame, items: DataFrame) -> DataFrame:
    """One movement per item for every change that touches stock."""
    moving = changes.select("order_id", "event_id", "ts", _movement().alias("movement"))
    lines = items.select("order_id", F.col("id").alias("item_id"), "product_id", "quantity")
    return moving.where(F.col("movement").isNotNull()).join(lines, "order_id")


def inventory_position(movements: DataFrame, products: DataFrame) -> DataFrame:
    """Reserved, sold and available quantity of every product after the movements. Where movements come in
    batches, ``StockLedger`` keeps what this adds up."""
    return ledger.position(ledger.signed(movements), products)


# --- payments ----------------------------------------------------------------------------------


def _entering(changes: DataFrame, status: str) -> DataFrame:
    return changes.where((F.col("via") == "status") & (F.col("to_status") == status))


def payment_requests(changes: DataFrame, orders: DataFrame) -> DataFrame:
    """One payment request per order entering CONFIRMED."""
    parents = orders.select(F.col("id").alias("order_id"), "user_id", F.col("total_amount").alias("amount"))
    return _entering(changes, "CONFIRMED").select("order_id", "ts").join(parents, "order_id").select(
        "order_id", "user_id", "amount", F.lit(CURRENCY).alias("currency"),
        F.lit(PAYMENT_METHOD).alias("payment_method"), F.col("ts").alias("requested_at"),
    )


def payment_outcomes(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """What the payment of each confirmed order came to.

    A failed payment sets the order back to PENDING, but the confirmation that started it is saved
    last: the state stays CONFIRMED and ``payment_failed`` tells. No answer counts as failed.
    """
    answers = payments.select(
        "order_id", F.col("payment_number"), F.col("status").alias("_payment"), "failure_reason"
    )
    outcome = (
        F.when(F.col("_payment").isNull(), "UNAVAILABLE")
        .when(F.col("_payment") == "COMPLETED", "PAID")
        .when(F.col("_payment") == "FAILED", "FAILED")
        .otherwise("OTHER")
    )
    return orders.select(F.col("id").alias("order_id")).join(answers, "order_id", "left").select(
        "order_id", "payment_number", outcome.alias("outcome"),
        outcome.isin("FAILED", "UNAVAILABLE").alias("payment_failed"),
        F.lit("CONFIRMED").alias("final_status"), "failure_reason",
    )


def refund_requests(payments: DataFrame, reason: str) -> DataFrame:
    return payments.select(F.col("id").alias("payment_id"), "amount", F.lit(reason).alias("reason"))


# --- notifications -----------------------------------------------------------------------------


def _variables(**values: Column) -> Column:
    entries = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*entries)


def notification_outbox(changes: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """The messages every change gives rise to.

    ``orders`` carries ``item_count`` and both addresses as JSON text. Creation gives a confirmation;
    a status change gives an update, and by its target also a payment, shipping, delivery or
    cancellation message; the cancellation route gives none.
    """
    parents = orders.select(
        F.col("id").alias("order_id"), "order_number", "user_id", "total_amount", "item_count",
        "shipping_address", "billing_address",
    )
    paid = payments.select(
        "order_id", F.lit("CONFIRMED").alias("to_status"), "payment_number", "amount", "currency",
        F.col("status").alias("payment_status"), "failure_reason",
    )
    rows = (
        changes.where(F.col("via") != "cancel")
        .join(parents, "order_id")
        .join(paid, ["order_id", "to_status"], "left")
    )
    user, number, target = F.col("user_id").cast("string"), F.col("order_number"), F.col("to_status")
    created, moved = F.col("via") == "create", F.col("via") == "status"
    common = {"customerName": F.concat(F.lit("Customer "), user), "orderNumber": number}
    details = F.to_json(
        F.struct(
            F.col("total_amount").cast("string").alias("totalAmount"), F.col("item_count").alias("itemCount"),
            F.col("shipping_address").alias("shippingAddress"), F.col("billing_address").alias("billingAddress"),
        )
    )
    failed = (target == "CONFIRMED") & (
        F.col("payment_status").isNull() | (F.col("payment_status") == "FAILED")
    )

    def message(when: Column, kind: str, **values: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("type"),
                F.concat(F.lit(SUBJECTS[kind]), number).alias("subject"),
                _variables(**common, **values).alias("variables"),
            ),
        )

    messages = F.array(
        message(created, "ORDER_CONFIRMATION", orderDetails=details),
        message(moved, "ORDER_STATUS_UPDATE", oldStatus=F.col("from_status"), newStatus=target),
        message(moved & (target == "CANCELLED"), "ORDER_CANCELLATION", reason=F.lit(CANCELLATION_REASON)),
        message(
            moved & (target == "CONFIRMED") & (F.col("payment_status") == "COMPLETED"), "PAYMENT_CONFIRMATION",
            paymentNumber=F.col("payment_number"), amount=formatted_amount(F.col("amount"), F.col("currency")),
        ),
        message(
            moved & failed, "PAYMENT_FAILURE",
            reason=F.coalesce("failure_reason", F.lit(PAYMENT_FAILURE_REASON)),
        ),
        message(
            moved & (target == "SHIPPED"), "ORDER_SHIPPED",
            trackingNumber=F.concat(F.lit(TRACKING_PREFIX), number), carrier=F.lit(CARRIER),
        ),
        message(moved & (target == "DELIVERED"), "ORDER_DELIVERED"),
    )
    sent = rows.select(
        "order_id", "event_id",
        F.concat(F.lit("user-"), user, F.lit("@example.com")).alias("recipient"),
        F.explode(F.filter(messages, lambda m: m.isNotNull())).alias("m"),
    )
    return sent.select("order_id", "event_id", "m.type", "recipient", "m.subject", "m.variables")


def low_inventory_alerts(products: DataFrame, threshold: int) -> DataFrame:
    """An alert to the administrator for every product whose stock is below the threshold."""
    stock = F.coalesce("available_quantity", F.lit(0))
    kind = "LOW_INVENTORY_ALERT"
    return products.where(stock < threshold).select(
        F.lit(kind).alias("type"),
        F.lit(ADMIN).alias("recipient"),
        F.concat(F.lit(SUBJECTS[kind]), F.col("name")).alias("subject"),
        _variables(
            productName=F.col("name"), productSku=F.col("sku"), currentStock=stock, threshold=F.lit(threshold)
        ).alias("variables"),
    )


def enrich_notifications(notifications: DataFrame) -> DataFrame:
    """Priority by type (NORMAL for others), urgency and channel."""
    priority = F.lit("NORMAL")
    for level, kinds in PRIORITIES.items():
        priority = F.when(F.col("type").isin(*kinds), level).otherwise(priority)
    recipient = F.col("recipient")
    return notifications.withColumn("priority", priority).withColumns(
        {
            "is_immediate": F.col("priority").isin("HIGH", "MEDIUM"),
            "is_email": F.coalesce(recipient.contains("@"), F.lit(False)),
            "is_sms": F.coalesce(address.matches(recipient, PHONE), F.lit(False)),
        }
    )
