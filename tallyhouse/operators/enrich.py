"""Derived columns, one job per table. Everything is a built-in expression over the row, or over
per-order aggregates that combine before the shuffle."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import address, money
from tallyhouse.functions import status as st

# Display names.
PAYMENT_STATUS_NAMES = {
    "PENDING": "Pending", "PROCESSING": "Processing", "COMPLETED": "Completed",
    "FAILED": "Failed", "CANCELLED": "Cancelled", "REFUNDED": "Refunded",
}
PAYMENT_METHOD_NAMES = {
    "CREDIT_CARD": "Credit Card", "DEBIT_CARD": "Debit Card", "PAYPAL": "PayPal",
    "STRIPE": "Stripe", "BANK_TRANSFER": "Bank Transfer", "DIGITAL_WALLET": "Digital Wallet",
}
UNKNOWN_PRODUCT = "Unknown Product"
NOT_AVAILABLE = "N/A"

DAY_MICROS = 86_400_000_000


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _address(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return address.parse(column) if isinstance(df.schema[name].dataType, T.StringType) else column


def whole_days(since: Column, as_of: datetime) -> Column:
    """Complete 24-hour periods between ``since`` and ``as_of``, truncated toward zero."""
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    day = F.lit(DAY_MICROS)
    return ((micros - micros % day) / day).cast("bigint")


def _display_name(name: Column, sku: Column) -> Column:
    with_sku = F.concat(name, F.lit(" ("), sku, F.lit(")"))
    return F.coalesce(with_sku, name, sku, F.lit(UNKNOWN_PRODUCT))


def enrich_orders(
    orders: DataFrame, items: DataFrame, as_of: datetime, threshold: Decimal, max_days: int,
    product: object | None = None,
) -> DataFrame:
    """State flags, age, address comparison and item figures of every order.

    ``product`` adds whether the order contains that product.
    """
    value = F.sum("total_price")
    figures = [
        F.count("*").alias("_lines"),
        F.sum("quantity").alias("_quantity"),
        F.round(value.cast("decimal(20,2)") / F.count("*").cast("decimal(20,0)"), 2).alias("_mean"),
    ]
    if product is not None:
        figures.append(F.max(F.col("product_id") == product).alias("_contains"))
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(*figures)

    state = F.col("status")
    columns = {
        "is_final": st.is_final(state),
        "can_cancel": st.can_cancel(state),
        "can_modify": st.can_modify(state),
        "is_active": st.is_active(state),
        "next_statuses": st.next_statuses(state),
        "total_quantity": F.coalesce("_quantity", F.lit(0)),
        "distinct_items": F.coalesce("_lines", F.lit(0)),
        "avg_item_value": F.coalesce(F.col("_mean").cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")),
        "is_high_value": _true(F.col("total_amount") >= threshold),
        "age_days": F.coalesce(whole_days(F.col("created_at"), as_of), F.lit(0)),
        "is_overdue": _true(whole_days(F.col("updated_at"), as_of) > max_days),
    }
    if product is not None:
        columns["contains_product"] = _true(F.col("_contains"))
    if "shipping_address" in orders.columns:
        columns["same_address"] = address.same(
            _address(orders, "shipping_address"), _address(orders, "billing_address")
        )
    return orders.join(per_order, "id", "left").withColumns(columns).select(*orders.columns, *columns)


def enrich_items(
    items: DataFrame, orders: DataFrame, products: DataFrame, bulk_quantity: int, high_value: Decimal
) -> DataFrame:
    """Checks, discount against the catalogue price and share of the order total for every item."""
    totals = orders.select(F.col("id").alias("order_id"), F.col("total_amount").alias("_order_total"))
    catalogue = products.select(F.col("id").alias("product_id"), F.col("price").alias("_list_price"))
    quantity, unit, total = F.col("quantity"), F.col("unit_price"), F.col("total_price")
    list_price = F.col("_list_price")
    expected = money.line_total(unit, quantity)
    reduced = list_price > unit
    nothing = F.lit(0).cast("decimal(20,2)")
    columns = {
        "calculated_total": F.coalesce(expected, nothing),
        "valid_quantity": _true(quantity > 0),
        "valid_unit_price": _true(unit > 0),
        "valid_pricing": _true((unit > 0) & (total > 0)),
        "total_price_correct": _true(expected == total),
        "discount_amount": F.when(reduced, money.line_total(list_price - unit, quantity)).otherwise(nothing),
        "discount_pct": F.when(reduced, money.percent(list_price - unit, list_price)).otherwise(nothing),
        "is_bulk": _true(quantity >= bulk_quantity),
        "is_high_value": _true(total >= high_value),
        "average_price_per_unit": unit,
        "contribution_pct": money.percent(total, F.col("_order_total")),
        "display_name": _display_name(F.col("product_name"), F.col("product_sku")),
        "complete_product_info": F.col("product_id").isNotNull()
        & address.filled(F.col("product_name")) & address.filled(F.col("product_sku")),
    }
    return (
        items.join(totals, "order_id", "left")
        .join(catalogue, "product_id", "left")
        .withColumns(columns)
        .select(*items.columns, *columns)
    )


def is_for_product(product: object) -> Column:
    """Whether an item is of the product; an item without one is of none."""
    return F.coalesce(F.col("product_id") == product, F.lit(False))


def enrich_addresses(df: DataFrame, column: str, home: str) -> DataFrame:
    """Printed forms and checks of one address column (struct or JSON text)."""
    a = _address(df, column)
    return df.withColumns(
        {
            "full_address": address.full_address(a),
            "formatted_address": address.formatted_address(a),
            "is_domestic": address.is_domestic(a, home),
            "is_international": ~address.is_domestic(a, home),
            "has_secondary_line": address.has_secondary_line(a),
            "city_state": address.city_state(a),
            "state_postal": address.state_postal(a),
            "is_complete": address.is_complete(a),
            "valid_postal": address.is_valid_postal(a),
            "address_summary": address.summary(a),
            "normalized_postal": address.normalized_postal(a),
            "normalized": address.normalize(a),
        }
    )


def enrich_products(products: DataFrame, quantity: int) -> DataFrame:
    """Stock flags and the price of ``quantity`` pieces."""
    stock, price, wanted = F.col("available_quantity"), F.col("price"), F.lit(quantity)
    in_stock = _true(F.col("in_stock"))
    return products.withColumns(
        {
            "is_in_stock": in_stock,
            "safe_quantity": F.coalesce(stock, F.lit(0)),
            "is_available": in_stock & _true(stock >= wanted),
            "line_total": F.when(price.isNotNull() & (wanted > 0), money.line_total(price, wanted))
            .otherwise(F.lit(0).cast("decimal(20,2)")),
            "display_name": _display_name(F.col("name"), F.col("sku")),
            "is_complete": F.col("id").isNotNull() & F.col("name").isNotNull()
            & F.col("sku").isNotNull() & price.isNotNull(),
        }
    )


def formatted_amount(amount: Column, currency: Column) -> Column:
    text = F.format_string("%s %s", F.round(amount, 2).cast("decimal(20,2)").cast("string"), currency)
    return F.when(amount.isNotNull() & currency.isNotNull(), text).otherwise(NOT_AVAILABLE)


def _named(value: Column, names: dict[str, str]) -> Column:
    shown = value
    for key, name in names.items():
        shown = F.when(value == key, name).otherwise(shown)
    return shown


def enrich_payments(payments: DataFrame) -> DataFrame:
    state = F.col("status")
    return payments.withColumns(
        {
            "is_completed": _true(state == "COMPLETED"),
            "is_pending": _true(state.isin("PENDING", "PROCESSING")),
            "is_failed": _true(state == "FAILED"),
            "is_cancelled": _true(state == "CANCELLED"),
            "is_refunded": _true(state == "REFUNDED"),
            "is_final": _true(state.isin("COMPLETED", "FAILED", "CANCELLED", "REFUNDED")),
            "formatted_amount": formatted_amount(F.col("amount"), F.col("currency")),
            "status_name": _named(state, PAYMENT_STATUS_NAMES),
            "method_name": _named(F.col("payment_method"), PAYMENT_METHOD_NAMES),
            "has_gateway_id": address.filled(F.col("gateway_transaction_id")),
            "has_failure_reason": address.filled(F.col("failure_reason")),
        }
    )


def enrich_request_lines(lines: DataFrame, bulk_quantity: int) -> DataFrame:
    quantity = F.col("quantity")
    return lines.withColumns(
        {
            "is_valid": F.col("product_id").isNotNull() & _true(quantity > 0),
            "is_bulk": _true(quantity >= bulk_quantity),
        }
    )


def enrich_requests(headers: DataFrame, lines: DataFrame, product: object | None = None) -> DataFrame:
    """Per request: total quantity, lines, whether both addresses are equal, and whether it holds a product."""
    figures = [F.count("*").alias("_lines"), F.sum("quantity").alias("_quantity")]
    if product is not None:
        figures.append(F.max(F.col("product_id") == product).alias("_contains"))
    columns = {
        "line_count": F.coalesce("_lines", F.lit(0)),
        "total_quantity": F.coalesce("_quantity", F.lit(0)),
        "same_address": address.same(F.col("shipping_address"), F.col("billing_address")),
    }
    if product is not None:
        columns["contains_product"] = _true(F.col("_contains"))
    per_request = lines.groupBy("request_id").agg(*figures)
    return headers.join(per_request, "request_id", "left").withColumns(columns).select(*headers.columns, *columns)


def enrich_updates(updates: DataFrame, orders: DataFrame) -> DataFrame:
    """What an update touches, and whether its move is allowed from the order's present state."""
    present = orders.select(F.col("id").alias("order_id"), F.col("status").alias("current_status"))
    shipping, billing = F.col("shipping_address").isNotNull(), F.col("billing_address").isNotNull()
    return updates.join(present, "order_id", "left").withColumns(
        {
            "is_status_only": ~shipping & ~billing,
            "is_address_update": shipping | billing,
            "is_shipping_update": shipping,
            "is_billing_update": billing,
            "is_valid_move": st.is_move(F.col("current_status"), F.col("status")),
            "modifies_final": st.is_final(F.col("current_status")),
        }
    )
