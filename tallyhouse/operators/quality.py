"""Data quality: one row per broken rule, and the reconciliation of order totals."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import address, money
from tallyhouse.functions import status as st
from tallyhouse.schema import MONEY


def _violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule whose condition holds on a row; null counts as not broken.

    Rows that break no rule, as a rule nearly all, are filtered out before any list is built.
    """
    any_broken = reduce(or_, (F.coalesce(condition, F.lit(False)) for condition in rules.values()))
    broken = F.array_compact(F.array(*(F.when(condition, name) for name, condition in rules.items())))
    return df.where(any_broken).select(*keys, F.explode(broken).alias("rule"))


def _missing(*names: str) -> dict[str, Column]:
    return {f"{name}_missing": F.col(name).isNull() for name in names}


def _too_long(**limits: int) -> dict[str, Column]:
    return {f"{name}_too_long": F.length(name) > limit for name, limit in limits.items()}


def dq_orders(orders: DataFrame) -> DataFrame:
    required = [name for name in orders.columns if name != "id"]
    rules = {
        **_missing(*required),
        **_too_long(order_number=50, status=20),
        "status_unknown": ~F.col("status").isin(*st.STORED),
        "total_amount_negative": F.col("total_amount") < 0,
    }
    return _violations(orders, ["id"], rules)


def dq_items(items: DataFrame) -> DataFrame:
    required = [name for name in items.columns if name != "id"]
    rules = {
        **_missing(*required),
        **_too_long(product_name=255, product_sku=100),
        "quantity_not_positive": F.col("quantity") <= 0,
        "unit_price_negative": F.col("unit_price") < 0,
        "total_price_negative": F.col("total_price") < 0,
        "total_price_wrong": F.col("total_price") != money.line_total(F.col("unit_price"), F.col("quantity")),
    }
    return _violations(items, ["id", "order_id"], rules)


def dq_duplicate_numbers(orders: DataFrame) -> DataFrame:
    per_number = orders.groupBy("order_number").agg(F.count("*").alias("uses"))
    return per_number.where((F.col("uses") > 1) & F.col("order_number").isNotNull())


def dq_orphan_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items whose order does not exist."""
    known = orders.select(F.col("id").alias("order_id"))
    return items.join(known, "order_id", "left_anti").select(*items.columns)


def _address_rules(a: Column, prefix: str = "") -> dict[str, Column]:
    rules = {f"{prefix}{name}_blank": ~address.filled(a[name]) for name in address.REQUIRED}
    for name, limit in address.MAX_LENGTHS.items():
        rules[f"{prefix}{name}_too_long"] = F.length(a[name]) > limit
    rules[f"{prefix}postalCode_characters"] = ~address.matches(a["postalCode"], address.POSTAL_CHARACTERS)
    return rules


def dq_addresses(df: DataFrame, column: str, key: str) -> DataFrame:
    """Broken rules of one address column (struct); an absent address breaks none here."""
    return _violations(df.where(F.col(column).isNotNull()), [key], _address_rules(F.col(column)))


def dq_requests(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(request_id, line_no, rule): request rules carry no line number."""
    rules: dict[str, Column] = {"items_missing": F.col("_lines").isNull()}
    for side in ("shipping", "billing"):
        column = F.col(f"{side}_address")
        rules[f"{side}_missing"] = column.isNull()
        for name, condition in _address_rules(column, f"{side}_").items():
            rules[name] = column.isNotNull() & condition
    counts = lines.groupBy("request_id").agg(F.count("*").alias("_lines"))
    whole = _violations(headers.join(counts, "request_id", "left"), ["request_id"], rules)
    per_line = _violations(
        lines, ["request_id", "line_no"],
        {
            "product_missing": F.col("product_id").isNull(),
            "quantity_missing": F.col("quantity").isNull(),
            "quantity_below_one": F.col("quantity") < 1,
        },
    )
    no_line = F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no")
    return whole.select("request_id", no_line, "rule").unionByName(per_line)


def reconcile_totals(orders: DataFrame, items: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Stored total against the sum of the items, per order.

    ``action`` is KEEP where they agree, UPDATE where the stored total is to be replaced, and REFUSE
    where it differs but the order is in a final state or no stored total can hold the sum. ``touched`` (order_id) limits the check to
    orders whose items changed.
    """
    if touched is not None:
        ids = touched.select(F.col("order_id").alias("id"))
        orders = orders.join(ids, "id", "left_semi")
        items = items.join(touched.select("order_id"), "order_id", "left_semi")
    sums = items.groupBy(F.col("order_id").alias("id")).agg(F.sum("total_price").alias("_sum"))
    new_total = F.coalesce("_sum", F.lit(0))
    storable = new_total.try_cast(MONEY).isNotNull()
    action = (
        F.when(F.col("total_amount") == new_total, "KEEP")
        .when(st.is_final(F.col("status")) | ~storable, "REFUSE")
        .otherwise("UPDATE")
    )
    return orders.join(sums, "id", "left").select(
        "id", "status", F.col("total_amount").alias("old_total"), new_total.alias("new_total"),
        action.alias("action"),
    )


def apply_reconciled(orders: DataFrame, reconciled: DataFrame, now: datetime) -> DataFrame:
    """Orders with the replaced totals; an order that changes is stamped with ``now``."""
    updates = reconciled.where(F.col("action") == "UPDATE").select("id", F.col("new_total").alias("_new"))
    changed = F.col("_new").isNotNull()
    total = F.coalesce("_new", "total_amount").try_cast(orders.schema["total_amount"].dataType)
    stamp = F.lit(now).cast(orders.schema["updated_at"].dataType)
    return (
        orders.join(updates, "id", "left")
        .withColumns(
            {"total_amount": total, "updated_at": F.when(changed, stamp).otherwise(F.col("updated_at"))}
        )
        .select(*orders.columns)
    )
