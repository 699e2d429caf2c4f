"""Batches of changes to orders: general updates, bulk status changes, cancellations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import address
from tallyhouse.functions import status as st

# Outcome codes of a refused change.
NOT_MODIFIABLE = "ORDER_NOT_MODIFIABLE"
INVALID_MOVE = "INVALID_STATUS_TRANSITION"
NOT_CANCELLABLE = "ORDER_NOT_CANCELLABLE"
# Ours
NOT_FOUND = "ORDER_NOT_FOUND"
CONFLICT = "CONFLICTING_STATUSES"
DONE = "DONE"


def _present(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("id").alias("order_id"), F.col("status").alias("current_status"))


def order_update_outcomes(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """(order_id, update_id, outcome) for a batch of updates, applied in the order of ``update_id``.

    Only a pending order can be updated and only with an allowed move, which takes it out of pending:
    of several updates of one order the first allowed one wins and later ones find it not modifiable.
    An ``update_id`` occurs once per order.
    """
    faced = updates.select("order_id", "update_id", F.col("status").alias("target")).join(
        _present(orders), "order_id", "left"
    )
    modifiable = st.can_modify(F.col("current_status"))
    allowed = modifiable & st.is_move(F.col("current_status"), F.col("target"))
    first = faced.where(allowed).groupBy("order_id").agg(F.min("update_id").alias("_first"))
    late = F.coalesce(F.col("update_id") > F.col("_first"), F.lit(False))
    outcome = (
        F.when(F.col("current_status").isNull(), NOT_FOUND)
        .when(~modifiable | late, NOT_MODIFIABLE)
        .when(F.col("update_id") == F.col("_first"), DONE)
        .otherwise(INVALID_MOVE)
    )
    return faced.join(first, "order_id", "left").select("order_id", "update_id", outcome.alias("outcome"))


def apply_order_updates(orders: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """All orders after the batch: new state, new addresses where given, ``updated_at`` set to now.

    ``updates`` holds order_id, update_id, status and two address structs; a null address keeps the
    stored one.
    """
    winners = order_update_outcomes(orders, updates).where(F.col("outcome") == DONE)
    changes = updates.join(winners, ["order_id", "update_id"], "left_semi").select(
        F.col("order_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("shipping_address").alias("_shipping"),
        F.col("billing_address").alias("_billing"),
    )

    def stored(column: str, change: str) -> Column:
        new = F.col(change)
        if isinstance(orders.schema[column].dataType, T.StringType):
            new = address.render(new)
        return F.coalesce(new, F.col(column))

    stamp = F.lit(now).cast(orders.schema["updated_at"].dataType)
    return (
        orders.join(changes, "id", "left")
        .withColumns(
            {
                "shipping_address": stored("shipping_address", "_shipping"),
                "billing_address": stored("billing_address", "_billing"),
                "updated_at": F.when(F.col("_status").isNotNull(), stamp).otherwise(F.col("updated_at")),
                "status": F.coalesce("_status", "status"),
            }
        )
        .select(*orders.columns)
    )


def bulk_status_outcomes(orders: DataFrame, wanted: DataFrame, enforce_final: bool = False) -> DataFrame:
    """Per order and new status: how often it was asked for and how often it was done.

    ``wanted`` (order_id, new_status) gives one new status per order. No state moves to itself, so of
    repeated entries the first can succeed and the others fail. Entries that give one order different
    statuses contradict each other and all fail: a batch has no order; one that has is a ``status_history``.
    """
    asked = wanted.groupBy("order_id", "new_status").agg(F.count("*").alias("requested")).withColumn(
        "_statuses", F.count("*").over(Window.partitionBy("order_id"))
    )
    alone = F.col("_statuses") == 1
    allowed = alone & st.is_move(F.col("current_status"), F.col("new_status"), enforce_final)
    outcome = (
        F.when(F.col("current_status").isNull(), NOT_FOUND).when(~alone, CONFLICT).when(allowed, DONE).otherwise(INVALID_MOVE)
    )
    done = F.when(allowed, 1).otherwise(0).cast("bigint")
    return asked.join(_present(orders), "order_id", "left").select(
        "order_id", "current_status", "new_status", outcome.alias("outcome"), "requested",
        done.alias("successful"), (F.col("requested") - done).alias("failed"),
    )


def bulk_status_update(orders: DataFrame, wanted: DataFrame, enforce_final: bool = False) -> DataFrame:
    """Requested, successful and failed entries of the batch."""
    outcomes = bulk_status_outcomes(orders, wanted, enforce_final)
    return outcomes.agg(
        *(F.coalesce(F.sum(name), F.lit(0)).alias(f"total_{name}") for name in ("requested", "successful", "failed"))
    )


def cancel_orders(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """(order_id, old_status, outcome) for every distinct order to cancel; stock is not released here."""
    outcome = (
        F.when(F.col("current_status").isNull(), NOT_FOUND)
        .when(st.can_cancel(F.col("current_status")), DONE)
        .otherwise(NOT_CANCELLABLE)
    )
    return (
        keys.select("order_id").distinct()
        .join(_present(orders), "order_id", "left")
        .select("order_id", F.col("current_status").alias("old_status"), outcome.alias("outcome"))
    )


def apply_cancellations(orders: DataFrame, keys: DataFrame, now: datetime) -> DataFrame:
    """All orders after the cancellations."""
    hit = keys.select(F.col("order_id").alias("id"), F.lit(True).alias("_hit")).distinct()
    cancelled = F.col("_hit").isNotNull() & st.can_cancel(F.col("status"))
    stamp = F.lit(now).cast(orders.schema["updated_at"].dataType)
    return (
        orders.join(hit, "id", "left")
        .withColumns(
            {
                "updated_at": F.when(cancelled, stamp).otherwise(F.col("updated_at")),
                "status": F.when(cancelled, "CANCELLED").otherwise(F.col("status")),
            }
        )
        .select(*orders.columns)
    )
