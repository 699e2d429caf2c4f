"""From order requests to orders: stock check, pricing, order numbers.

A batch of requests is two tables, ``headers`` (request_id, user_id, both address structs,
requested_at) and ``lines`` (request_id, line_no, product_id, quantity).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import address, money
from tallyhouse.schema import MONEY

# Rejection codes and texts, and the number prefix.
EMPTY_ORDER = "EMPTY_ORDER"
PRODUCT_NOT_FOUND = "PRODUCT_NOT_FOUND"
OUT_OF_STOCK = "PRODUCT_OUT_OF_STOCK"
INSUFFICIENT = "INSUFFICIENT_INVENTORY"
VALIDATION_FAILED = "PRODUCT_VALIDATION_FAILED"
CREATION_FAILED = "ORDER_CREATION_FAILED"
EMPTY_ORDER_TEXT = "Order must contain at least one item"
NOT_FOUND_TEXT = "Product not found: %s"
OUT_OF_STOCK_TEXT = "Product is out of stock: %s"
INSUFFICIENT_TEXT = "Insufficient inventory for product %s. Requested: %d, Available: %d"
NUMBER_PREFIX = "ORD"

# Ours: what the storage constraints refuse, and a request without a time to number it by.
INVALID_QUANTITY = "QUANTITY_NOT_POSITIVE"
NOT_PRICEABLE = "TOTAL_NOT_PRICEABLE"
NO_TIME = "REQUEST_TIME_MISSING"
NO_TIME_TEXT = "The request has no time, so it cannot get an order number"

ORDERS_PER_RANGE = 10_000


def explode_requests(requests: DataFrame) -> DataFrame:
    """Lines of requests that carry their items as an array."""
    return requests.select("request_id", F.posexplode("items").alias("line_no", "item")).select(
        "request_id", "line_no", "item.product_id", "item.quantity"
    )


def _with_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    catalogue = products.select(
        F.col("id").alias("product_id"), "name", "sku", "price", "in_stock", "available_quantity",
        F.lit(True).alias("known"),
    )
    return lines.join(catalogue, "product_id", "left")


def _line_reject(known: Column) -> Column:
    """The reason a line cannot be served, or null.

    All products are looked up before any stock is checked, so an unknown product on any line comes
    before a stock problem on an earlier one: that is the ``phase``.
    """
    in_stock = F.coalesce("in_stock", F.lit(False))
    enough = F.coalesce(F.col("available_quantity") >= F.col("quantity"), F.lit(False))
    code = (
        F.when(known.isNull(), PRODUCT_NOT_FOUND).when(~in_stock, OUT_OF_STOCK).when(~enough, INSUFFICIENT)
    )
    return F.when(
        code.isNotNull(),
        F.struct(
            F.when(known.isNull(), 1).otherwise(2).alias("phase"), "line_no", code.alias("code"),
            F.col("product_id").cast("string").alias("product_id"), "name", "quantity",
            F.coalesce("available_quantity", F.lit(0)).alias("stock"),
        ),
    )


def _message(code: Column, reject: Column) -> Column:
    """The text of a rejection, worded once per request."""
    return (
        F.when(code == EMPTY_ORDER, EMPTY_ORDER_TEXT)
        .when(code == PRODUCT_NOT_FOUND, F.format_string(NOT_FOUND_TEXT, reject["product_id"]))
        .when(code == OUT_OF_STOCK, F.format_string(OUT_OF_STOCK_TEXT, reject["name"]))
        .when(
            code == INSUFFICIENT,
            F.format_string(INSUFFICIENT_TEXT, reject["name"], reject["quantity"], reject["stock"]),
        )
    )


def assess_requests(headers: DataFrame, lines: DataFrame, products: DataFrame, cumulative: bool = False) -> DataFrame:
    """One row per request: line count, total, and the first reason against it in checking order.

    Each line is held against the same stock figure; ``cumulative`` adds up the lines of one product
    within a request first.
    """
    wanted = lines.select(
        "request_id", "line_no", "product_id", "quantity",
        F.lit(1).cast("bigint").alias("_lines"), (F.col("quantity") < 1).cast("int").alias("_invalid"),
    )
    if cumulative:
        wanted = wanted.groupBy("request_id", "product_id").agg(
            F.min("line_no").alias("line_no"), F.sum("quantity").alias("quantity"),
            F.sum("_lines").alias("_lines"), F.max("_invalid").alias("_invalid"),
        )
    per_request = _with_products(wanted, products).groupBy("request_id").agg(
        F.sum("_lines").alias("line_count"),
        F.max("_invalid").alias("_invalid"),
        F.count_if(F.col("known") & F.col("price").isNull()).alias("_unpriced"),
        F.sum(F.col("price") * F.col("quantity")).alias("total_amount"),  # wide: no quantity overflows it
        F.min(_line_reject(F.col("known"))).alias("_reject"),
    )
    storable = F.col("total_amount").try_cast(MONEY).isNotNull() & (F.col("_unpriced") == 0)
    code = (
        F.when(F.col("line_count").isNull(), EMPTY_ORDER)
        .when(F.col("_reject").isNotNull(), F.col("_reject.code"))
        .when(F.col("_invalid") == 1, INVALID_QUANTITY)
        .when(~storable, NOT_PRICEABLE)
    )
    outer = F.when(code == PRODUCT_NOT_FOUND, VALIDATION_FAILED).when(code.isNotNull(), CREATION_FAILED)
    return headers.join(per_request, "request_id", "left").select(
        *headers.columns,
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.when(code.isNull(), F.col("total_amount")).alias("total_amount"),
        code.isNull().alias("accepted"),
        code.alias("reject_code"),
        outer.alias("outer_code"),
        _message(code, F.col("_reject")).alias("message"),
    )


def check_stock(headers: DataFrame, lines: DataFrame, products: DataFrame, cumulative: bool = False) -> DataFrame:
    """Accept or first rejection of every request."""
    assessed = assess_requests(headers.select("request_id"), lines, products, cumulative)
    return assessed.select("request_id", "accepted", "reject_code", "outer_code", "message")


def check_inventory(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per line: does stock cover it? An unknown product does not."""
    enough = (F.col("available_quantity") >= F.col("quantity")) & F.col("in_stock")
    return _with_products(lines, products).select(
        "request_id", "line_no", "product_id", "quantity",
        F.coalesce(enough, F.lit(False)).alias("sufficient"),
    )


def price_requests(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order total of every request from catalogue prices; null where a line has no price."""
    priced = _with_products(lines, products).withColumn(
        "_total", money.line_total(F.col("price"), F.col("quantity"))
    )
    whole = F.count("*") == F.count("_total")
    return priced.groupBy("request_id").agg(
        F.count("*").alias("line_count"), F.when(whole, F.sum("_total")).alias("total_amount")
    )


class Created(NamedTuple):
    orders: DataFrame
    items: DataFrame
    rejects: DataFrame


def create_orders(
    headers: DataFrame, lines: DataFrame, products: DataFrame, existing: DataFrame, cumulative: bool = False,
    assessed: DataFrame | None = None,
) -> Created:
    """Accepted requests as PENDING orders with their items, and the rejected ones with the reason.

    The request id becomes the order id and ``requested_at`` the creation time, so a repeated run
    gives the same orders. ``existing`` (order_number) holds numbers already in use. Nothing runs before a
    result is used, and each result assesses the requests anew; who uses several of them passes the result
    of ``assess_requests``, written and read again, as ``assessed``.
    """
    if assessed is None:
        assessed = assess_requests(headers, lines, products, cumulative)
    accepted = assessed.where(F.col("accepted")).select(
        F.col("request_id").alias("id"), "user_id", F.col("total_amount").cast(MONEY).alias("total_amount"),
        address.render(F.col("shipping_address")).alias("shipping_address"),
        address.render(F.col("billing_address")).alias("billing_address"),
        F.col("requested_at").alias("created_at"),
    )
    numbered = assign_order_numbers(accepted, existing)
    orders = numbered.where(F.col("order_number").isNotNull()).select(
        "id", "order_number", "user_id", F.lit("PENDING").alias("status"), "total_amount",
        "shipping_address", "billing_address", "created_at", F.col("created_at").alias("updated_at"),
    )
    unnumbered = numbered.where(F.col("order_number").isNull()).select(
        F.col("id").alias("request_id"), F.lit(NO_TIME).alias("reject_code"),
        F.lit(CREATION_FAILED).alias("outer_code"),
        F.lit(NO_TIME_TEXT).alias("message"),
    )
    rejects = assessed.where(~F.col("accepted")).select("request_id", "reject_code", "outer_code", "message")
    ordered = orders.select(F.col("id").alias("request_id"))
    items = _with_products(lines.join(ordered, "request_id", "left_semi"), products).select(
        F.concat_ws("-", F.col("request_id").cast("string"), F.col("line_no").cast("string"),
                    F.col("product_id").cast("string")).alias("id"),
        F.col("request_id").alias("order_id"), "product_id",
        F.col("name").alias("product_name"), F.col("sku").alias("product_sku"), "quantity",
        F.col("price").alias("unit_price"),
        money.line_total(F.col("price"), F.col("quantity")).alias("total_price"),
    )
    return Created(orders, items, rejects.unionByName(unnumbered))


def _id_ranges(stamped: DataFrame) -> DataFrame:
    """(_ms, _shares, _low, _high, _prefix) of the milliseconds with more than ORDERS_PER_RANGE orders: the
    number of ranges their ids are cut into, and the smallest and largest id as whole numbers.

    The place of a string counts by the bytes that follow what the smallest and the largest id begin with.
    """
    per_ms = stamped.where(F.col("_ms").isNotNull()).groupBy("_ms").agg(
        F.count("*").alias("_n"), F.min("id").alias("_first"), F.max("id").alias("_last")
    )
    wide = per_ms.where(F.col("_n") > ORDERS_PER_RANGE)
    shares = F.ceil(F.col("_n") / F.lit(ORDERS_PER_RANGE)).cast("bigint").alias("_shares")
    if not isinstance(stamped.schema["id"].dataType, T.StringType):
        return wide.select("_ms", shares, _place("_first", None).alias("_low"), _place("_last", None).alias("_high"))
    lengths = F.sequence(F.lit(1), F.greatest(F.least(F.octet_length("_first"), F.octet_length("_last")), F.lit(1)))
    first, last = F.col("_first").cast("binary"), F.col("_last").cast("binary")
    same = F.filter(lengths, lambda n: F.substring(first, F.lit(1), n) == F.substring(last, F.lit(1), n))
    return wide.withColumn("_prefix", F.coalesce(F.array_max(same), F.lit(0))).select(
        "_ms", shares, _place("_first", "_prefix").alias("_low"), _place("_last", "_prefix").alias("_high"), "_prefix"
    )


def _place(name: str, prefix: str | None) -> Column:
    """An id as a whole number that grows with it: a number itself, or seven bytes of a string."""
    if prefix is None:
        return F.col(name).cast("decimal(20,0)")
    digits = F.hex(F.substring(F.col(name).cast("binary"), F.col(prefix) + 1, F.lit(7)))
    return F.conv(F.rpad(digits, 14, "0"), 16, 10).cast("decimal(20,0)")


def assign_order_numbers(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``order_number`` for every new order: prefix, epoch milliseconds, counter of at least four digits.

    Orders created in one millisecond take the counters after the highest one that an existing number of
    that millisecond uses, in the order of their ids; the counter grows beyond four digits where it has
    to. Without a time there is no number.

    The ids of a millisecond with very many orders are cut into ranges of even width between the smallest
    and the largest. Orders are ranked inside their range alone, and a range starts where the counts of the
    ranges before it end, so only those counts meet per millisecond. Ids that crowd in one place share a range.
    """
    stamped = new.withColumn("_ms", F.unix_millis(F.col("created_at").cast("timestamp")))
    ranges = _id_ranges(stamped)
    distance = F.expr(
        "cast((_place - _low) * cast(_shares AS decimal(18,0)) div (_high - _low + 1) AS bigint)"
    )
    placed = (
        stamped.where(F.col("_ms").isNotNull())
        .join(ranges, "_ms", "left")
        .withColumn("_place", _place("id", "_prefix" if "_prefix" in ranges.columns else None))
        .withColumn("_range", F.coalesce(distance, F.lit(0)))
        .select(*new.columns, "_ms", "_range")
    )
    pattern = rf"^{NUMBER_PREFIX}-(\d+)-(\d{{4,}})$"
    used = (
        existing.select(
            F.regexp_extract("order_number", pattern, 1).try_cast("bigint").alias("_ms"),
            F.regexp_extract("order_number", pattern, 2).try_cast("bigint").alias("_counter"),
        )
        .where(F.col("_ms").isNotNull() & (F.col("_counter") > 0))
        .join(stamped.select("_ms").distinct(), "_ms", "left_semi")
        .groupBy("_ms").agg(F.max("_counter").alias("_highest"))
    )
    # one row per range: what the ranges before it count, after the numbers in use
    before = Window.partitionBy("_ms").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_ms", "_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(used, "_ms", "left")
        .select("_ms", "_range", (F.col("_before") + F.coalesce("_highest", F.lit(0))).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy("_ms", "_range").orderBy("id"))
    ranked = placed.withColumn("_rank", rank.cast("bigint")).join(starts, ["_ms", "_range"])
    counter = (F.col("_rank") + F.col("_start")).cast("string")
    padded = F.when(F.char_length(counter) < 4, F.lpad(counter, 4, "0")).otherwise(counter)
    number = F.concat(F.lit(f"{NUMBER_PREFIX}-"), F.col("_ms").cast("string"), F.lit("-"), padded)
    timeless = stamped.where(F.col("_ms").isNull()).select(*new.columns, F.lit(None).cast("string").alias("order_number"))
    return ranked.select(*new.columns, number.alias("order_number")).unionByName(timeless)
