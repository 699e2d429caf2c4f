"""The contract tables read from a TPC-H-like star schema in parquet.

Everything is a projection, or a join with a dimension table that Spark broadcasts only when it is
small; no window and no shuffle of the fact tables is needed to derive ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import address, money
from tallyhouse.schema import MONEY

AS_OF = "2001-08-02 00:00:00"

# State by source flag and order key modulo 4, and event type by target state.
STATE_BY_FLAG = {
    "F": ("DELIVERED", "DELIVERED", "SHIPPED", "RETURNED"),
    "O": ("PENDING", "CONFIRMED", "PROCESSING", "CANCELLED"),
    "P": ("PROCESSING", "SHIPPED", "CONFIRMED", "REFUNDED"),
}
STATE_BY_EVENT = {
    "signup": "CONFIRMED", "view": "PROCESSING", "click": "SHIPPED",
    "purchase": "DELIVERED", "error": "CANCELLED",
}
PAYMENT_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED", "REFUNDED")
PAYMENT_METHODS = ("CREDIT_CARD", "DEBIT_CARD", "PAYPAL", "STRIPE", "BANK_TRANSFER", "DIGITAL_WALLET", "GIFT_CARD")


# Stated, so that no job has to read file footers before planning.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """The size of the tables that the folder has, from its listing alone."""
    total = 0
    for name in SCHEMAS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += system.getContentSummary(path).getLength() if system.exists(path) else 0
    return total


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of the files in the folder."""
    stream = spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
    return stream.parquet(folder)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def order_columns() -> list[Column]:
    """The seven scalar order columns over the source's order columns (batch or stream)."""
    key = F.col("o_orderkey")
    status = F.lit(None).cast("string")
    for flag, states in STATE_BY_FLAG.items():
        status = F.when(F.col("o_orderstatus") == flag, _pick(states, key % 4)).otherwise(status)
    hours = F.make_dt_interval(F.lit(0), (key % 240).cast("int"))
    return [
        key.alias("id"),
        F.concat(F.lit("ORD-"), F.lpad(key.cast("string"), 10, "0")).alias("order_number"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + hours).alias("updated_at"),
    ]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").select(*order_columns())


def customer_addresses(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer")
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    country = (
        F.when(F.col("c_nationkey") % 3 == 0, "USA")
        .when(F.col("c_nationkey") % 3 == 1, "Canada")
        .otherwise("UK")
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.struct(
                F.col("c_name").alias("addressLine1"),
                F.lit(None).cast("string").alias("addressLine2"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("state"),
                F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("postalCode"),
                country.alias("country"),
            ).alias("address"),
        )
    )


def _address_structs(spark: SparkSession, folder: str) -> DataFrame:
    billing = F.col("address").withField(
        "addressLine1",
        F.when(F.col("id") % 2 == 0, F.col("address.addressLine1"))
        .otherwise(F.concat(F.col("address.addressLine1"), F.lit(" (billing)"))),
    )
    return (
        orders(spark, folder)
        .join(customer_addresses(spark, folder), "user_id")
        .withColumns({"shipping_address": F.col("address"), "billing_address": billing})
        .drop("address")
    )


def orders_with_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with both addresses as JSON text, as they are stored."""
    return _address_structs(spark, folder).select(
        "id", "order_number", "user_id", "status", "total_amount",
        address.render(F.col("shipping_address")).alias("shipping_address"),
        address.render(F.col("billing_address")).alias("billing_address"),
        "created_at", "updated_at",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    known = F.col("p_partkey") % 17 != 0
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.when(known, F.col("p_size") > 5).alias("in_stock"),
        F.when(known, F.col("p_size")).alias("available_quantity"),
    )


LINE = ("id", "order_id", "product_id", "quantity", "source_price")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Item keys alone; the id spells out the line, so no numbering pass is needed."""
    quantity = F.col("l_quantity").cast("int")
    item_id = F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("string"), quantity.cast("string"),
    )
    return _table(spark, folder, "lineitem").select(
        item_id.alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        quantity.alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("source_price"),
    )


def item_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Items without the product snapshot: for jobs that need neither names nor prices."""
    return _lines(spark, folder).drop("source_price")


def items(spark: SparkSession, folder: str, dirty: bool = False) -> DataFrame:
    """Items with product snapshot; ``dirty`` spoils the line total of every tenth order."""
    return with_snapshot(_lines(spark, folder), spark, folder, dirty)


def with_snapshot(lines: DataFrame, spark: SparkSession, folder: str, dirty: bool = False) -> DataFrame:
    """The lines with the columns of their product, for jobs that cut the lines or join them narrow first.
    Further columns of the lines come last."""
    catalogue = products(spark, folder).select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("sku").alias("product_sku"),
        F.col("price").alias("unit_price"),
    )
    line_total = money.line_total(F.col("unit_price"), F.col("quantity")).cast(MONEY)
    if dirty:
        line_total = F.when(F.col("order_id") % 10 == 0, F.col("source_price")).otherwise(line_total)
    further = [name for name in lines.columns if name not in LINE]
    return lines.join(catalogue, "product_id").select(
        "id", "order_id", "product_id", "product_name", "product_sku", "quantity", "unit_price",
        line_total.alias("total_price"), *further,
    )


def request_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One order request per order key, addresses as structs; some have no line at all."""
    return _address_structs(spark, folder).select(
        F.col("id").alias("request_id"), "user_id", "shipping_address", "billing_address",
        F.col("created_at").alias("requested_at"),
    )


def request_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The requested lines in long form, so that a request of any length needs no array."""
    return _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def event_columns() -> list[Column]:
    """The status event columns over the source's event columns (batch or stream)."""
    target = F.lit(None).cast("string")
    for kind, state in STATE_BY_EVENT.items():
        target = F.when(F.col("event_type") == kind, state).otherwise(target)
    return [F.col("user_id").alias("order_id"), F.col("event_id"), F.col("ts"), target.alias("to_status")]


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(*event_columns())


def payments(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("id")
    status = _pick(PAYMENT_STATES, key % 6)
    return orders(spark, folder).select(
        key.alias("id"),
        F.concat(F.lit("PAY-"), F.lpad(key.cast("string"), 10, "0")).alias("payment_number"),
        key.alias("order_id"),
        "user_id",
        F.col("total_amount").alias("amount"),
        F.lit("USD").alias("currency"),
        _pick(PAYMENT_METHODS, key % 7).alias("payment_method"),
        status.alias("status"),
        F.when(key % 6 == 2, F.concat(F.lit("GW-"), key.cast("string"))).alias("gateway_transaction_id"),
        F.when((key % 6 == 3) & (key % 5 != 0), F.lit("Card declined")).alias("failure_reason"),
        F.when(key % 6 >= 2, F.col("updated_at")).alias("processed_at"),
        "created_at",
        "updated_at",
    )
