"""Table contracts. Ids are strings here; every job also takes bigint ids unchanged."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

ADDRESS = T.StructType(
    [
        T.StructField("addressLine1", T.StringType()),
        T.StructField("addressLine2", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("postalCode", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("order_number", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_amount", MONEY),
        T.StructField("shipping_address", T.StringType()),
        T.StructField("billing_address", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ORDER_ITEMS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_sku", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", MONEY),
        T.StructField("total_price", MONEY),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField("in_stock", T.BooleanType()),
        T.StructField("available_quantity", T.IntegerType()),
    ]
)

ORDER_REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("product_id", T.StringType()),
                        T.StructField("quantity", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("shipping_address", ADDRESS),
        T.StructField("billing_address", ADDRESS),
    ]
)

ORDER_UPDATES = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("shipping_address", ADDRESS),
        T.StructField("billing_address", ADDRESS),
    ]
)

STATUS_EVENTS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("to_status", T.StringType()),
    ]
)

PAYMENTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("payment_number", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("gateway_transaction_id", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
