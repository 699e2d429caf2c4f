"""Registered queries: an operator call over the star-schema tables, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import configure
from tallyhouse.sources import star

AS_OF = datetime.fromisoformat(star.AS_OF)


class Shop:
    """The contract tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark, star.stored_bytes(spark, folder))
        self.folder = folder

    @property
    def orders(self) -> DataFrame:
        return star.orders(self.spark, self.folder)

    @property
    def addressed(self) -> DataFrame:
        return star.orders_with_addresses(self.spark, self.folder)

    @property
    def items(self) -> DataFrame:
        return star.items(self.spark, self.folder)

    @property
    def dirty_items(self) -> DataFrame:
        return star.items(self.spark, self.folder, dirty=True)

    @property
    def item_keys(self) -> DataFrame:
        return star.item_keys(self.spark, self.folder)

    def snapshot(self, lines: DataFrame) -> DataFrame:
        """Item keys and what was joined to them, with the product columns of ``items``."""
        return star.with_snapshot(lines, self.spark, self.folder)

    @property
    def products(self) -> DataFrame:
        return star.products(self.spark, self.folder)

    @property
    def headers(self) -> DataFrame:
        return star.request_headers(self.spark, self.folder)

    @property
    def lines(self) -> DataFrame:
        return star.request_lines(self.spark, self.folder)

    @property
    def events(self) -> DataFrame:
        return star.status_events(self.spark, self.folder)

    @property
    def payments(self) -> DataFrame:
        return star.payments(self.spark, self.folder)


@dataclass(frozen=True)
class Registered:
    build: Callable[[Shop], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return comparable(self.build(Shop(spark, folder)))


def _plain(name: str, kind: T.DataType) -> Column:
    column = F.col(name)
    if isinstance(kind, T.DecimalType):
        return column.cast("double").alias(name)
    if isinstance(kind, (T.IntegerType, T.ShortType)):
        return column.cast("bigint").alias(name)
    if isinstance(kind, T.TimestampType):
        return column.cast("timestamp_ntz").alias(name)
    if isinstance(kind, T.StructType):
        return F.to_json(column, {"ignoreNullFields": "false"}).alias(name)
    if isinstance(kind, T.ArrayType):
        return F.array_join(column, ",").alias(name)
    return column


def comparable(df: DataFrame) -> DataFrame:
    """Types that mean the same in both engines: money as double, whole numbers as bigint, UTC wall time."""
    return df.select(*(_plain(field.name, field.dataType) for field in df.schema.fields))


def with_sql(select: str, *names: str) -> str:
    """The statement with the named shared subqueries, and those they need, in front of it."""
    wanted: list[str] = []

    def need(name: str) -> None:
        before, _ = SHARED[name]
        for other in before:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = ",\n".join(f"{name} AS ({SHARED[name][1]})" for name in wanted)
    recursive = "RECURSIVE " if "replay" in wanted else ""
    return f"WITH {recursive}{parts}\n{select}" if wanted else select


SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "o": ((), """
        SELECT o_orderkey AS id,
               'ORD-' || lpad(cast(o_orderkey AS varchar), 10, '0') AS order_number,
               o_custkey AS user_id,
               CASE o_orderstatus || cast(o_orderkey % 4 AS varchar)
                    WHEN 'F0' THEN 'DELIVERED' WHEN 'F1' THEN 'DELIVERED'
                    WHEN 'F2' THEN 'SHIPPED' WHEN 'F3' THEN 'RETURNED'
                    WHEN 'O0' THEN 'PENDING' WHEN 'O1' THEN 'CONFIRMED'
                    WHEN 'O2' THEN 'PROCESSING' WHEN 'O3' THEN 'CANCELLED'
                    WHEN 'P0' THEN 'PROCESSING' WHEN 'P1' THEN 'SHIPPED'
                    WHEN 'P2' THEN 'CONFIRMED' WHEN 'P3' THEN 'REFUNDED' END AS status,
               cast(o_totalprice AS decimal(10,2)) AS total_amount,
               o_orderdate AS created_at,
               o_orderdate + to_hours(o_orderkey % 240) AS updated_at
        FROM orders"""),
    "a": ((), """
        SELECT c_custkey AS user_id, c_name AS line1, n_name AS city, r_name AS state,
               lpad(cast(c_custkey AS varchar), 5, '0') AS postal,
               CASE c_nationkey % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'Canada' ELSE 'UK' END AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "oa": (("o", "a"), """
        SELECT o.*, a.line1, a.city, a.state, a.postal, a.country,
               CASE WHEN o.id % 2 = 0 THEN a.line1 ELSE a.line1 || ' (billing)' END AS billing_line1,
               '","addressLine2":null,"city":"' || a.city || '","state":"' || a.state || '","postalCode":"'
                 || a.postal || '","country":"' || a.country || '"}' AS tail
        FROM o JOIN a ON o.user_id = a.user_id"""),
    "oj": (("oa",), """
        SELECT id, order_number, user_id, status, total_amount, created_at, updated_at,
               '{"addressLine1":"' || line1 || tail AS shipping_address,
               '{"addressLine1":"' || billing_line1 || tail AS billing_address
        FROM oa"""),
    "p": ((), """
        SELECT p_partkey AS id, p_name AS name, p_brand || '-' || cast(p_partkey AS varchar) AS sku,
               cast(p_retailprice AS decimal(10,2)) AS price,
               CASE WHEN p_partkey % 17 <> 0 THEN p_size > 5 END AS in_stock,
               CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS available_quantity
        FROM part"""),
    "i": (("p",), """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         date_diff('day', DATE '1970-01-01', l_shipdate), cast(l_quantity AS int)) AS id,
               l_orderkey AS order_id, l_partkey AS product_id, p.name AS product_name, p.sku AS product_sku,
               cast(l_quantity AS int) AS quantity, p.price AS unit_price,
               cast(p.price * cast(l_quantity AS int) AS decimal(10,2)) AS total_price,
               CASE WHEN l_orderkey % 10 = 0 THEN cast(l_extendedprice AS decimal(10,2))
                    ELSE cast(p.price * cast(l_quantity AS int) AS decimal(10,2)) END AS dirty_price
        FROM lineitem JOIN p ON l_partkey = p.id"""),
    "sold": (("i", "o"), """
        SELECT i.*, o.user_id, o.status, o.total_amount, o.created_at
        FROM i, o WHERE i.order_id = o.id AND (o.status = 'DELIVERED' OR o.status = 'SHIPPED')"""),
    "rl": ((), """
        SELECT l_orderkey AS request_id, l_linenumber AS line_no, l_partkey AS product_id,
               cast(l_quantity AS int) AS quantity
        FROM lineitem"""),
    "ev": ((), """
        SELECT user_id AS order_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'CONFIRMED' WHEN 'view' THEN 'PROCESSING'
                    WHEN 'click' THEN 'SHIPPED' WHEN 'purchase' THEN 'DELIVERED'
                    WHEN 'error' THEN 'CANCELLED' END AS to_status
        FROM events"""),
    "legal": ((), """
        SELECT * FROM (VALUES
            ('PENDING', 'CONFIRMED'), ('PENDING', 'CANCELLED'), ('CONFIRMED', 'PROCESSING'),
            ('CONFIRMED', 'CANCELLED'), ('PROCESSING', 'SHIPPED'), ('PROCESSING', 'CANCELLED'),
            ('SHIPPED', 'DELIVERED'), ('SHIPPED', 'RETURNED'), ('DELIVERED', 'RETURNED')) AS t(f, t)"""),
    "numbered": (("ev",), """
        SELECT ev.*, row_number() OVER (PARTITION BY order_id ORDER BY ts, event_id) AS n FROM ev"""),
    "replay": (("numbered", "legal"), """
        SELECT order_id, n, event_id, ts, 'PENDING' AS from_status, to_status,
               EXISTS (SELECT 1 FROM legal WHERE f = 'PENDING' AND t = to_status) AS accepted
        FROM numbered WHERE n = 1
        UNION ALL
        SELECT e.order_id, e.n, e.event_id, e.ts,
               CASE WHEN r.accepted THEN r.to_status ELSE r.from_status END,
               e.to_status,
               l.f IS NOT NULL
        FROM replay r JOIN numbered e ON e.order_id = r.order_id AND e.n = r.n + 1
        LEFT JOIN legal l
          ON l.f = CASE WHEN r.accepted THEN r.to_status ELSE r.from_status END AND l.t = e.to_status"""),
    "ch": (("o", "replay"), """
        SELECT id AS order_id, cast(NULL AS bigint) AS event_id, created_at AS ts,
               cast(NULL AS varchar) AS from_status, 'PENDING' AS to_status, 'create' AS via FROM o
        UNION ALL
        SELECT order_id, event_id, ts, from_status, to_status, 'status' FROM replay WHERE accepted"""),
    "pay": (("o",), """
        SELECT id, 'PAY-' || lpad(cast(id AS varchar), 10, '0') AS payment_number, id AS order_id, user_id,
               total_amount AS amount, 'USD' AS currency,
               ['CREDIT_CARD','DEBIT_CARD','PAYPAL','STRIPE','BANK_TRANSFER','DIGITAL_WALLET','GIFT_CARD'][1 + id % 7]
                 AS payment_method,
               ['PENDING','PROCESSING','COMPLETED','FAILED','CANCELLED','REFUNDED'][1 + id % 6] AS status,
               CASE WHEN id % 6 = 2 THEN 'GW-' || cast(id AS varchar) END AS gateway_transaction_id,
               CASE WHEN id % 6 = 3 AND id % 5 <> 0 THEN 'Card declined' END AS failure_reason
        FROM o"""),
}
