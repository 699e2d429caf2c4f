from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyhouse import schema  # noqa: E402
from tallyhouse.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyhouse-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


ADDRESS = '{"addressLine1":"123 Main St","addressLine2":null,"city":"New York","state":"NY","postalCode":"10001","country":"USA"}'


@pytest.fixture(scope="session")
def make_orders(spark):
    """Orders from (id, user, status, total, created[, updated]) tuples."""

    def make(*rows):
        full = [
            (i, f"ORD-1234567890-{n + 1:04d}", user, status, None if total is None else Decimal(total),
             ADDRESS, ADDRESS, at(created), at(rest[0] if rest else created))
            for n, (i, user, status, total, created, *rest) in enumerate(rows)
        ]
        return spark.createDataFrame(full, schema.ORDERS)

    return make


@pytest.fixture(scope="session")
def make_items(spark):
    """Items from (id, order, product, name, quantity, price[, total]) tuples."""

    def make(*rows):
        full = []
        for i, order, product, name, quantity, price, *rest in rows:
            unit = None if price is None else Decimal(price)
            total = Decimal(rest[0]) if rest else unit * quantity
            full.append((i, order, product, name, f"SKU-{product}", quantity, unit, total))
        return spark.createDataFrame(full, schema.ORDER_ITEMS)

    return make


@pytest.fixture(scope="session")
def make_products(spark):
    """Products from (id, name, price, in_stock, available) tuples."""

    def make(*rows):
        full = [(i, name, f"SKU-{i}", None if price is None else Decimal(price), stock, available)
                for i, name, price, stock, available in rows]
        return spark.createDataFrame(full, schema.PRODUCTS)

    return make


@pytest.fixture(scope="session")
def seed(make_orders, make_items):
    """Three orders with one item each."""
    orders = make_orders(
        ("o1", "u1", "DELIVERED", "299.98", "2024-01-10"),
        ("o2", "u2", "PROCESSING", "149.99", "2024-01-11"),
        ("o3", "u3", "PENDING", "89.99", "2024-01-12"),
    )
    items = make_items(
        ("i1", "o1", "p1", "Wireless Headphones", 2, "149.99"),
        ("i2", "o2", "p2", "Bluetooth Speaker", 1, "149.99"),
        ("i3", "o3", "p3", "Phone Case", 1, "89.99"),
    )
    return orders, items


def rows(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns or df.columns).collect()), key=repr)
