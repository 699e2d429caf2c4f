"""Tables that are changed in place: merges by month, and the stock ledger."""

from datetime import datetime
from pathlib import Path
from random import Random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators import ledger, nesting
from tallyhouse.sources import tables

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("note", T.StringType()),
])


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def content(spark, path):
    return rows(tables.read_table(spark, path, SCHEMA), "id", "created_at", "note")


@pytest.fixture
def by_month(spark, tmp_path):
    """Twelve orders a month from January to May, and two without a time."""
    data = [(f"{m}-{n}", datetime(2024, m, n + 1), "old") for m in range(1, 6) for n in range(12)]
    data += [("none-1", None, "old"), ("none-2", None, "old")]
    path = f"{tmp_path}/orders"
    tables.write_table(spark.createDataFrame(data, SCHEMA), path, month_of="created_at", sort_by=("id",))
    return path, {row[0]: row for row in data}


def test_only_touched_months_are_written(spark, by_month):
    path, want = by_month
    before = files(path)
    changed = [("2-3", datetime(2024, 2, 4), "new"), ("6-1", datetime(2024, 6, 1), "first of June"), ("3-5", datetime(2024, 5, 9), "moved")]
    deleted = spark.createDataFrame([("4-0",), ("nowhere",), ("2-1",)], "id string")
    months = tables.merge_months(path, SCHEMA, "created_at", spark.createDataFrame(changed, SCHEMA), deleted)
    assert months == ["2024-02", "2024-03", "2024-04", "2024-05", "2024-06"]
    want |= {row[0]: row for row in changed}
    for gone in ("4-0", "2-1"):
        del want[gone]
    assert content(spark, path) == sorted(want.values(), key=repr)
    kept = {name: at for name, at in before.items() if "2024-01" in name or "HIVE" in name}
    assert len(kept) >= 2 and kept.items() <= files(path).items()
    # once more: the same table
    tables.merge_months(path, SCHEMA, "created_at", spark.createDataFrame(changed, SCHEMA), deleted)
    assert content(spark, path) == sorted(want.values(), key=repr) and kept.items() <= files(path).items()


def test_an_emptied_month_loses_its_folder(spark, by_month):
    path, want = by_month
    gone = [i for i in want if i.startswith("3-") or i.startswith("none")]
    assert tables.merge_months(path, SCHEMA, "created_at", deleted=spark.createDataFrame([(i,) for i in gone], "id string")) == ["2024-03", None]
    assert content(spark, path) == sorted((r for i, r in want.items() if i not in gone), key=repr)
    assert not any("2024-03" in name or "HIVE" in name for name in files(path))


@pytest.mark.parametrize("keys_sent", [0, 100])
def test_keys_sent_or_joined_by_sorting(spark, by_month, keys_sent):
    path, want = by_month
    changed = [("2-3", datetime(2024, 2, 4), "new"), ("3-5", datetime(2024, 5, 9), "moved")]
    deleted = spark.createDataFrame([(f"4-{n}",) for n in range(12)], "id string")
    months = tables.merge_months(
        path, SCHEMA, "created_at", spark.createDataFrame(changed, SCHEMA), deleted, keys_sent=keys_sent
    )
    assert months == ["2024-02", "2024-03", "2024-04", "2024-05"]
    want = {i: r for i, r in want.items() if not i.startswith("4-")} | {row[0]: row for row in changed}
    assert content(spark, path) == sorted(want.values(), key=repr)
    assert not any("2024-04" in name for name in files(path))


def test_changed_and_deleted_is_deleted(spark, by_month):
    path, want = by_month
    changed = spark.createDataFrame([("1-0", datetime(2024, 1, 1), "new"), ("8-8", datetime(2024, 8, 8), "new")], SCHEMA)
    tables.merge_months(path, SCHEMA, "created_at", changed, changed.select("id"))
    del want["1-0"]
    assert content(spark, path) == sorted(want.values(), key=repr)


def test_nothing_to_merge(spark, by_month):
    path, _ = by_month
    before = files(path)
    assert tables.merge_months(path, SCHEMA, "created_at", deleted=spark.createDataFrame([("nowhere",)], "id string")) == []
    assert files(path) == before


MOVEMENTS = "product_id string, movement string, quantity int"


def test_snapshot_and_batches_equal_the_full_sum(spark, tmp_path):
    random = Random(2)
    stock, every = ledger.StockLedger(spark, f"{tmp_path}/ledger"), []
    assert stock.stock().count() == 0 and stock.compact() == 0
    for n in range(6):
        batch = [(random.choice(["a", "b", "c", None]), random.choice(["RESERVE", "CONFIRM_SALE", "RELEASE", "?"]), random.randrange(9)) for _ in range(30)]
        every += batch
        table = spark.createDataFrame(batch, MOVEMENTS)
        assert stock.commit(f"day/{n}", table) and not stock.commit(f"day/{n}", table)
        if n in (1, 4):
            stock.compact()
            assert not stock.commit(f"day/{n}", table)
    want = rows(ledger.signed(spark.createDataFrame(every, MOVEMENTS)), "product_id", "reserved", "sold")
    assert rows(stock.stock(), "product_id", "reserved", "sold") == want
    # what a snapshot holds is not there to be read again
    assert sorted(p.name[:6] for p in Path(f"{tmp_path}/ledger").iterdir()) == ["batch-", "snapsh", "snapsh"]


def test_a_failed_commit_does_not_count(spark, tmp_path):
    stock = ledger.StockLedger(spark, f"{tmp_path}/ledger")
    one = spark.createDataFrame([("a", "RESERVE", 3)], MOVEMENTS)
    stock.commit("first", one)
    left = Path(f"{tmp_path}/ledger/batch-{b'second'.hex()}")
    stock.commit("second", one)
    (left / "_SUCCESS").unlink()  # as if the writer had been lost
    assert rows(stock.stock()) == [("a", 3, 0)]
    assert stock.commit("second", one) and rows(stock.stock()) == [("a", 6, 0)]
    # a snapshot that was not finished is written over
    broken = Path(f"{tmp_path}/ledger/snapshot-1/stock")
    broken.mkdir(parents=True)
    assert rows(stock.stock()) == [("a", 6, 0)] and stock.compact() == 1 and rows(stock.stock()) == [("a", 6, 0)]


def test_movements_that_cancel_out(spark, tmp_path, make_products):
    stock = ledger.StockLedger(spark, f"{tmp_path}/ledger")
    stock.commit("x", spark.createDataFrame([("a", "RESERVE", 3), ("a", "RELEASE", 3), ("b", "CONFIRM_SALE", 2)], MOVEMENTS))
    products = make_products(("a", "A", "1.00", True, 5), ("b", "B", "1.00", True, None), ("c", "C", "1.00", True, 1))
    assert rows(ledger.position(stock.stock(), products)) == [("a", 5, 0, 0, 5), ("b", 0, -2, 2, 0), ("c", 1, 0, 0, 1)]


def test_bucketed_items_are_listed_without_a_shuffle(spark, make_orders, make_items):
    orders = make_orders(*((f"o{n}", "u", "SHIPPED", "1.00", "2024-01-01") for n in range(9)))
    items = make_items(*((f"i{n}", f"o{n % 7}", "p", "P", 1, "1.00") for n in range(40)))
    tables.save_bucketed(orders, "nest_orders", "id", 3)
    tables.save_bucketed(items, "nest_items", "order_id", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        placed = nesting.order_response(spark.table("nest_orders"), spark.table("nest_items"), in_place=True)
        assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
        columns = ("id", "items", "total_items", "total_quantity")
        assert rows(placed, *columns) == rows(nesting.order_response(orders, items), *columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
