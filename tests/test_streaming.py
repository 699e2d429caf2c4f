from datetime import timedelta
from random import Random

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tallyhouse import schema
from tallyhouse.operators import history
from tallyhouse.streaming import jobs


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)


def stream_of(spark, df, folder, files):
    """The rows as a stream of several files, one per trigger, in the order of ``files``."""
    for n, condition in enumerate(files):
        df.where(condition).coalesce(1).write.mode("append").parquet(str(folder / f"part{n}"))
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


CLOSING = {"order_id": "", "event_id": 0, "ts": jobs.CLOSING}
COLUMNS = ("order_id", "event_id", "from_status", "to_status", "accepted")


def test_state_survives_between_triggers(spark, tmp_path):
    targets = ["CONFIRMED", "DELIVERED", "PROCESSING", "SHIPPED", "CONFIRMED", "DELIVERED", "RETURNED", "PENDING"]
    start = at("2024-01-01")
    data = [(order, n, start + timedelta(minutes=n), t) for order in ("a", "b") for n, t in enumerate(targets)]
    events = spark.createDataFrame(data, schema.STATUS_EVENTS)
    stream = stream_of(spark, events, tmp_path, ["event_id < 3", "event_id BETWEEN 3 AND 5", "event_id > 5"])
    got = jobs.run_to_the_end(stream, CLOSING, jobs.stream_status_machine)
    assert rows(got, *COLUMNS) == rows(history.status_history(events), *COLUMNS)


def test_late_and_shuffled_events_are_judged_in_time_order(spark, tmp_path):
    """Arrival is at random over three triggers; one order has most of the rows; some share a time or repeat."""
    random = Random(4)
    targets = ["CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "RETURNED", "CANCELLED", None]
    start = at("2024-01-01")
    data = [
        (order, n, start + timedelta(microseconds=700 * (n // 2)), random.choices(targets, [5, 4, 4, 3, 2, 0.2, 1])[0])
        for order, size in (("hot", 150), ("b", 12), ("c", 3), ("d", 9)) for n in range(size)
    ]
    data += data[3:6] + [("b", 99, None, "CONFIRMED"), (None, 98, start, "CONFIRMED"), ("c", None, start, "SHIPPED")]
    events = spark.createDataFrame(data, schema.STATUS_EVENTS)
    arriving = events.withColumn("part", F.pmod(F.xxhash64("event_id", "order_id"), F.lit(3))).orderBy(F.rand(3))
    stream = stream_of(spark, arriving, tmp_path, ["part = 0", "part = 1", "part = 2"]).drop("part")
    got = jobs.run_to_the_end(stream, CLOSING, jobs.stream_status_machine)
    assert rows(got, *COLUMNS) == rows(history.status_history(events), *COLUMNS)


def test_long_orders_wait_in_the_state_store(spark, tmp_path):
    """The orders have more events in a trigger than are held in memory; arrival is at random, three rows repeat."""
    random = Random(9)
    targets = ["CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "RETURNED", None]
    start = at("2024-01-01")
    data = [(order, n, start + timedelta(seconds=n), random.choice(targets)) for order in ("hot", "b") for n in range(60)]
    events = spark.createDataFrame(data + data[5:8], schema.STATUS_EVENTS)
    stream = stream_of(spark, events.orderBy(F.rand(5)), tmp_path, ["true"])
    got = jobs.run_to_the_end(stream, CLOSING, lambda e: jobs.stream_status_machine(e, in_memory=7))
    assert rows(got, *COLUMNS) == rows(history.status_history(events), *COLUMNS)


def test_events_wait_for_the_watermark_and_leave_once(spark, tmp_path):
    start = at("2024-01-01")
    events = spark.createDataFrame(
        [("o", 1, start, "CONFIRMED"), ("o", 2, start + timedelta(hours=3), "PROCESSING"),
         ("p", 3, start + timedelta(hours=3, minutes=30), "CONFIRMED"), ("o", 4, start + timedelta(minutes=1), "CANCELLED")],
        schema.STATUS_EVENTS,
    )
    arrivals = [f"event_id = {n}" for n in (1, 2, 3, 4)]
    # the last one is older than the watermark when it arrives; two are not passed by it yet
    got = jobs.run_once(jobs.stream_status_machine(stream_of(spark, events, tmp_path / "a", arrivals), lateness="1 hour"))
    assert rows(got, *COLUMNS) == [("o", 1, "PENDING", "CONFIRMED", True)]
    in_time = stream_of(spark, events, tmp_path / "b", arrivals)
    got = jobs.run_to_the_end(in_time, CLOSING, lambda e: jobs.stream_status_machine(e, lateness="5 hours"))
    assert rows(got, *COLUMNS) == [
        ("o", 1, "PENDING", "CONFIRMED", True), ("o", 2, "CANCELLED", "PROCESSING", False),
        ("o", 4, "CONFIRMED", "CANCELLED", True), ("p", 3, "PENDING", "CONFIRMED", True),
    ]


def test_daily_sales_over_several_triggers(spark, make_orders, tmp_path):
    orders = make_orders(
        ("a", "u", "SHIPPED", "1.00", "2024-01-01 01:00:00"), ("b", "u", "SHIPPED", "2.00", "2024-01-01 23:59:59"),
        ("c", "v", "PENDING", "4.00", "2024-01-01"), ("d", "v", "DELIVERED", "8.00", "2024-01-02"),
    )
    stream = stream_of(spark, orders, tmp_path, ["id IN ('a', 'c')", "id = 'b'", "id = 'd'"])
    got = jobs.run_once(jobs.stream_daily_sales(stream), "complete")
    shown = ("status", "order_date", "order_count", "total_revenue", "unique_customers")
    assert [(s, str(d)[:10], n, float(r), u) for s, d, n, r, u in rows(got, *shown)] == [
        ("DELIVERED", "2024-01-02", 1, 8.0, 1), ("SHIPPED", "2024-01-01", 2, 3.0, 1)
    ]


def test_sketches_of_days_merge_into_months(spark, make_orders, tmp_path):
    """Customers come back on other days, so days may not be added up; sketches of pieces equal one of the whole."""
    random = Random(6)
    customers = [random.randrange(900) for _ in range(3_000)]
    orders = make_orders(*(
        (str(n), f"u{c}", "SHIPPED", "1.00", f"2024-0{1 + n % 2}-{1 + n % 28:02d} 10:00:00") for n, c in enumerate(customers)
    ))
    days = jobs.run_once(jobs.stream_daily_sales(stream_of(spark, orders, tmp_path, ["id < '5'", "id >= '5'"])), "complete")
    got = {str(r["order_date"])[:7]: r for r in jobs.merged_sales(days).collect()}
    for month in (1, 2):
        exact = len({c for n, c in enumerate(customers) if 1 + n % 2 == month})
        row = got[f"2024-0{month}"]
        assert row["order_count"] == 1_500 and abs(row["unique_customers"] - exact) <= 4 * 0.83 / 64 * exact
    assert sum(r["unique_customers"] for r in days.collect()) > 1_500
    pieces = days.unionByName(days)
    again = jobs.merged_sales(pieces, "day").orderBy("order_date").collect()
    want = days.orderBy("order_date").collect()
    assert [(r["order_count"], r["unique_customers"]) for r in again] == [(2 * r["order_count"], r["unique_customers"]) for r in want]


def test_repeated_numbers_are_dropped(spark, make_orders, tmp_path):
    orders = make_orders(*((i, "u", "PENDING", "1.00", "2024-01-01") for i in "abc"))
    same = orders.withColumn("order_number", F.when(F.col("id") != "c", "ORD-1-0001").otherwise(F.col("order_number")))
    stream = stream_of(spark, same, tmp_path, ["id = 'a'", "id = 'b'", "id = 'c'"])
    got = jobs.run_once(jobs.stream_new_orders_dedupe(stream))
    assert got.count() == 2 and got.select("order_number").distinct().count() == 2


def test_nothing_to_read(spark, make_orders, tmp_path):
    stream = stream_of(spark, make_orders(("a", "u", "PENDING", "1.00", "2024-01-01")), tmp_path, ["false"])
    assert jobs.run_once(jobs.stream_daily_sales(stream), "complete").count() == 0
