from datetime import timedelta
from decimal import Decimal
from random import Random

import numpy as np
import pytest
from conftest import ADDRESS, at, rows
from pyspark.sql import functions as F

from tallyhouse import schema
from tallyhouse.functions import status as st
from tallyhouse.operators import effects, history, requests, skew, updates
from tallyhouse.schema import T

HEADERS = T.StructType(
    [
        T.StructField("request_id", T.StringType()), T.StructField("user_id", T.StringType()),
        T.StructField("shipping_address", schema.ADDRESS), T.StructField("billing_address", schema.ADDRESS),
        T.StructField("requested_at", T.TimestampType()),
    ]
)
PLACE = ("123 Main St", None, "New York", "NY", "10001", "USA")


@pytest.fixture
def many_ranges(spark):
    """Sorted tables are cut into more ranges than there are orders, and nothing puts them together again."""
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # batches end inside orders too
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def make_requests(spark, **wanted):
    """Headers and lines from request=[(product, quantity), ...]."""
    requested = [(name, f"user-{name}", PLACE, PLACE, at("2024-01-01")) for name in wanted]
    lines = [(name, n, p, q) for name, items in wanted.items() for n, (p, q) in enumerate(items)]
    return (
        spark.createDataFrame(requested, HEADERS),
        spark.createDataFrame(lines, "request_id string, line_no int, product_id string, quantity int"),
    )


@pytest.fixture(scope="module")
def products(make_products):
    return make_products(
        ("p", "Pen", "99.99", True, 10), ("q", "Quill", "5.00", False, 10), ("r", "Ruler", "1.00", None, None),
        ("s", "Stand", "99999999.00", True, 10), ("t", "Tape", None, True, 10),
    )


def test_acceptance_and_first_reason(spark, products):
    headers, lines = make_requests(
        spark, good=[("p", 2)], empty=[], unknown_last=[("q", 1), ("p", 99), ("zzz", 1)],
        stock=[("p", 11), ("q", 1)], none=[("r", 1)], huge=[("s", 2)], unpriced=[("t", 1)], zero=[("p", 2), ("p", 0)],
    )
    got = {r["request_id"]: r for r in requests.assess_requests(headers, lines, products).collect()}
    assert got["good"]["accepted"] and got["good"]["total_amount"] == Decimal("199.98")
    assert (got["empty"]["reject_code"], got["empty"]["outer_code"]) == ("EMPTY_ORDER", "ORDER_CREATION_FAILED")
    assert "at least one item" in got["empty"]["message"]
    # an unknown product on the last line comes before stock problems on earlier ones
    assert got["unknown_last"]["reject_code"] == "PRODUCT_NOT_FOUND"
    assert got["unknown_last"]["outer_code"] == "PRODUCT_VALIDATION_FAILED"
    assert got["unknown_last"]["message"] == "Product not found: zzz"
    assert got["stock"]["message"] == "Insufficient inventory for product Pen. Requested: 11, Available: 10"
    assert got["none"]["reject_code"] == "PRODUCT_OUT_OF_STOCK"
    assert got["zero"]["reject_code"] == "QUANTITY_NOT_POSITIVE"
    assert got["huge"]["reject_code"] == got["unpriced"]["reject_code"] == "TOTAL_NOT_PRICEABLE"


def test_lines_of_one_product_add_up_only_when_asked(spark, products):
    headers, lines = make_requests(spark, twice=[("p", 6), ("p", 6)])
    assert rows(requests.check_stock(headers, lines, products), "accepted") == [(True,)]
    strict = requests.check_stock(headers, lines, products, cumulative=True)
    assert rows(strict, "accepted", "message") == [
        (False, "Insufficient inventory for product Pen. Requested: 12, Available: 10")
    ]


def test_quantities_beyond_any_stock_are_rejected_not_failed(spark, products):
    headers, lines = make_requests(spark, much=[("p", 2_000_000_000), ("p", 2_000_000_000), ("s", 1)])
    for cumulative in (False, True):
        checked = requests.check_stock(headers, lines, products, cumulative)
        assert rows(checked, "reject_code") == [("INSUFFICIENT_INVENTORY",)]


def test_array_form_of_requests(spark, products):
    data = [("a", "u", [("p", 2), ("q", 1)], PLACE, PLACE), ("b", "u", [], PLACE, PLACE)]
    lines = requests.explode_requests(spark.createDataFrame(data, schema.ORDER_REQUESTS))
    assert rows(lines) == [("a", 0, "p", 2), ("a", 1, "q", 1)]
    assert rows(requests.price_requests(lines, products)) == [("a", 2, Decimal("204.98"))]


def test_creation(spark, products):
    headers, lines = make_requests(spark, good=[("p", 2), ("p", 1)], bad=[("q", 1)], empty=[])
    none = spark.createDataFrame([], "order_number string")
    created = requests.create_orders(headers, lines, products, none)
    order = created.orders.collect()
    assert [(o["id"], o["status"], o["total_amount"]) for o in order] == [("good", "PENDING", Decimal("299.97"))]
    assert order[0]["order_number"] == "ORD-1704067200000-0001" and order[0]["shipping_address"] == ADDRESS
    assert rows(created.items, "order_id", "product_name", "quantity", "total_price") == [
        ("good", "Pen", 1, Decimal("99.99")), ("good", "Pen", 2, Decimal("199.98"))
    ]
    assert rows(created.rejects, "request_id", "reject_code") == [
        ("bad", "PRODUCT_OUT_OF_STOCK"), ("empty", "EMPTY_ORDER")
    ]


def test_numbers_skip_used_ones(spark):
    new = spark.createDataFrame([(n, at("2024-01-01")) for n in "abcd"], "id string, created_at timestamp")
    used = spark.createDataFrame(
        [("ORD-1704067200000-0002",), ("ORD-1704067200000-0003",), ("ORD-1704067200001-0001",), ("other",)],
        "order_number string",
    )
    got = rows(requests.assign_order_numbers(new, used), "id", "order_number")
    assert got == [(i, f"ORD-1704067200000-{c:04d}") for i, c in zip("abcd", (4, 5, 6, 7))]


def test_a_millisecond_never_runs_out_of_numbers(spark):
    new = spark.range(25_000).select(F.col("id"), F.lit(at("2024-01-01")).alias("created_at"))
    used = spark.createDataFrame([("ORD-1704067200000-9999",), ("ORD-1704067200000-0001",)], "order_number string")
    got = requests.assign_order_numbers(new, used).select("order_number").cache()
    assert got.distinct().count() == 25_000 and got.where("order_number IS NULL").count() == 0
    assert got.join(used, "order_number").count() == 0
    again = requests.assign_order_numbers(new, got).select("order_number")
    assert again.union(got).distinct().count() == 50_000


@pytest.mark.parametrize("ids", [
    [n * n - 5_000 for n in range(3_000)], [*range(-9, 10**18, 10**15), 2**63 - 1, -(2**63), None],
    [f"order-{n:07d}" for n in range(3_000)], [f"{hash((n, 7)) % 2**64:016x}" for n in range(2_000)] + ["", "é", "zzzzzz" * 9, None],
    ["a" * n for n in range(1_200)], ["same"] * 1_500,
])
def test_numbers_follow_the_ids_over_all_ranges(spark, monkeypatch, ids):
    monkeypatch.setattr(requests, "ORDERS_PER_RANGE", 100)
    kind = "string" if isinstance(ids[0], str) else "bigint"
    rows_in = [(i, at("2024-01-01")) for i in ids] + [(i, at("2024-01-02")) for i in ids[:50]]
    new = spark.createDataFrame(rows_in, f"id {kind}, created_at timestamp").repartition(4, "id")
    used = spark.createDataFrame([("ORD-1704067200000-0007",)], "order_number string")
    got = sorted(
        requests.assign_order_numbers(new, used).select("created_at", "order_number", "id").collect(),
        key=lambda r: (r[0], int(r[1].split("-")[2])),
    )
    def place(i):
        return (i is not None, i.encode() if isinstance(i, str) else i)
    assert [r["id"] for r in got[: len(ids)]] == sorted(ids, key=place)
    assert [r["order_number"] for r in got[: len(ids)]] == [f"ORD-1704067200000-{n + 8:04d}" for n in range(len(ids))]
    assert [r["id"] for r in got[len(ids):]] == sorted(ids[:50], key=place)


def test_one_millisecond_is_ranked_in_many_tasks(spark, many_ranges):
    new = spark.range(200_000).select(F.concat(F.lit("o"), F.lpad("id", 9, "0")).alias("id"), F.lit(at("2024-01-01")).alias("created_at"))
    got = requests.assign_order_numbers(new, spark.createDataFrame([], "order_number string"))
    wrong = got.where("order_number <> concat('ORD-1704067200000-', lpad(cast(cast(substr(id, 2) AS int) + 1 AS string), greatest(4, length(cast(cast(substr(id, 2) AS int) + 1 AS string))), '0'))")
    assert wrong.count() == 0
    stamped = new.withColumn("_ms", F.unix_millis("created_at"))
    assert [r["_shares"] for r in requests._id_ranges(stamped).collect()] == [20]
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 5 and max(tasks) < 100_000


def test_no_time_no_number(spark):
    new = spark.createDataFrame([("a", None), ("b", at("2024-01-01"))], "id string, created_at timestamp")
    got = rows(requests.assign_order_numbers(new, spark.createDataFrame([], "order_number string")), "id", "order_number")
    assert got == [("a", None), ("b", "ORD-1704067200000-0001")]


# --- updates -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def orders(make_orders):
    return make_orders(
        ("a", "u", "PENDING", "10.00", "2024-01-01"), ("b", "u", "DELIVERED", "10.00", "2024-01-01"),
        ("c", "u", "CONFIRMED", "10.00", "2024-01-01"), ("d", "u", "PENDING", "10.00", "2024-01-01"),
    )


def test_updates(spark, orders):
    schema_ = T.StructType([*schema.ORDER_UPDATES.fields, T.StructField("update_id", T.IntegerType())])
    moved = ("9 New Rd", "B", "Boston", "MA", "02101", "USA")
    batch = spark.createDataFrame(
        [("a", "PENDING", moved, None, 1), ("a", "CONFIRMED", moved, None, 2), ("a", "CANCELLED", None, None, 3),
         ("b", "PENDING", None, None, 4), ("c", "PROCESSING", None, None, 5), ("x", "CONFIRMED", None, None, 6),
         ("d", "SHIPPED", None, moved, 7)], schema_,
    )
    got = rows(updates.order_update_outcomes(orders, batch), "order_id", "update_id", "outcome")
    assert got == [
        ("a", 1, "INVALID_STATUS_TRANSITION"), ("a", 2, "DONE"), ("a", 3, "ORDER_NOT_MODIFIABLE"),
        ("b", 4, "ORDER_NOT_MODIFIABLE"), ("c", 5, "ORDER_NOT_MODIFIABLE"), ("d", 7, "INVALID_STATUS_TRANSITION"),
        ("x", 6, "ORDER_NOT_FOUND"),
    ]
    after = {r["id"]: r for r in updates.apply_order_updates(orders, batch, at("2024-02-01")).collect()}
    assert after["a"]["status"] == "CONFIRMED" and after["a"]["updated_at"] == at("2024-02-01")
    assert '"city":"Boston"' in after["a"]["shipping_address"] and after["a"]["billing_address"] == ADDRESS
    assert after["d"]["status"] == "PENDING" and after["d"]["updated_at"] == at("2024-01-01")


def test_bulk_and_final_rule(spark, orders):
    def ask(status, *ids):
        return spark.createDataFrame([(i, status) for i in ids], "order_id string, new_status string")

    # the second entry for an order finds it already moved
    assert rows(updates.bulk_status_update(orders, ask("CONFIRMED", "a", "a", "d", "x"))) == [(4, 2, 2)]
    returned = ask("RETURNED", "b")
    assert rows(updates.bulk_status_update(orders, returned)) == [(1, 1, 0)]
    assert rows(updates.bulk_status_update(orders, returned, enforce_final=True)) == [(1, 0, 1)]
    assert rows(updates.bulk_status_update(orders, returned.where("false"))) == [(0, 0, 0)]
    # contradictory entries of one order all fail, whichever of them would be allowed
    both = ask("CONFIRMED", "a", "a").union(ask("CANCELLED", "a")).union(ask("RETURNED", "b"))
    assert rows(updates.bulk_status_outcomes(orders, both), "order_id", "new_status", "outcome", "successful", "failed") == [
        ("a", "CANCELLED", "CONFLICTING_STATUSES", 0, 1), ("a", "CONFIRMED", "CONFLICTING_STATUSES", 0, 2), ("b", "RETURNED", "DONE", 1, 0),
    ]


def test_cancellation(spark, orders):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("x",)], "order_id string")
    assert rows(updates.cancel_orders(orders, keys), "order_id", "outcome") == [
        ("a", "DONE"), ("b", "ORDER_NOT_CANCELLABLE"), ("c", "DONE"), ("x", "ORDER_NOT_FOUND")
    ]
    after = dict(rows(updates.apply_cancellations(orders, keys, at("2024-02-01")), "id", "status"))
    assert after == {"a": "CANCELLED", "b": "DELIVERED", "c": "CANCELLED", "d": "PENDING"}


# --- history -----------------------------------------------------------------------------------


def make_events(spark, **histories):
    start = at("2024-01-01")
    events = [
        (order, n, start + timedelta(minutes=n // 2), target)
        for order, targets in histories.items() for n, target in enumerate(targets)
    ]
    return spark.createDataFrame(events, schema.STATUS_EVENTS)


def replayed(targets, state="PENDING"):
    out = []
    for n, target in enumerate(targets):
        accepted = target in st.MOVES.get(state, ())
        out.append((n, state, target, accepted))
        state = target if accepted else state
    return out


def test_rejected_events_do_not_become_predecessors(spark):
    events = make_events(
        spark, full=["CONFIRMED", "SHIPPED", "PROCESSING", "SHIPPED", "DELIVERED", "CONFIRMED", "RETURNED"],
        cancelled=["SHIPPED", "CONFIRMED", "CANCELLED", "PROCESSING"], stuck=["DELIVERED"] * 9,
    )
    got = history.status_history(events)
    accepted = rows(got.where("accepted"), "order_id", "to_status")
    assert accepted == sorted(
        [("full", s) for s in ("CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "RETURNED")]
        + [("cancelled", s) for s in ("CONFIRMED", "CANCELLED")], key=repr
    )
    assert rows(history.final_states(got)) == [
        ("cancelled", "CANCELLED", 2, 2), ("full", "RETURNED", 5, 2), ("stuck", "PENDING", 0, 9)
    ]


def test_delivered_orders_return_unless_final_states_are_enforced(spark):
    events = make_events(spark, o=["CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "RETURNED"])
    assert history.status_history(events).where("accepted").count() == 5
    strict = history.status_history(events, enforce_final=True)
    assert rows(history.final_states(strict)) == [("o", "DELIVERED", 4, 1)]


def random_histories(random, sizes):
    targets = ["CONFIRMED", "PROCESSING", "SHIPPED", "DELIVERED", "RETURNED", "REFUNDED", "PENDING", "CANCELLED", None, "?"]
    weights = [4, 3, 3, 2, 1, 1, 2]
    return {f"o{n}": random.choices(targets, [*weights, n % 3 * 0.1, 1, 1], k=size) for n, size in enumerate(sizes)}


def test_random_histories_against_a_plain_loop(spark, many_ranges):
    # the last order has two thirds of all events, so most ranges begin and end inside it
    histories = random_histories(Random(11), [1, 0, 2, 3, 1, 40, 5, 9, 200, 1, 7, 600])
    got = history.status_history(make_events(spark, **histories).repartition(5))
    want = [(order, *row) for order, asked in histories.items() for row in replayed(asked)]
    assert rows(got, "order_id", "event_id", "from_status", "to_status", "accepted") == sorted(want, key=repr)


def test_a_chain_over_many_ranges(spark, many_ranges):
    """Each accepted event lies in another range, among events that a wrong state would accept."""
    noise = ["RETURNED", "SHIPPED", "DELIVERED"]
    asked = noise * 60 + ["CONFIRMED"] + noise * 60 + ["PROCESSING"] + ["CONFIRMED", "DELIVERED"] * 80 + ["SHIPPED"] + ["PENDING"] * 99 + noise * 5
    got = history.status_history(make_events(spark, o=asked, p=["CONFIRMED"]))
    want = [(order, *row) for order, events in (("o", asked), ("p", ["CONFIRMED"])) for row in replayed(events)]
    assert rows(got, "order_id", "event_id", "from_status", "to_status", "accepted") == sorted(want, key=repr)


def test_one_order_does_not_meet_in_one_task(spark):
    plan = history.status_history(make_events(spark, o=["CONFIRMED"]))._jdf.queryExecution().optimizedPlan().toString()
    before, _, _ = plan.partition("MapInArrow")
    assert "RepartitionByExpression" in plan.partition("MapInArrow")[2] and "collect_list" in before


def test_composed_maps_equal_steps():
    random = np.random.default_rng(5)
    first = np.repeat([0, 1, 4, 5, 60], [1, 3, 1, 55, 40])
    maps = random.integers(0, 8, (100, 8)).astype(np.uint8)
    want = maps.copy()
    for n in range(100):
        if n > first[n]:
            want[n] = maps[n][want[n - 1]]
    assert (history.composed(maps.copy(), first) == want).all() and len(history.composed(maps[:0], first[:0])) == 0


def test_events_without_a_place_are_rejected(spark):
    first = at("2024-01-01")
    events = spark.createDataFrame(
        [("o", 1, None, "CONFIRMED"), ("o", 2, first, "PROCESSING"), ("o", 3, first, "CONFIRMED"), ("o", None, first, "CANCELLED"),
         (None, 4, first, "CONFIRMED"), (None, 5, None, "CONFIRMED"), ("o", 3, first, "CONFIRMED"), ("o", 6, first, None)],
        schema.STATUS_EVENTS,
    )
    assert rows(history.status_history(events), "order_id", "event_id", "from_status", "accepted") == sorted([
        ("o", 1, None, False), ("o", 2, "PENDING", False), ("o", 3, "PENDING", True), ("o", 3, "PENDING", True),
        ("o", None, None, False), (None, 4, None, False), (None, 5, None, False), ("o", 6, "CONFIRMED", False),
    ], key=repr)


def test_hot_keys_beyond_the_driver_limit_stay_a_table(spark, monkeypatch):
    table = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert skew.hot_keys(table, "k", 10) is None
    assert rows(skew.hot_keys(table, "k", 9)) == [(k, 10) for k in range(10)]
    monkeypatch.setattr(skew, "KEYS_ON_DRIVER", 3)
    assert rows(skew.hot_keys(table, "k", 9)) == [(k, 10) for k in range(10)]


# --- effects -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def changes(spark):
    data = [
        ("a", 1, "create", None, "PENDING"), ("a", 2, "status", "PENDING", "CONFIRMED"),
        ("a", 3, "status", "CONFIRMED", "PROCESSING"), ("a", 4, "status", "PROCESSING", "SHIPPED"),
        ("a", 5, "status", "SHIPPED", "DELIVERED"), ("c", 6, "create", None, "PENDING"),
        ("c", 7, "status", "PENDING", "CANCELLED"), ("d", 8, "create", None, "PENDING"),
        ("d", 9, "cancel", "PENDING", "CANCELLED"),
    ]
    columns = "order_id string, event_id bigint, via string, from_status string, to_status string"
    return spark.createDataFrame(data, columns).withColumn("ts", F.lit(at("2024-01-01")))


def test_stock(changes, make_items, make_products):
    items = make_items(("1", "a", "p", "P", 2, "1.00"), ("2", "c", "p", "P", 3, "1.00"), ("3", "d", "p", "P", 4, "1.00"))
    movements = effects.inventory_movements(changes, items)
    assert rows(movements, "order_id", "movement", "quantity") == [
        ("a", "CONFIRM_SALE", 2), ("a", "RESERVE", 2), ("c", "RELEASE", 3), ("c", "RESERVE", 3), ("d", "RESERVE", 4)
    ]  # the cancellation route releases nothing
    products = make_products(("p", "P", "1.00", True, 10), ("q", "Q", "1.00", None, None))
    assert rows(effects.inventory_position(movements, products)) == [("p", 10, 4, 2, 4), ("q", 0, 0, 0, 0)]


def make_payments(spark, *states):
    data = [
        (f"pay-{order}", f"PAY-{order}", order, "u", Decimal("10.00"), "USD", "CREDIT_CARD", status, None, reason,
         None, None, None) for order, status, reason in states
    ]
    return spark.createDataFrame(data, schema.PAYMENTS)


def test_payments(spark, changes, orders):
    assert rows(effects.payment_requests(changes, orders), "order_id", "amount", "currency", "payment_method") == [
        ("a", Decimal("10.00"), "USD", "CREDIT_CARD")
    ]
    answers = make_payments(spark, ("a", "COMPLETED", None), ("b", "FAILED", "no"), ("c", "PENDING", None))
    assert rows(effects.payment_outcomes(orders, answers), "order_id", "outcome", "payment_failed", "final_status") == [
        ("a", "PAID", False, "CONFIRMED"), ("b", "FAILED", True, "CONFIRMED"),
        ("c", "OTHER", False, "CONFIRMED"), ("d", "UNAVAILABLE", True, "CONFIRMED"),
    ]
    assert rows(effects.refund_requests(answers, "late"), "payment_id", "reason")[0] == ("pay-a", "late")


def test_messages(spark, changes, orders):
    with_count = orders.withColumn("item_count", F.lit(1))
    paid = effects.notification_outbox(changes, with_count, make_payments(spark, ("a", "COMPLETED", None)))
    got = paid.collect()
    kinds = sorted((r["order_id"], r["type"]) for r in got)
    assert kinds == [
        ("a", "ORDER_CONFIRMATION"), ("a", "ORDER_DELIVERED"), ("a", "ORDER_SHIPPED"),
        *[("a", "ORDER_STATUS_UPDATE")] * 4, ("a", "PAYMENT_CONFIRMATION"),
        ("c", "ORDER_CANCELLATION"), ("c", "ORDER_CONFIRMATION"), ("c", "ORDER_STATUS_UPDATE"),
        ("d", "ORDER_CONFIRMATION"),
    ]
    by_type = {r["type"]: r for r in got if r["order_id"] == "a"}
    number = "ORD-1234567890-0001"
    assert by_type["ORDER_SHIPPED"]["variables"]["trackingNumber"] == f"TRK-{number}"
    assert by_type["PAYMENT_CONFIRMATION"]["variables"]["amount"] == "10.00 USD"
    assert by_type["ORDER_CONFIRMATION"]["subject"] == f"Order Confirmation - {number}"
    assert by_type["ORDER_CONFIRMATION"]["recipient"] == "user-u@example.com"
    failed = effects.notification_outbox(changes, with_count, make_payments(spark, ("a", "FAILED", None)))
    row = failed.where("type = 'PAYMENT_FAILURE'").collect()
    assert [r["variables"]["reason"] for r in row] == ["Payment processing failed"]


def test_priorities_and_channels(spark):
    data = [("PAYMENT_FAILURE", "a@b"), ("PAYMENT_CONFIRMATION", "+4915112345"), ("LOW_INVENTORY_ALERT", "x"),
            ("CUSTOM", None), ("ORDER_SHIPPED", "0123")]
    got = effects.enrich_notifications(spark.createDataFrame(data, "type string, recipient string"))
    assert rows(got, "type", "priority", "is_immediate", "is_email", "is_sms") == [
        ("CUSTOM", "NORMAL", False, False, False), ("LOW_INVENTORY_ALERT", "LOW", False, False, False),
        ("ORDER_SHIPPED", "NORMAL", False, False, False), ("PAYMENT_CONFIRMATION", "MEDIUM", True, False, True),
        ("PAYMENT_FAILURE", "HIGH", True, True, False),
    ]


def test_low_stock(products):
    assert rows(effects.low_inventory_alerts(products, 10), "subject") == [("Low Inventory Alert - Ruler",)]
