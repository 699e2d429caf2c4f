from decimal import Decimal

from conftest import ADDRESS, at, rows
from pyspark.sql import functions as F

from tallyhouse import schema
from tallyhouse.functions import address, money
from tallyhouse.functions import status as st
from tallyhouse.operators import addresses, enrich, quality


def addressed(spark, *tuples):
    return spark.createDataFrame([(n, t) for n, t in enumerate(tuples)], schema.T.StructType(
        [schema.T.StructField("id", schema.T.IntegerType()), schema.T.StructField("a", schema.ADDRESS)]
    ))


def test_flags_of_every_state(spark):
    states = [*st.STORED, "COMPLETED", None]
    df = spark.createDataFrame([(s,) for s in states], "status string")
    s = F.col("status")
    got = {r[0]: tuple(r)[1:] for r in df.select(
        s, st.is_final(s), st.can_cancel(s), st.can_modify(s), st.is_active(s), F.size(st.next_statuses(s))
    ).collect()}
    assert got["PENDING"] == (False, True, True, True, 2)
    assert got["DELIVERED"] == (True, False, False, True, 1)
    assert got["REFUNDED"] == (True, False, False, False, 0)
    assert got["COMPLETED"] == (False, False, False, True, 0)
    assert got[None] == (False, False, False, False, 0)


def test_moves(spark):
    pairs = [("DELIVERED", "PENDING"), ("DELIVERED", "RETURNED"), ("PENDING", "PENDING"), (None, "CONFIRMED"),
             ("PENDING", None), ("PROCESSING", "SHIPPED")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(st.is_move(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, False, False, False, True]
    assert st.longest_path() == 5


def test_postal_codes(spark):
    cases = [
        ("usa", "12345", True), ("USA", "12345-6789", True), ("United States", "1234", False),
        ("CA", "K1A 0B1", True), ("canada", "k1a0b1", True), ("Canada", "12345", False),
        ("UK", "SW1A 1AA", True), ("GB", "M1 1AE", True), ("UK", "12345", False),
        ("France", "whatever", True), (None, "12345", False), ("USA", None, False), ("USA", "12345\n", False),
    ]
    df = addressed(spark, *(("l", None, "c", "s", code, country) for country, code, _ in cases))
    got = [r[0] for r in df.orderBy("id").select(address.is_valid_postal(F.col("a"))).collect()]
    assert got == [valid for *_, valid in cases]


def test_printed_addresses(spark):
    df = addressed(
        spark,
        ("1 St", "Apt 2", "City", "ST", "k1a 0b1", "Canada"),
        ("1 St", "  ", "City", None, "1", None),
        (None, None, None, None, None, "USA"),
    )
    got = enrich.enrich_addresses(df, "a", "canada").orderBy("id").collect()
    assert got[0]["full_address"] == "1 St, Apt 2, City, ST k1a 0b1, Canada"
    assert got[0]["formatted_address"] == "1 St\nApt 2\nCity, ST k1a 0b1\nCanada"
    assert got[0]["normalized_postal"] == "K1A0B1" and got[0]["is_domestic"]
    assert got[0]["normalized"]["postalCode"] == "K1A 0B1"
    assert got[0]["address_summary"] == "1 St, City, ST"
    assert got[1]["full_address"] == "1 St, City, null 1, null"
    assert (got[1]["city_state"], got[1]["state_postal"]) == ("City", "1")
    assert not got[1]["is_domestic"] and got[1]["is_international"] and not got[1]["has_secondary_line"]
    assert (got[2]["city_state"], got[2]["address_summary"], got[2]["is_complete"]) == ("", "", False)


def test_addresses_as_json(spark, make_orders):
    orders = make_orders(("a", "u", "PENDING", "1.00", "2024-01-01"))
    parsed = addresses.parse_addresses(orders)
    row = parsed.collect()[0]
    assert row["shipping_address"]["city"] == "New York" and not row["address_error"]
    assert addresses.render_addresses(parsed).collect()[0]["billing_address"] == ADDRESS
    broken = addresses.parse_addresses(orders.withColumn("billing_address", F.lit("{not json")))
    assert broken.collect()[0]["address_error"]
    assert rows(addresses.address_rollup(orders, "billing_address", "state")) == [("NY", 1, Decimal("1.00"))]


def test_half_up_percentages(spark):
    df = spark.createDataFrame(
        [(Decimal("1.00"), Decimal("32.00")), (Decimal("1.00"), Decimal("3.00")), (Decimal("1.00"), Decimal("0.00")),
         (None, Decimal("1.00"))], "a decimal(10,2), b decimal(10,2)"
    )
    got = [r[0] for r in df.select(money.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal("3.1300"), Decimal("33.3300"), Decimal("0"), Decimal("0")]


def test_order_figures(make_orders, make_items):
    orders = make_orders(
        ("a", "u", "PENDING", "10.00", "2024-01-01", "2024-01-05 12:00:00"),
        ("b", "u", None, None, "2024-01-09 00:00:01"),
    )
    items = make_items(("1", "a", "p", "P", 2, "0.01", "0.01"), ("2", "a", "q", "Q", 3, "0.02", "0.02"))
    got = enrich.enrich_orders(orders, items, at("2024-01-10"), Decimal("10.00"), 4, product="p").orderBy("id").collect()
    a, b = got
    assert a["avg_item_value"] == Decimal("0.02")  # 0.015 rounds up
    assert (a["age_days"], a["is_overdue"], a["is_high_value"], a["contains_product"]) == (9, False, True, True)
    assert (a["total_quantity"], a["distinct_items"], a["same_address"]) == (5, 2, True)
    assert (b["age_days"], b["total_quantity"], b["avg_item_value"], b["is_high_value"]) == (0, 0, Decimal("0.00"), False)
    assert b["next_statuses"] == [] and not b["contains_product"]


def test_age_truncates_toward_zero(spark, make_orders, make_items):
    orders = make_orders(("a", "u", "PENDING", "1.00", "2024-01-10 12:00:00"))
    items = make_items(("1", "x", "p", "P", 1, "1.00"))
    got = enrich.enrich_orders(orders, items, at("2024-01-09"), Decimal("1.00"), 0).collect()[0]
    assert got["age_days"] == -1 and not got["is_overdue"]


def test_item_checks(make_orders, make_items, make_products):
    orders = make_orders(("a", "u", "PENDING", "8.00", "2024-01-01"), ("z", "u", "PENDING", "0.00", "2024-01-01"))
    items = make_items(
        ("1", "a", "p", "P", 2, "3.00"), ("2", "a", "q", " ", 1, "2.00", "2.01"), ("3", "z", "r", None, 1, "1.00"),
    )
    products = make_products(("p", "P", "4.00", True, 1), ("q", "Q", "0.00", True, 1), ("r", "R", "1.00", True, 1))
    got = enrich.enrich_items(items, orders, products, 2, Decimal("6.00")).orderBy("id").collect()
    one, two, three = got
    assert (one["discount_amount"], one["discount_pct"]) == (Decimal("2.00"), Decimal("25.0000"))
    assert (one["contribution_pct"], one["is_bulk"], one["is_high_value"]) == (Decimal("75.0000"), True, True)
    assert one["display_name"] == "P (SKU-p)" and one["total_price_correct"]
    assert not two["total_price_correct"] and not two["complete_product_info"] and two["discount_pct"] == 0
    assert three["display_name"] == "SKU-r" and three["contribution_pct"] == 0 and three["discount_amount"] == 0


def test_products_and_payments(spark, make_products):
    products = make_products(("p", None, "2.50", None, None), ("q", "Q", None, True, 3))
    p, q = enrich.enrich_products(products, 3).orderBy("id").collect()
    assert (p["is_in_stock"], p["safe_quantity"], p["is_available"], p["line_total"]) == (False, 0, False, Decimal("7.50"))
    assert (p["display_name"], p["is_complete"]) == ("SKU-p", False)
    assert (q["is_available"], q["line_total"]) == (True, Decimal("0.00"))
    payment = [("1", "PAY-1", "o", "u", Decimal("99.90"), "USD", "CHEQUE", "ODD", " ", None, None, None, None),
               ("2", "PAY-2", "o", "u", None, "USD", "PAYPAL", "PROCESSING", "G", "no", None, None, None)]
    one, two = enrich.enrich_payments(spark.createDataFrame(payment, schema.PAYMENTS)).orderBy("id").collect()
    assert (one["formatted_amount"], one["method_name"], one["status_name"]) == ("99.90 USD", "CHEQUE", "ODD")
    assert not one["has_gateway_id"] and not one["is_final"]
    assert (two["formatted_amount"], two["is_pending"], two["has_failure_reason"]) == ("N/A", True, True)


def test_quality_rules(spark, make_orders, make_items):
    orders = make_orders(
        ("a", "u", "COMPLETED", "-1.00", "2024-01-01"), ("b", None, "PENDING", None, "2024-01-01"),
        ("c", "u", "PENDING", "0.00", "2024-01-01"),
    )
    assert rows(quality.dq_orders(orders)) == [
        ("a", "status_unknown"), ("a", "total_amount_negative"), ("b", "total_amount_missing"), ("b", "user_id_missing"),
    ]
    items = make_items(("1", "a", "p", "P" * 256, 0, "1.00"), ("2", "x", "p", "P", 2, "1.00", "1.99"))
    assert rows(quality.dq_items(items)) == [
        ("1", "a", "product_name_too_long"), ("1", "a", "quantity_not_positive"), ("2", "x", "total_price_wrong"),
    ]
    assert rows(quality.dq_orphan_items(items, orders), "id") == [("2",)]
    doubled = orders.unionByName(orders.where("id = 'c'"))
    assert rows(quality.dq_duplicate_numbers(doubled)) == [("ORD-1234567890-0003", 2)]
    df = addressed(spark, ("1", "x" * 256, "c", "\t", "1#", "USA"))
    assert rows(quality.dq_addresses(df, "a", "id"), "rule") == [
        ("addressLine2_too_long",), ("postalCode_characters",), ("state_blank",)
    ]


def test_reconciliation(spark, make_orders, make_items):
    orders = make_orders(
        ("a", "u", "PENDING", "3.00", "2024-01-01"), ("b", "u", "PENDING", "5.00", "2024-01-01"),
        ("c", "u", "DELIVERED", "5.00", "2024-01-01"), ("d", "u", "PENDING", "5.00", "2024-01-01"),
    )
    items = make_items(("1", "a", "p", "P", 3, "1.00"), ("2", "b", "p", "P", 4, "1.00"), ("3", "c", "p", "P", 4, "1.00"))
    checked = quality.reconcile_totals(orders, items)
    assert rows(checked, "id", "new_total", "action") == [
        ("a", Decimal("3.00"), "KEEP"), ("b", Decimal("4.00"), "UPDATE"), ("c", Decimal("4.00"), "REFUSE"),
        ("d", Decimal("0.00"), "UPDATE"),
    ]
    after = quality.apply_reconciled(orders, checked, at("2024-02-01"))
    assert rows(after, "id", "total_amount", "updated_at") == [
        ("a", Decimal("3.00"), at("2024-01-01")), ("b", Decimal("4.00"), at("2024-02-01")),
        ("c", Decimal("5.00"), at("2024-01-01")), ("d", Decimal("0.00"), at("2024-02-01")),
    ]
    huge = make_items(*((str(n), "b", "p", "P", 2, "49999999.00") for n in range(3)))
    refused = quality.reconcile_totals(orders.where("id = 'b'"), huge)
    assert rows(refused, "new_total", "action") == [(Decimal("299999994.00"), "REFUSE")]
    assert rows(quality.apply_reconciled(orders, refused, at("2024-02-01")), "total_amount").count((Decimal("5.00"),)) == 3
    touched = spark.createDataFrame([("b",)], "order_id string")
    assert rows(quality.reconcile_totals(orders, items, touched), "id") == [("b",)]
