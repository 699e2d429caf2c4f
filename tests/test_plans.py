"""Properties of the physical plans, over contract tables stored as parquet."""

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyhouse import schema, session
from tallyhouse.operators import listings, stats, views
from tallyhouse.plans import QUERIES
from tallyhouse.plans.base import Shop
from tallyhouse.sources import star, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stored")
    shop = Shop(spark, SMALL)

    def as_contract(df, contract):
        return df.select(*(F.col(f.name).cast(f.dataType) for f in contract.fields))

    tables.write_table(as_contract(shop.addressed, schema.ORDERS), f"{base}/orders", "created_at", ("status", "user_id"))
    tables.write_table(as_contract(shop.items, schema.ORDER_ITEMS), f"{base}/items")
    return (
        tables.read_table(spark, f"{base}/orders", T_ORDERS),
        tables.read_table(spark, f"{base}/items", schema.ORDER_ITEMS),
    )


T_ORDERS = schema.T.StructType([*schema.ORDERS.fields, schema.T.StructField("order_month", schema.T.StringType())])


def test_written_table_is_whole_and_pruned_by_month(spark, stored):
    orders, items = stored
    shop = Shop(spark, SMALL)
    assert orders.count() == shop.orders.count() and items.count() == shop.items.count()
    month = orders.where("order_month = '1997-03'")
    assert "PartitionFilters: [isnotnull(order_month" in plan(month)
    expected = shop.orders.where("created_at >= '1997-03-01' AND created_at < '1997-04-01'").count()
    assert month.count() == expected


def test_filters_and_columns_reach_the_scan(stored):
    orders, items = stored
    text = plan(stats.total_sales(orders, datetime(1996, 1, 1), datetime(1996, 2, 1)))
    assert "In(status, [DELIVERED,SHIPPED])" in text and "GreaterThanOrEqual(created_at" in text
    assert "ReadSchema: struct<status:string,total_amount:decimal(10,2),created_at:timestamp>" in text
    text = plan(stats.quantity_sold_by_product(items, orders))
    assert "ReadSchema: struct<order_id:string,product_id:string,quantity:int>" in text
    assert "ReadSchema: struct<id:string,status:string>" in text
    text = plan(listings.high_value_orders(orders, Decimal("400000.00"), 10))
    assert "GreaterThanOrEqual(total_amount" in text and "TakeOrderedAndProject" in text


def test_ranked_groups_are_cut_before_the_shuffle(stored):
    text = plan(listings.recent_orders_per_user(stored[0], 3))
    partial = text.index("WindowGroupLimit", text.index("Exchange"))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < partial


def test_items_are_aggregated_before_they_meet_their_orders(spark, stored):
    orders, items = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(views.order_summary(orders, items))
        # one exchange per side: the grouped items are joined where they were grouped
        assert text.count("Exchange hashpartitioning") == 2
        text = plan(stats.bought_together(items, orders, 1))
        assert "Exchange hashpartitioning(order_id" in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_need_one_shuffle_of_the_items(spark, stored):
    orders, items = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show reused exchanges
    try:
        text = plan(stats.bought_together(items, orders, 2))
        item_scans = text.count("ReadSchema: struct<order_id:string,product_id:string,product_name:string>")
        assert item_scans == 1 and "ReusedExchange" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("min_frequency", [1, 2])
def test_pairs_meet_the_orders_once_for_each_use_of_the_lines(spark, stored, min_frequency):
    """Product counts per order come along with the lines: a join with them would do the work before it twice in a task."""
    orders, items = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(stats.bought_together(items, orders, min_frequency))
        on_order = [line for line in text.splitlines() if "SortMergeJoin [order_id" in line and "slice" not in line]
        assert len(on_order) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def sizes(spark):
    """The settings of the bytes of a task; they are as before after the test."""
    keys = (*session.MOST_BYTES, session.INITIAL_PARTITIONS)
    for key in keys:
        spark.conf.unset(key)
    yield keys
    for key in keys:
        spark.conf.unset(key)
    session.configure(spark)


def test_a_task_reads_few_bytes_and_files_keep_their_size(spark, sizes):
    shuffled, read, _ = sizes
    session.configure(spark)
    assert [session._bytes(spark.conf.get(key)) >> 20 for key in (shuffled, read)] == [16, 32]
    with session.file_sizes(spark):
        assert [session._bytes(spark.conf.get(key)) >> 20 for key in (shuffled, read)] == [64, 128]
    assert [session._bytes(spark.conf.get(key)) >> 20 for key in (shuffled, read)] == [16, 32]
    spark.conf.set(shuffled, "8m")
    session.configure(spark)
    assert spark.conf.get(shuffled) == "8m"


@pytest.mark.parametrize("name", ["check_stock_cumulative", "bought_together_all"])
def test_larger_tables_are_dealt_into_more_tasks(spark, sizes, monkeypatch, name):
    """Tables that are large for the session's 4 shuffle partitions: no task gets a fourth of the rows."""
    want = QUERIES[name](spark, SMALL).collect()
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
    monkeypatch.setattr(session, "STORED_BYTES_PER_PARTITION", 4 << 10)
    monkeypatch.setattr(session, "MOST_BYTES", dict.fromkeys(session.MOST_BYTES, 4 << 10))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = QUERIES[name](spark, SMALL)
        assert int(spark.conf.get(session.INITIAL_PARTITIONS)) == star.stored_bytes(spark, SMALL) >> 12
        assert sorted(dealt.collect()) == sorted(want)
        shares = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("*")).first()
        assert shares[0] < len(want) / 4 and shares[1] > 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, stored):
    orders, items = stored
    tables.save_bucketed(orders.drop("order_month"), "bucketed_orders", "id", 4)
    tables.save_bucketed(items, "bucketed_items", "order_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = stats.sold_items(spark.table("bucketed_items"), spark.table("bucketed_orders"))
        assert "Exchange" not in plan(joined)
        assert joined.count() == stats.sold_items(items, orders).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_building_a_plan_runs_nothing(spark):
    """Batch entries are plans alone; those that write a table to read it again, and the streams, run."""
    running = {name for name in QUERIES if name.startswith(("stream_", "merged_"))} | {"inventory_ledger"}
    tracker = spark.sparkContext.statusTracker()
    try:
        for name in sorted(set(QUERIES) - running):
            spark.sparkContext.setJobGroup(f"build {name}", name)
            QUERIES[name](spark, SMALL)
            assert len(tracker.getJobIdsForGroup(f"build {name}")) == 0, name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
