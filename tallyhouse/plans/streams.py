"""The streaming jobs, drained once over the parquet tables read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.base import Registered, Shop, with_sql
from tallyhouse.sources import star
from tallyhouse.streaming import jobs


def _order_stream(shop: Shop) -> DataFrame:
    return star.stream_table(shop.spark, shop.folder, "orders").select(*star.order_columns())


def _machine(shop: Shop) -> DataFrame:
    shop.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    events = star.stream_table(shop.spark, shop.folder, "events").select(*star.event_columns())
    closing = {"order_id": 0, "event_id": 0, "ts": jobs.CLOSING}
    return jobs.run_to_the_end(events, closing, jobs.stream_status_machine)


def _sales(shop: Shop) -> DataFrame:
    return jobs.run_once(jobs.stream_daily_sales(_order_stream(shop)), "complete")


def _counted(sales: DataFrame, shop: Shop, period: str) -> DataFrame:
    """The estimate next to the exact number of customers: it may be off by four standard errors."""
    exact = (
        shop.orders.where(F.col("status").isin("SHIPPED", "DELIVERED"))
        .groupBy("status", F.date_trunc(period, "created_at").alias("order_date"))
        .agg(F.count_distinct("user_id").alias("exact_customers"))
    )
    allowed = F.col("exact_customers") * (4 * 0.83 / 2 ** (jobs.SKETCH_BITS / 2)) + 0.5
    return sales.join(exact, ["status", "order_date"]).select(
        "status", "order_date", "order_count", F.col("total_revenue").cast("double").alias("total_revenue"), "exact_customers",
        (F.abs(F.col("unique_customers") - F.col("exact_customers")) <= allowed).alias("estimate_close"),
    )


def _daily(shop: Shop) -> DataFrame:
    return _counted(_sales(shop), shop, "day")


def _monthly(shop: Shop) -> DataFrame:
    return _counted(jobs.merged_sales(_sales(shop)), shop, "month")


def _sales_sql(period: str) -> str:
    return with_sql(
        f"""SELECT status, cast(date_trunc('{period}', created_at) AS timestamp) AS order_date,
                  count(*) AS order_count, cast(sum(total_amount) AS double) AS total_revenue,
                  count(DISTINCT user_id) AS exact_customers, true AS estimate_close
           FROM o WHERE status IN ('SHIPPED', 'DELIVERED') GROUP BY 1, 2""",
        "o",
    )


def _dedupe(shop: Shop) -> DataFrame:
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    stream = _order_stream(shop).withColumn("_copy", twice).drop("_copy")
    return jobs.run_once(jobs.stream_new_orders_dedupe(stream, "1 day")).select("id", "order_number", "created_at")


QUERIES: dict[str, Registered] = {
    "stream_status_machine": Registered(
        _machine,
        with_sql("SELECT order_id, event_id, ts, from_status, to_status, accepted FROM replay", "replay"),
    ),
    "stream_daily_sales": Registered(_daily, _sales_sql("day")),
    "stream_monthly_sales": Registered(_monthly, _sales_sql("month")),
    "stream_new_orders_dedupe": Registered(
        _dedupe, with_sql("SELECT id, order_number, created_at FROM o", "o")
    ),
}
