"""The three streaming jobs. Each takes a streaming DataFrame and returns one; ``run_once`` drains it
into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from tallyhouse.functions import status as st
from tallyhouse.session import shared_folder

SKETCH_BITS = 12
EVENTS_IN_MEMORY = 10_000
CLOSING = "2200-01-01 00:00:00"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _StatusMachine(StatefulProcessor):
    """Judges the events of an order that the watermark has passed, and keeps the state they lead to.

    What a trigger brings is later than all that was judged before, but in no order. The next accepted event is
    the first one behind the last that the present state allows, so a pass over the events finds it, and since
    the moves contain no cycle a few passes find all. More than ``in_memory`` events of one order wait in the
    state store between the passes.
    """

    def __init__(self, initial: str, enforce_final: bool, in_memory: int) -> None:
        self._initial = initial
        self._moves = st.moves(enforce_final)
        self._in_memory = in_memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "status string")
        self._many = handle.getListState("many", "us bigint, event_id bigint, to_status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = ((row["us"], row["event_id"], row["to_status"]) for row in rows)
        held, spilled = list(islice(events, self._in_memory)), False
        for event in events:
            spilled = True
            held.append(event)
            if len(held) >= self._in_memory:
                self._many.appendList(held)
                held = []
        if spilled and held:
            self._many.appendList(held)
        found = self._state.get()
        begun_with = found[0] if found else self._initial
        chain = self._chain(self._many.get if spilled else lambda: iter(held), begun_with)
        for event in self._many.get() if spilled else held:
            place, met = _place(event), begun_with
            for accepted, state in chain:
                if accepted >= place:
                    break
                met = state
            us, event_id, target = event
            yield Row(
                order_id=key[0], event_id=event_id, us=us, from_status=met, to_status=target,
                accepted=target in self._moves.get(met, ()),
            )
        if spilled:
            self._many.clear()
        if chain:
            self._state.update((chain[-1][1],))

    def _chain(self, events: Callable[[], Iterator[tuple]], state: str) -> list[tuple[tuple, str]]:
        """Place and target of the accepted events, in order."""
        chain: list[tuple[tuple, str]] = []
        while targets := self._moves.get(state, ()):
            allowed = (_place(event) for event in events() if event[2] in targets)
            first = min((place for place in allowed if not chain or place > chain[-1][0]), default=None)
            if first is None:
                break
            state = first[3]
            chain.append((first, state))
        return chain


def _place(event: tuple) -> tuple:
    us, event_id, target = event
    return us, event_id, target is not None, target or ""


def stream_status_machine(
    events: DataFrame, initial: str = "PENDING", enforce_final: bool = False, lateness: str = "1 hour",
    in_memory: int = EVENTS_IN_MEMORY,
) -> DataFrame:
    """The status replay as a stream: each event is emitted with the state it met and the verdict.

    An event is judged once the watermark, ``lateness`` behind the latest event, has passed it; until then
    events may arrive in any order. They wait in a streaming aggregation by order and time, which lets them go
    in the trigger that passes them; only these reach the state machine of their order. What arrives after the
    watermark is dropped, as by Spark's own stateful operators. Events without an order, a time or an id are
    emitted as rejected at once, without a state.
    """
    id_type = events.schema["order_id"].dataType.simpleString()
    schema = f"order_id {id_type}, event_id bigint, us bigint, from_status string, to_status string, accepted boolean"
    columns = ["order_id", "event_id", "ts", "from_status", "to_status", "accepted"]
    timed = events.select("order_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "to_status")
    placed = F.col("order_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()
    passed = (
        timed.where(placed).withWatermark("ts", lateness)
        .groupBy("order_id", "ts").agg(F.collect_list(F.struct("event_id", "to_status")).alias("events"))
        .select("order_id", F.unix_micros("ts").alias("us"), F.inline("events"))
    )
    judged = passed.groupBy("order_id").transformWithState(
        statefulProcessor=_StatusMachine(initial, enforce_final, in_memory), outputStructType=schema,
        outputMode="Append", timeMode="None",
    )
    unplaced = timed.where(~placed).withColumn("from_status", F.lit(None).cast("string")).withColumn("accepted", F.lit(False))
    return judged.withColumn("ts", F.timestamp_micros("us")).select(columns).unionByName(unplaced.select(columns))


def stream_daily_sales(orders: DataFrame, lateness: str = "1 day", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Sold orders per state and day over an append-only order stream, each order counted once.

    ``customers`` is a sketch of the distinct customers (HyperLogLog with 2^sketch_bits registers, a standard
    error of about 0.83 / 2^(sketch_bits / 2)) and ``unique_customers`` its estimate. Sketches merge, so rows
    of a day that arrive in several pieces, or the days of a month, are added up by ``merged_sales``.
    """
    sold = orders.where(st.is_sold(F.col("status")))
    timed = sold.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("day"), "status")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_amount").alias("total_revenue"),
            F.hll_sketch_agg("user_id", F.lit(sketch_bits)).alias("customers"),
        )
        .select(
            "status", F.col("day.start").alias("order_date"), "order_count", "total_revenue",
            F.hll_sketch_estimate("customers").alias("unique_customers"), "customers",
        )
    )


def merged_sales(sales: DataFrame, period: str = "month") -> DataFrame:
    """Rows of ``stream_daily_sales`` added up by state and period ("day" merges pieces of one day), in the
    same columns. A customer of several days counts once."""
    return (
        sales.groupBy("status", F.date_trunc(period, "order_date").alias("order_date"))
        .agg(
            F.sum("order_count").alias("order_count"), F.sum("total_revenue").alias("total_revenue"),
            F.hll_union_agg("customers").alias("customers"),
        )
        .select(
            "status", "order_date", "order_count", "total_revenue",
            F.hll_sketch_estimate("customers").alias("unique_customers"), "customers",
        )
    )


def stream_new_orders_dedupe(orders: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop orders whose number was already seen within the watermark."""
    timed = orders.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["order_number"])


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything that is available now and return the result table.

    Append results go to a parquet sink. In complete mode each trigger replaces the table of the one
    before, so its last version is returned. A ``folder`` used before goes on where it ended.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/table").outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")

    versions: list[int] = []

    def replace(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/version={version}")
        versions.append(version)

    writer.foreachBatch(replace).outputMode(mode).start().awaitTermination()
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table/version={max(versions)}")


def run_to_the_end(events: DataFrame, closing: dict, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of an append job over a stream that has ended: what waits for the watermark leaves too.

    When all events are processed, one more row, the values ``closing`` of some columns, follows them. Its
    time has to be far ahead, such as CLOSING, so that the watermark passes all others and never the row itself.
    """
    spark = events.sparkSession
    folder = shared_folder(spark, "ended")
    spark.createDataFrame([], events.schema).write.parquet(f"{folder}/closing")
    ends = spark.readStream.schema(events.schema).parquet(f"{folder}/closing")
    stream = job(events.unionByName(ends))
    run_once(stream, folder=folder)
    last = [F.lit(closing.get(field.name)).cast(field.dataType).alias(field.name) for field in events.schema.fields]
    spark.range(1).select(*last).write.mode("append").parquet(f"{folder}/closing")
    return run_once(stream, folder=folder)
