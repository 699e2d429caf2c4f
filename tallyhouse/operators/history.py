"""Replay of status events.

``events`` holds order_id, event_id, ts and to_status; the order of an order's events is (ts, event_id,
to_status). An event that asks for a move the present state does not allow is rejected and leaves the
state as it is, so it never becomes the predecessor of the next one.

An event is a map from states to states, and maps compose: (g after f) after e = g after (f after e). So
the table is sorted by order and time and cut into ranges wherever the ranges of the sort happen to end,
also inside an order, and every range composes the maps of its events on its own. It knows the state an
order starts with; for the one order that may have started in an earlier range it follows all states at
once. What no state at the start of a range leads to is rejected for good. Of a range a few events per
order are left, since the allowed moves contain no cycle; folded in order, they are the chain of accepted
events, which tells every event the state it met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import status as st

KEY = ("ts", "event_id", "to_status")


def move_table(enforce_final: bool = False) -> np.ndarray:
    """[asked][state] is the state after an event; the last row is an event that asks for none of them."""
    table = np.tile(np.arange(len(st.STORED), dtype=np.uint8), (len(st.STORED) + 1, 1))
    for state, targets in st.moves(enforce_final).items():
        for target in targets:
            table[st.STORED.index(target), st.STORED.index(state)] = st.STORED.index(target)
    return table


def composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``maps`` (events x states) composed from the first event of each run up to every event.

    ``first`` is the place of each event's run start. The stretch covered doubles with every step.
    """
    place, reach = np.arange(len(maps)), 1
    while len(maps) and reach <= int((place - first).max()):
        later = np.flatnonzero(place - reach >= first)
        maps[later] = np.take_along_axis(maps[later], maps[later - reach], axis=1)
        reach *= 2
    return maps


def _candidates(initial: str, enforce_final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filter for a sorted range of (order_id, ts, event_id, to_status): the events that some state at the
    start of the range leads to. Batches follow each other; only the composed map of the last order is kept."""
    table = move_table(enforce_final)
    states = np.arange(len(st.STORED), dtype=np.uint8)
    start = st.STORED.index(initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried, begun_here = None, states, False
        for batch in batches:
            if not batch.num_rows:
                continue
            orders = batch.column(0)
            asked = pc.fill_null(pc.index_in(batch.column(3), pa.array(st.STORED)), len(st.STORED)).to_numpy(zero_copy_only=False)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(orders[1:], orders[:-1]).to_numpy(zero_copy_only=False)
            new[0] = before is None or orders[0].as_py() != before
            run_of = np.cumsum(new | (np.arange(len(new)) == 0)) - 1
            heads = np.flatnonzero(np.diff(run_of, prepend=-1))
            first = heads[run_of]
            after = composed(table[asked], first)
            if not new[0]:
                own = run_of == 0
                after[own] = np.take_along_axis(after[own], np.broadcast_to(carried, (int(own.sum()), len(states))), axis=1)
            met = np.empty_like(after)
            met[1:] = after[:-1]
            met[heads] = states
            if not new[0]:
                met[0] = carried
            moves = np.take_along_axis(table[asked], met, axis=1) != met
            # the order a range begins with may have begun before it; the others begin with the initial state
            begins = (run_of > 0) | begun_here | bool(new[0] and before is not None)
            kept = np.where(begins, moves[:, start], moves.any(axis=1))
            begun_here, before, carried = bool(begins[-1]), orders[len(orders) - 1].as_py(), after[-1]
            yield batch.filter(pa.array(kept))

    return run


def _chains(events: DataFrame, initial: str, enforce_final: bool, ranges: int | None) -> DataFrame:
    """(order_id, chain): the accepted events of every order that has one, in order."""
    order = ["order_id", *KEY]
    cut = events.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in events.schema.fields)
    left = cut.mapInArrow(_candidates(initial, enforce_final), schema)

    def step(chain: Column, event: Column) -> Column:
        state = F.coalesce(F.try_element_at(chain, F.lit(-1))["to_status"], F.lit(initial))
        return F.when(
            st.is_move(state, event["to_status"], enforce_final), F.concat(chain, F.array(event))
        ).otherwise(chain)

    gathered = left.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("left"))
    nothing = F.array().cast(gathered.schema["left"].dataType)
    return gathered.select("order_id", F.aggregate("left", nothing, step).alias("chain"))


def status_history(
    events: DataFrame, initial: str = "PENDING", enforce_final: bool = False, ranges: int | None = None
) -> DataFrame:
    """Every event with the state it met and whether it was accepted. ``ranges`` is the number of ranges the
    sorted table is cut into, by default that of Spark's shuffles; the result does not depend on it.

    ``enforce_final`` refuses every change of a delivered order, its return included. Events that are equal
    in all columns are one event, and share its judgement. An event without an order, a time or an id of its
    own has no place in a history: it is rejected, and has met no state.
    """
    events = events.select("order_id", *KEY)
    placed = F.col("order_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()
    chains = _chains(events.where(placed), initial, enforce_final, ranges).withColumnRenamed("order_id", "of")

    def earlier(entry: Column) -> Column:
        return entry < F.struct(*KEY)

    met = F.try_element_at(F.filter("chain", earlier), F.lit(-1))["to_status"]
    judged = events.join(chains, F.col("order_id") == F.col("of"), "left")
    return judged.select(
        "order_id", "event_id", "ts", F.when(placed, F.coalesce(met, F.lit(initial))).alias("from_status"), "to_status",
    ).select(
        "order_id", "event_id", "ts", "from_status", "to_status",
        st.is_move(F.col("from_status"), F.col("to_status"), enforce_final).alias("accepted"),
    )


def status_changes(history: DataFrame) -> DataFrame:
    """The accepted events, as (order, status, timestamp, notes)."""
    note = F.concat_ws(" -> ", "from_status", "to_status")
    return history.where("accepted").select(
        "order_id", F.col("to_status").alias("status"), F.col("ts").alias("timestamp"), note.alias("notes")
    )


def final_states(history: DataFrame, initial: str = "PENDING") -> DataFrame:
    """Present state of every order with the number of its accepted and rejected events."""
    taken = F.when(F.col("accepted"), F.struct("ts", "event_id", "to_status"))
    return history.groupBy("order_id").agg(
        F.coalesce(F.max(taken)["to_status"], F.lit(initial)).alias("status"),
        F.count_if("accepted").alias("accepted_events"),
        F.count_if(~F.col("accepted")).alias("rejected_events"),
    )
