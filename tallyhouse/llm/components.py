"""Connected components of a link table, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect the neighbours of every node to the smallest one among them and the node itself.

    A large star moves the neighbours above the node, a small star those below it and the node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # only the minimum is needed of a node's neighbours, so a hub combines ahead of the shuffle
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    seen = both.join(least.hint("merge"), "a")
    if larger:
        moved = seen.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = seen.filter("b < a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            seen.filter("b < a").select("a", F.col("least").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, component_id) for every document in a link (a, b): the smallest id it can reach.

    Each step is stored, which cuts the lineage; the number of steps grows with the logarithm of the
    longest path. It ends when a step changes nothing.
    """
    current = scratch.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    state = _state(current)
    step = 0
    while state[0]:
        step += 1
        after = scratch.store(_star(_star(current, larger=True), larger=False), f"{name}-{step}")
        after_state = _state(after)
        scratch.drop(f"{name}-{step - 1}")
        current = after
        if after_state == state:
            break
        state = after_state
    # a star forest now: every node points at the smallest of its component
    return current.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id")).unionByName(
        current.select(F.col("b").alias("doc_id"), F.col("b").alias("component_id")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal states mean equal tables."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
