"""Order states as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored states, the flag groups and the allowed moves.
STORED = (
    "PENDING", "CONFIRMED", "PROCESSING", "SHIPPED",
    "DELIVERED", "CANCELLED", "RETURNED", "REFUNDED",
)
SOLD = ("DELIVERED", "SHIPPED")
CANCELLABLE = ("PENDING", "CONFIRMED")
MODIFIABLE = ("PENDING",)
FINAL = ("DELIVERED", "CANCELLED", "RETURNED", "REFUNDED")
INACTIVE = ("CANCELLED", "RETURNED", "REFUNDED")
MOVES = {
    "PENDING": ("CONFIRMED", "CANCELLED"),
    "CONFIRMED": ("PROCESSING", "CANCELLED"),
    "PROCESSING": ("SHIPPED", "CANCELLED"),
    "SHIPPED": ("DELIVERED", "RETURNED"),
    "DELIVERED": ("RETURNED",),
}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_sold(status: Column) -> Column:
    """The revenue predicate; left null-unsafe so that it is pushed to the scan."""
    return status.isin(*SOLD)


def can_cancel(status: Column) -> Column:
    return _flag(status.isin(*CANCELLABLE))


def can_modify(status: Column) -> Column:
    return _flag(status.isin(*MODIFIABLE))


def is_final(status: Column) -> Column:
    return _flag(status.isin(*FINAL))


def is_active(status: Column) -> Column:
    return _flag(~status.isin(*INACTIVE))


def next_statuses(status: Column) -> Column:
    """Array of states reachable in one move; empty for end states and for null."""
    reachable = F.lit(None).cast("array<string>")
    for state, targets in MOVES.items():
        reachable = F.when(status == state, F.array(*map(F.lit, targets))).otherwise(reachable)
    return F.coalesce(reachable, F.array().cast("array<string>"))


def moves(enforce_final: bool = False) -> dict[str, tuple[str, ...]]:
    """The allowed moves; ``enforce_final`` leaves none out of a final state, delivered ones included."""
    return {state: targets for state, targets in MOVES.items() if not (enforce_final and state in FINAL)}


def is_move(current: Column, target: Column, enforce_final: bool = False) -> Column:
    """True where ``current -> target`` is an allowed move; null on either side is not."""
    allowed = F.lit(False)
    for state, targets in moves(enforce_final).items():
        allowed = allowed | ((current == state) & target.isin(*targets))
    return _flag(allowed)


def longest_path() -> int:
    """Number of moves on the longest chain of states (the moves contain no cycle)."""

    def depth(state: str) -> int:
        return max((1 + depth(target) for target in MOVES.get(state, ())), default=0)

    return max(map(depth, MOVES))
