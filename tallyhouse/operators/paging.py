"""Sorted listings, pages of them, and the first rows per key."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank one task takes what every other task leaves of a key; beyond, salted shares do.
ONE_TASK_RANK = 1_000
SALTS = 64


class By(NamedTuple):
    """One column of a listing's order. Nulls come first or last as Spark has it: first when ascending."""

    name: str
    descending: bool = False

    def sorted(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)

    def same(self, value: Column) -> Column:
        return F.col(self.name).eqNullSafe(value)

    def behind(self, value: Column) -> Column:
        """Whether the column comes after ``value`` in this order."""
        column = F.col(self.name)
        if self.descending:
            return (column < value) | (column.isNull() & value.isNotNull())
        return (column > value) | (column.isNotNull() & value.isNull())


def page_of(df: DataFrame, order: list[Column], page: int | None = None, size: int | None = None) -> DataFrame:
    """The sorted listing, or one 0-based page of it. A page is cut out of the first ``(page + 1) * size``
    rows, which every task keeps of its own rows; pages far from the start are reached with ``page_after``."""
    if page is None or size is None:
        return df.orderBy(*order)
    return df.orderBy(*order).offset(page * size).limit(size)


def page_after(df: DataFrame, order: list[By], size: int, last: dict | None = None) -> DataFrame:
    """The ``size`` rows that follow the row with the values ``last`` of the order's columns; without it the
    first page. Values may be columns, such as scalar subqueries.

    The page starts by a condition on the columns, not by counting rows: a page far from the start costs as
    much as the first one, and rows that come or go before it do not move it. The columns together must tell
    all rows apart; the last one, usually an id, is never null.
    """
    if last is not None:
        values = {by.name: last[by.name] if isinstance(last[by.name], Column) else F.lit(last[by.name]) for by in order}
        after, same = F.lit(False), F.lit(True)
        for by in order:
            after = after | (same & F.coalesce(by.behind(values[by.name]), F.lit(False)))
            same = same & by.same(values[by.name])
        # an empty page ends nowhere, and so does what follows it
        df = df.where(after & values[order[-1].name].isNotNull())
    return df.orderBy(*(by.sorted() for by in order)).limit(size)


def last_place(page: DataFrame, order: list[By]) -> dict:
    """The place where a page ends, for ``page_after``, as scalar subqueries: the page is not run ahead."""
    backwards = [
        F.asc_nulls_first(by.name) if by.descending else F.desc_nulls_last(by.name) for by in order
    ]
    end = page.orderBy(*backwards).limit(1)
    return {by.name: end.select(by.name).scalar() for by in order}


def page_with_total(df: DataFrame, order: list[Column], page: int = 0, size: int = 20) -> DataFrame:
    """One page, each row carrying the row count of the whole listing and the number of pages."""
    total = df.select(F.count("*").alias("n")).scalar()
    return page_of(df, order, page, size).select(
        "*",
        total.alias("total_elements"),
        F.ceil(total / F.lit(size)).cast("bigint").alias("total_pages"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of every key with their rank, safe for a key of any size.

    Spark keeps only n rows per key and task ahead of the shuffle (see ``configure`` for its limit).
    Where n is large the key is first ranked in salted shares, each again cut to n rows: its first n
    rows are among the first n of the shares.
    """
    rows = df
    if n > ONE_TASK_RANK:
        names = df.columns
        shares = df.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)))
        share = Window.partitionBy(*keys, "_salt").orderBy(*order)
        ranked = shares.withColumn("_rank", F.row_number().over(share))
        rows = ranked.where(F.col("_rank") <= n).select(*names)
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def page_per_key(df: DataFrame, keys: list[str], order: list[Column], page: int, size: int, rank: str) -> DataFrame:
    """The same 0-based page of every key's listing."""
    return first_per_key(df, keys, order, (page + 1) * size, rank).where(F.col(rank) > page * size)
