"""Vector code compression: every part of a vector is replaced by the index of its nearest codebook entry.

Nearest entries are found by slicing and intersecting bit masks. For every dimension of a part the entries
are sorted by their coordinate, and the prefix of each length carries the mask of the entries in it. A first
distance, to the neighbours in the widest dimension, bounds how far the nearest entry can be in any single
dimension; the two ends of that range select two prefixes, whose masks differ in exactly the entries inside.
The AND over all dimensions leaves every entry that can be nearest, ties included; only those are measured.

All arithmetic is on integers, so results do not depend on how rows are partitioned. Per round a task sends
the sums of its parts, one row per codebook number, and Spark adds them up; the codebooks (parts x entries x
positions) are all the driver ever holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# below them differences, their squares and the sums of these over all positions fit 64 bits
SAFE, SAFE_POSITIONS = 1 << 24, 4096


class Slices:
    """The sorted coordinates and prefix masks of one codebook of whole numbers (entries x positions)."""

    def __init__(self, entries: np.ndarray) -> None:
        count, positions = entries.shape
        self.entries = entries
        number = np.arange(count)
        bits = np.zeros((count, max(1, -(-count // 64))), np.uint64)
        bits[number, number // 64] = np.uint64(1) << (number % 64).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.order, self.sorted = order, np.take_along_axis(entries, order, axis=0)
        self.prefix = np.zeros((positions, count + 1, bits.shape[1]), np.uint64)
        for at in range(positions):
            self.prefix[at, 1:] = np.bitwise_or.accumulate(bits[order[:, at]], axis=0)
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if positions else 0

    def _distance(self, points: np.ndarray, entry: np.ndarray | int) -> np.ndarray:
        apart = points - self.entries[entry]
        return (apart * apart).sum(axis=1)

    def radius(self, points: np.ndarray) -> np.ndarray:
        """At least the distance to the nearest entry: that of a neighbour in the widest dimension."""
        at = np.searchsorted(self.sorted[:, self.widest], points[:, self.widest])
        order = self.order[:, self.widest]
        square = np.minimum(
            self._distance(points, order[np.minimum(at, len(order) - 1)]),
            self._distance(points, order[np.maximum(at - 1, 0)]),
        )
        if square.dtype == object:
            return np.array([math.isqrt(value) for value in square], dtype=object)
        return np.sqrt(square.astype(np.float64)).astype(np.int64) + 1

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """Masks (points x words) of the entries within the radius in every single dimension."""
        radius = self.radius(points)
        masks = np.full((len(points), self.prefix.shape[2]), ~np.uint64(0))
        for at in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, at], points[:, at] - radius, side="left")
            high = np.searchsorted(self.sorted[:, at], points[:, at] + radius, side="right")
            masks &= self.prefix[at, high] ^ self.prefix[at, low]
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry; of equally near ones the first."""
        index = np.zeros(len(points), np.int64)
        best = np.zeros(len(points), points.dtype)
        if not points.size:
            return index, best
        masks, found = self.candidates(points), np.zeros(len(points), bool)
        for entry in range(len(self.entries)):
            near = np.flatnonzero(masks[:, entry // 64] >> np.uint64(entry % 64) & np.uint64(1))
            square = self._distance(points[near], entry)
            better = ~found[near] | (square < best[near])
            index[near[better]], best[near[better]] = entry, square[better]
            found[near] = True
        return index, best


class Codebooks:
    """``books[p]`` holds the entries of part ``p``; ``size`` is the length of the vectors they are for."""

    def __init__(self, size: int, books: list[list[list[int]]], scale: int) -> None:
        self.size, self.books, self.scale = size, books, scale
        self.bounds = bounds(size, len(books))

    def sha256(self) -> str:
        numbers = (str(x) for book in self.books for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def slices(self, wide: bool) -> list[Slices]:
        kind = object if wide else np.int64
        return [
            Slices(np.array(book, dtype=kind).reshape(len(book), high - low))
            for book, (low, high) in zip(self.books, self.bounds)
        ]

    def fits(self) -> bool:
        return self.size <= SAFE_POSITIONS and all(abs(x) < SAFE for book in self.books for entry in book for x in entry)


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Equal consecutive parts; where the length is no multiple, they differ by one position."""
    return [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def _rows(batch: pa.RecordBatch, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable vectors of that length, their components as doubles)."""
    column = batch.column(at)
    fits = (column.is_valid().to_numpy(zero_copy_only=False)) & (
        np.asarray(column.value_lengths().fill_null(-1)) == size
    )
    flat = column.filter(pa.array(fits)).flatten()
    # a missing component reads as one that is not a number
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(int(fits.sum()), size)
    finite = np.isfinite(values).all(axis=1)
    fits[np.flatnonzero(fits)[~finite]] = False
    return fits, values[finite]


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: in 64 bits where all are small, else in numbers of any length."""
    if not values.size or np.abs(values).max() * scale < SAFE:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in values.tolist()], dtype=object)


class _Assigner:
    """Codes for batches of whole numbers; the masks are made once per width of numbers."""

    def __init__(self, codebooks: Codebooks) -> None:
        self.codebooks, self.made, self.narrow = codebooks, {}, codebooks.fits()

    def __call__(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part: its components, the indexes of the nearest entries, the squared distances."""
        wide = points.dtype == object or not self.narrow
        if wide not in self.made:
            self.made[wide] = self.codebooks.slices(wide)
        points = points.astype(object) if wide else points
        cut = [points[:, low:high] for low, high in self.codebooks.bounds]
        return [(part, *slices.nearest(part)) for part, slices in zip(cut, self.made[wide])]


def _component_sums(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(part, entry, position, total, n): per task the sums of the parts nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, totals = _Assigner(codebooks), {}
        for batch in batches:
            _, values = _rows(batch, 0, codebooks.size)
            for part, (points, index, _) in enumerate(assign(whole(values, codebooks.scale))):
                for entry in np.unique(index).tolist():
                    mine = points[index == entry]
                    old, count = totals.get((part, entry), ([0] * mine.shape[1], 0))
                    totals[part, entry] = [a + int(b) for a, b in zip(old, mine.sum(axis=0))], count + len(mine)
        rows = [
            (part, entry, at, Decimal(total), count)
            for (part, entry), (sums, count) in totals.items() for at, total in enumerate(sums)
        ]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        names = ["part", "entry", "position", "total", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    sums = vectors.mapInArrow(run, "part int, entry int, position int, total decimal(38,0), n bigint")
    return sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks for the ``embedding`` of ``vectors`` (vec_id, embedding); None without a usable vector.

    A vector is left out if it is null or has a null or non-finite component, and if its length is not the
    most frequent one (of equally frequent ones the largest). The books start as the parts of the vectors
    with the smallest vec_ids, rows without one last and equal ids by their components; with fewer vectors
    than ``entries`` they are smaller. An entry that no part is nearest to stays as it is.
    """
    prepare(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    source = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("embedding"))
    kept = source.filter(usable(F.col("embedding")))
    common = (
        kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    )
    if not common:
        return None
    size = common[0]["size"]
    first = kept.filter(F.size("embedding") == size).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    seeds = [[math.floor(Fraction(x) * scale) for x in row["embedding"]] for row in first]
    books = [[seed[low:high] for seed in seeds] for low, high in bounds(size, parts)]
    codebooks = Codebooks(size, books, scale)
    for _ in range(rounds):
        books = [[list(entry) for entry in book] for book in codebooks.books]
        for row in _component_sums(source.select("embedding"), codebooks).collect():
            books[row["part"]][row["entry"]][row["position"]] = int(row["total"]) // row["n"]
        codebooks = Codebooks(size, books, scale)
    return codebooks


def encode(vectors: DataFrame, codebooks: Codebooks, *keep: str) -> DataFrame:
    """(vec_id, ``keep``..., code, error) of the usable vectors: two hex digits per part (more beyond 256
    entries), and the squared distance to what the code stands for, null where it exceeds a long."""
    prepare(vectors.sparkSession)
    source = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), *(F.col(name) for name in keep),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    fields = source.schema.fields[:-1]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
    digits = max(2, len(f"{max((len(book) for book in codebooks.books), default=1) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(codebooks)
        for batch in batches:
            fits, values = _rows(batch, len(fields), codebooks.size)
            assigned = assign(whole(values, codebooks.scale))
            indexes = np.stack([index for _, index, _ in assigned], axis=1) if assigned else np.zeros((len(values), 0), int)
            errors = sum((square for _, _, square in assigned), np.zeros(len(values), np.int64)).tolist()
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in indexes.tolist()]
            columns = [batch.column(n).filter(pa.array(fits)) for n in range(len(fields))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())],
                names=[*(field.name for field in fields), "code", "error"],
            )

    return source.mapInArrow(run, f"{schema}, code string, error bigint")


def decode(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``codes`` with a column ``approximation``: the entries that a code names, scaled back."""
    digits = max(2, len(f"{max((len(book) for book in codebooks.books), default=1) - 1:x}"))
    tables = [
        F.array(*(F.array(*(F.lit(x / codebooks.scale) for x in entry)).cast("array<double>") for entry in book))
        for book in codebooks.books
    ]
    parts = [
        F.element_at(table, F.conv(F.substring("code", 1 + part * digits, digits), 16, 10).cast("int") + 1)
        for part, table in enumerate(tables)
    ]
    return codes.withColumn("approximation", F.concat(*parts))


def op11_vector_codes(spark, sf_dir):
    """Codes of all embeddings. Labels are added up ahead of the join, so a hot label sends a row per task."""
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    codebooks = train(vectors)
    if codebooks is None:
        return spark.createDataFrame(
            [], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        )
    scratch = Scratch(spark, "vector-codes")
    coded = scratch.store(encode(vectors, codebooks, "label"), "coded")
    per_label = scratch.store(
        coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")),
        "per-label",
    ).withColumnRenamed("label", "of")
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256")
    )


def _op11_sql() -> str:
    """Six rounds as steps of one statement, every one over all parts of all vectors."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x AS double)) AS bigint)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
usual AS MATERIALIZED (SELECT len(v) AS size FROM kept GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
numbered AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, vec_id, label, v
    FROM kept, usual WHERE len(v) = size),
part AS MATERIALIZED (
    SELECT n, p, v[size * p // {PARTS} + 1 : size * (p + 1) // {PARTS}] AS x
    FROM numbered, usual, range({PARTS}) AS parts(p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM part WHERE n <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT n, p, min_by(e, d * {ENTRIES} + e) AS e, min(d) AS d
    FROM (SELECT n, part.p, e,
                 coalesce(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS d
          FROM part JOIN book{r} AS book ON part.p = book.p)
    GROUP BY n, p)""")
        if r < ROUNDS:
            steps.append(f"""
mean{r} AS MATERIALIZED (
    SELECT p, e, list(cast(s - ((s % m) + m) % m AS bigint) // m ORDER BY i) AS c
    FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS m
          FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM part JOIN near{r} USING (n, p))
          GROUP BY p, e, i)
    GROUP BY p, e),
book{r + 1} AS MATERIALIZED (
    SELECT book.p, book.e, coalesce(mean.c, book.c) AS c
    FROM book{r} AS book LEFT JOIN mean{r} AS mean ON book.p = mean.p AND book.e = mean.e)""")
    return ",".join(steps) + f""",
coded AS (
    SELECT n, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, cast(sum(d) AS bigint) AS error
    FROM near{ROUNDS} GROUP BY n),
books AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (n), books"""


OP11_SQL = _op11_sql()
