"""Byte strings that start earlier too, by a depth-limited radix sort of the suffixes.

Only the first WINDOW bytes of a suffix count, and only equality does, so instead of sorting to the end the
suffixes are split into groups by one digit after the other, most significant first. A suffix whose group
has no second member leaves; the groups after the last digit are exactly the repeated windows.

The digits are chosen so that the first passes work on far fewer rows than there are bytes:

1. the window's anchor, its 32-byte gram of smallest hash. Equal windows have equal anchors at the same
   offset, and neighbouring windows mostly share theirs, so one row per anchor (about 3 % of the bytes)
   stands for all windows around it;
2. the bytes common to BLOCK neighbouring windows of an anchor. Where all bytes of such a block appear
   earlier, its windows are decided without being looked at one by one;
3. the whole window.

This departs from a plain radix sort, whose first digit would be the leading bytes of every suffix: one row
per byte of the table, where the anchors are one in about thirty.

Digits are compared by 64-bit hashes where a collision only costs work, and by 128 bits where it decides.
Every pass is an aggregation to a count or a first place, which combines ahead of the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, by_row, documents, lean, prepare, texts

WINDOW = 100
GRAM = 32
BLOCK = 23
PIECE = 1 << 19  # bytes hashed at a time; longer texts are cut into pieces that overlap by a window


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class RangeHash:
    """Hashes of arbitrary byte ranges from running sums of byte value times power of an odd base."""

    _tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, seed: int) -> None:
        values, powers, inverse = self._table(seed, len(data))
        self.inverse = inverse
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    @classmethod
    def _table(cls, seed: int, length: int) -> tuple:
        table = cls._tables.get(seed)
        if table is None or len(table[1]) < length + 1:
            size = max(length + 1, PIECE + 4096)
            rng = np.random.default_rng(seed)
            values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            base = int(rng.integers(1 << 61, 1 << 63, dtype=np.uint64)) | 5
            powers, inverse = np.ones(size, np.uint64), np.ones(size, np.uint64)
            powers[1:], inverse[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
            table = cls._tables[seed] = values, np.cumprod(powers), np.cumprod(inverse)
        return table

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def anchors(data: np.ndarray, hashes: RangeHash, ends: np.ndarray, window: int, gram: int) -> tuple:
    """Anchors of all windows that lie within one text.

    ``ends`` holds for each byte where its text ends. Returns the positions of the anchors, their hashes,
    and the first and last window start that each one stands for.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none.astype(np.uint64), none, none
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    # the smallest (hash, position) of each stretch of grams, by doubling the stretch
    least = ((grams >> np.uint64(32)) << np.uint64(32)) | at.astype(np.uint64)
    stretch, span = window - gram + 1, 1
    while span * 2 <= stretch:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if stretch > span:
        least = np.minimum(least[: len(least) - (stretch - span)], least[stretch - span:])
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends[: len(least)])
    if not len(starts):
        return none, none.astype(np.uint64), none, none
    chosen = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    return chosen[new], grams[chosen[new]], starts[new], starts[last]


def _pieces(ids: list, texts: list[bytes], window: int) -> Iterator[tuple]:
    """Texts put together into stretches of about PIECE bytes: data, row and place of each byte's text.

    A longer text is cut; each cut repeats window - 1 bytes, so that every window is in exactly one piece.
    """
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - window + 1), PIECE):
            part = text[start:start + PIECE + window - 1]
            if len(part) < window:
                continue
            group.append((row, start, part))
            held += len(part)
            if held >= PIECE:
                yield _joined(group)
                group, held = [], 0
    if group:
        yield _joined(group)


def _joined(group: list) -> tuple:
    sizes = np.array([len(part) for _, _, part in group])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
    return (
        data, np.repeat(ends, sizes), np.repeat([row for row, _, _ in group], sizes),
        np.repeat([place for _, place, _ in group] - (ends - sizes), sizes),
    )


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, doc_id, at): pass one, one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [text.encode() for text in batch.column(1).to_pylist()]
            for data, ends, row, shift in _pieces(ids, texts, window):
                position, hashed, _, _ = anchors(data, RangeHash(data, 1), ends, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashed), pa.array(ids[row[position]], pa.int64()),
                     pa.array((position + shift[position]).astype(np.int32), pa.int32())],
                    names=["gram", "doc_id", "at"],
                )

    return rows.mapInArrow(lean(run), "gram bigint, doc_id bigint, at int")


def _wanted(batch: pa.RecordBatch, column: int, row: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which (row, position) pairs the list column of the batch holds."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values, dtype=np.int64)[offsets[0]:offsets[-1]]
    held = np.repeat(np.arange(batch.num_rows), np.diff(offsets)) << 32 | values
    return np.isin(row << 32 | position, held)


def block_rows(rows: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """(core, all_a, all_b, doc_id, start, first, last): pass two, from (doc_id, text, at) with the anchors
    left over. ``core`` hashes the bytes all windows of a block have, ``all`` those that any has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [text.encode() for text in batch.column(1).to_pylist()]
            for data, ends, row, shift in _pieces(ids, texts, window):
                one, two = RangeHash(data, 1), RangeHash(data, 2)
                position, _, begin, stop = anchors(data, one, ends, window, gram)
                kept = _wanted(batch, 2, row[position], position + shift[position])
                position, begin, stop = position[kept], begin[kept], stop[kept]
                for low in range(0, window - gram + 1, block):
                    high = min(low + block - 1, window - gram)
                    # window starts position - offset, for offsets low to high
                    first, last = np.maximum(begin, position - high), np.minimum(stop, position - low)
                    some = first <= last
                    a, first, last = position[some], first[some], last[some]
                    core = one.of(a - low, a - high + window) + np.uint64(low)
                    shape = ((a - first) * window + (a - last)).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(core), _signed(_mix(one.of(first, last + window) + shape)),
                         _signed(_mix(two.of(first, last + window) ^ shape)), pa.array(ids[row[a]], pa.int64()),
                         pa.array((first + shift[a]).astype(np.int32)), pa.array((last + shift[a]).astype(np.int32))],
                        names=["core", "all_a", "all_b", "doc_id", "first", "last"],
                    )

    return rows.mapInArrow(lean(run), "core bigint, all_a bigint, all_b bigint, doc_id bigint, first int, last int")


def _run(first: str = "first", last: str = "last") -> Column:
    """A run of window starts as one number, in the order of the first start."""
    return F.shiftleft(F.col(first).cast("bigint"), 32) + F.col(last)


def _unpacked(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs >> 32, runs & 0xFFFFFFFF


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a column of lists of numbers; a null list has none."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    return np.repeat(np.arange(batch.num_rows), sizes), np.asarray(lists.flatten(), dtype=np.int64)


def window_rows(rows: DataFrame, window: int) -> DataFrame:
    """(win_a, win_b, doc_id, first): pass three, one row per window of (doc_id, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, runs = _lists(batch, 2)
            order = np.lexsort((runs, owner))
            borders = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            firsts, lasts = _unpacked(runs[order])
            for n, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = np.frombuffer(text.encode(), np.uint8)
                at, end = borders[n], borders[n + 1]
                while at < end:
                    low = firsts[at]
                    fits = lasts[at:end] + window - low < PIECE
                    fits[0] = True
                    stop = at + (len(fits) if fits.all() else int(fits.argmin()))
                    first, last = firsts[at:stop], lasts[at:stop]
                    size, at = last - first + 1, stop
                    starts = np.repeat(first - low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    piece = data[low:int(last.max()) + window]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(RangeHash(piece, 1).of(starts, starts + window)), _signed(RangeHash(piece, 2).of(starts, starts + window)),
                         pa.array(np.full(len(starts), doc_id), pa.int64()), pa.array((starts + low).astype(np.int32))],
                        names=["win_a", "win_b", "doc_id", "first"],
                    )

    return rows.mapInArrow(lean(run), "win_a bigint, win_b bigint, doc_id bigint, first int")


def _first_places(rows: DataFrame, *key: str) -> DataFrame:
    """The earliest (doc_id, first) of each key that has several rows."""
    return (
        rows.groupBy(*key).agg(F.min(F.struct("doc_id", "first")).alias("place"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(*key, "place")
    )


def repeated_runs(
    docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """(doc_id, first, last): runs of window starts whose window starts earlier too."""
    rows = texts(docs)
    here = F.struct("doc_id", "first")

    grams = anchor_rows(rows, window, gram)
    repeated = grams.groupBy("gram").count().filter("count > 1").select("gram")
    alive = scratch.store(
        grams.join(repeated.hint("merge"), "gram", "left_semi").groupBy("doc_id").agg(F.collect_list("at").alias("at")),
        "alive",
    )
    blocks = scratch.store(block_rows(rows.join(alive.hint("merge"), "doc_id"), window, gram, block), "blocks")

    # blocks that appear earlier as a whole are decided; the earliest of each content goes on
    places = _first_places(blocks, "all_a", "all_b")
    placed = scratch.store(
        blocks.join(places.hint("merge"), ["all_a", "all_b"], "left")
        .select("core", "doc_id", "first", "last", (F.coalesce(here > F.col("place"), F.lit(False))).alias("later")),
        "placed",
    )
    scratch.drop("blocks", "alive")
    decided = placed.filter("later").select("doc_id", "first", "last")
    open_blocks = placed.filter(~F.col("later"))
    shared = open_blocks.groupBy("core").count().filter("count > 1").select("core")
    undecided = scratch.store(
        open_blocks.join(shared.hint("merge"), "core", "left_semi")
        .groupBy("doc_id").agg(F.collect_list(_run()).alias("runs")),
        "undecided",
    )
    windows = scratch.store(window_rows(rows.join(undecided.hint("merge"), "doc_id"), window), "windows")
    later = (
        windows.join(_first_places(windows, "win_a", "win_b").hint("merge"), ["win_a", "win_b"])
        .filter(here > F.col("place")).select("doc_id", "first", F.col("first").alias("last"))
    )
    return decided.unionByName(later)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, every_row: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each text as bytes without those that a ``window``-byte string covers
    which also starts earlier: in a document of smaller id, or in the same one.

    ``spans`` are the maximal removed runs as (start, end) in bytes; ``kept`` is binary, as a removed run
    may cut a character. Matches never cross documents and are judged on the input. Null text is empty;
    texts shorter than the window stay whole. Rows without an id are left out and each id and text is a
    document of its own, or with ``every_row`` each row, those without an id after all others.
    """
    prepare(docs.sparkSession)
    return by_row(docs, lambda rows: _cut(rows, window, gram, block), "doc_id", every_row=every_row)


def _cut(docs: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """The same where the doc_id tells rows apart."""
    scratch = Scratch(docs.sparkSession, "repeats")
    runs = (
        repeated_runs(docs, scratch, window, gram, block)
        .groupBy("doc_id").agg(F.collect_list(_run()).alias("runs"))
    )
    stored = scratch.store(runs, "runs")
    scratch.drop("placed", "undecided", "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, runs = _lists(batch, 2)
            first, last = _unpacked(runs[np.lexsort((runs, owner))])
            # a run joins the span before it if it starts no later than that ends; rows lie far apart
            far = owner << 33
            reach = np.maximum.accumulate(last + window + far)
            new = np.flatnonzero(np.concatenate([[True], first[1:] + far[1:] > reach[:-1]])) if len(runs) else owner
            starts, ends = first[new], (reach - far)[np.concatenate([new[1:] - 1, [len(runs) - 1]])] if len(runs) else first
            offsets = np.searchsorted(owner[new], np.arange(batch.num_rows + 1))
            sizes, kept = [], []
            for text, a, b in zip(batch.column(1).to_pylist(), offsets[:-1], offsets[1:]):
                data = text.encode()
                sizes.append(len(data))
                if a == b:
                    kept.append(data)
                    continue
                gaps = zip([0, *ends[a:b].tolist()], [*starts[a:b].tolist(), len(data)])
                kept.append(b"".join(data[low:high] for low, high in gaps))
            spans = pa.StructArray.from_arrays(
                [pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["start", "end"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return texts(docs).join(stored.hint("merge"), "doc_id", "left").mapInArrow(
        lean(cut), "doc_id bigint, n_bytes bigint, spans array<struct<start: int, end: int>>, kept binary"
    )


def op2_suffix_dedup(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])
    return remove_repeats(documents(spark, sf_dir), every_row=True).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: dict[int, bytes], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same result for a few texts, window by window: id to bytes, removed bytes, runs, digest."""
    seen: set[bytes] = set()
    out = {}
    for doc_id in sorted(texts):
        text = texts[doc_id]
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - window + 1):
            if text[at:at + window] in seen:
                gone[at:at + window] = True
            seen.add(text[at:at + window])
        kept = bytes(b for b, drop in zip(text, gone) if not drop)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc_id] = len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()
    return out
