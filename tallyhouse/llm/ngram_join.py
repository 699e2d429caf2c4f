"""Documents linked by the Jaccard similarity of their word 5-grams, found with signature trees.

Identical shingle sets are folded into one class first. Linked sets share a shingle among the first quarter
of either one, in any order that is the same for all documents; so the sets meet in the blocks of their
first shingles. The order puts the most frequent shingles last, which keeps passages that many documents
share out of the blocks, and affects no result.

Within a block the sets hang in a signature tree: a leaf holds the bitmap of one set's shingles and its
size, a node the OR of its leaves' bitmaps and the range of their sizes. Two nodes are descended together
and left as soon as the largest overlap that their bitmaps and sizes allow is too small for a link. Two sets
need only be found in the first block they share: there the overlap lies at or behind the block's place in
both, and the blocks before it differ, so a pair is left where a place is too late or both come from the same
block. What survives is held against finer bitmaps, whose length follows that of the document, and then
compared exactly.

A large group of near copies would survive as all its pairs. So the members of a block are first compared
with one centre each, and the trees then look only for links between different components.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.repeats import RangeHash, _mix
from tallyhouse.llm.shared import Scratch, by_row, documents, lean, prepare, texts

WORDS = 5
PERCENT = 75
BITS = 4096
FANOUT = 16
LEAVES = 512  # leaves of one tree; a larger block is cut into trees that are traversed in pairs
REPEATED = 32  # documents that make a shingle frequent, whatever the size of the table
FREQUENT = 100_000  # shingles at most whose place in the order is moved to the end
CHUNK = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True  # fixed values: the blanks between words


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text.

    Words are runs of bytes other than ASCII blanks. A text of fewer words is one shingle as a whole, one
    without words has none.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text.lower())
        held += len(text) + 1
        if held >= CHUNK:
            out += _group_sets(group, words)
            group, held = [], 0
    return out + _group_sets(group, words) if group else out


def _group_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    borders = np.cumsum([len(text) + 1 for text in texts])
    first_word = np.searchsorted(start, np.concatenate([[0], borders]))
    hashed = RangeHash(data, 5).of(start, end) + (end - start).astype(np.uint64)
    rolled = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for n in range(words):
        rolled = _mix(rolled + np.uint64(n + 1)) + hashed[n:len(hashed) - words + 1 + n] if len(rolled) else rolled
    rolled = _mix(rolled)
    sets = []
    for low, high in zip(first_word[:-1], first_word[1:]):
        if high - low >= words:
            sets.append(np.unique(rolled[low:high - words + 1]))
        elif high > low:
            whole = np.zeros(1, np.uint64)
            for n, value in enumerate(hashed[low:high]):
                whole = _mix(whole + np.uint64(n + 1)) + value
            sets.append(_mix(whole + np.uint64(high - low)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n must include one that any linked set has among its first."""
    return n - (n * percent + 99) // 100 + 1 if n else 0


def _batches(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return batch.column(0).to_pylist(), [text.encode() for text in batch.column(1).to_pylist()]


def frequent_shingles(rows: DataFrame, limit: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, at most ``limit``, sorted by hash.

    Each task adds up the shingles that occur in several of its documents. What is found only sets the
    order of shingles; a shingle that is missed, or one too many, changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def repeated() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            again = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[again].view(np.int64)), pa.array(counts[again].astype(np.int64))], names=["shingle", "n"]
            )

        for batch in batches:
            for found in shingle_sets(_batches(batch)[1]):
                seen.append(found)
                held += len(found)
            if held > 4 << 20:
                yield repeated()
                seen, held = [], 0
        if seen:
            yield repeated()

    counted = rows.mapInArrow(lean(run), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= REPEATED).orderBy(F.desc("n"), "shingle").limit(limit)
    return np.sort(np.array([row["shingle"] for row in top.collect()], np.int64).view(np.uint64))


def prefixes(rows: DataFrame, late: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, n, digest, prefix): size and digest of each shingle set, and its first shingles."""
    shipped = rows.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shipped.value
        for batch in batches:
            ids, texts = _batches(batch)
            sizes, digests, firsts = [], [], []
            for found in shingle_sets(texts):
                n = len(found)
                sizes.append(n)
                place = np.arange(1, n + 1, dtype=np.uint64)
                digests.append(
                    None if not n else
                    f"{n:x}-{int(_mix(found).sum(dtype=np.uint64)):x}-{int((_mix(found ^ np.uint64(77)) * place).sum(dtype=np.uint64)):x}"
                )
                if n and len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    is_late = last[at] == found
                    found = np.concatenate([found[~is_late], found[is_late]])
                firsts.append(found[:prefix_size(n, percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "prefix"],
            )

    return rows.mapInArrow(lean(run), "doc_id bigint, n bigint, digest string, prefix array<bigint>")


def _bitmap(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One bit for each shingle, by its low bits, as 64-bit words."""
    held = np.zeros(bits, np.uint8)
    held[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held).view(np.uint64)


def _folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same shingles with fewer bits."""
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), axis=0)


def bitmaps(rows: DataFrame) -> DataFrame:
    """(doc_id, n, text, bitmap, fine) of the given documents. ``fine`` has at least four bits for each shingle,
    so that long documents do not fill it; ``bitmap`` is the same folded to BITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            sizes, coarse, fine = [], [], []
            for shingles in shingle_sets(_batches(batch)[1]):
                words = _bitmap(shingles, max(BITS, 1 << (4 * len(shingles)).bit_length()))
                sizes.append(len(shingles))
                fine.append(words.tobytes())
                coarse.append(_folded(words, BITS).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), texts, pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "n", "text", "bitmap", "fine"],
            )

    return rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, n bigint, text string, bitmap binary, fine binary")


def most_common(n_x: int, fine_x: np.ndarray, n_y: int, fine_y: np.ndarray) -> int:
    """The largest overlap of two sets that their fine bitmaps allow."""
    bits = 64 * min(len(fine_x), len(fine_y))
    x, y = _folded(fine_x, bits), _folded(fine_y, bits)
    slack = min(n - int(np.bitwise_count(words).sum()) for n, words in ((n_x, x), (n_y, y)))
    return min(n_x, n_y, int(np.bitwise_count(x & y).sum()) + slack)


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that sizes and fine bitmaps cannot rule out; no text is moved for the others."""
    both = pairs
    for side in ("a", "b"):
        own = sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("fine").alias(f"fine_{side}"))
        both = both.join(own.hint("merge"), side)
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, fine_a, fine_b in zip(*(batch.column(n).to_pylist() for n in (2, 3, 4, 5))):
                common = most_common(n_a, np.frombuffer(fine_a, np.uint64), n_b, np.frombuffer(fine_b, np.uint64))
                keep.append(common * (100 + percent) >= percent * (n_a + n_b))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(chosen) for n in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(lean(run), "a bigint, b bigint")


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose exact similarity reaches the threshold. Texts travel, not their shingles:
    they are half the size."""
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("of_a")).hint("merge"), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("of_b")).hint("merge"), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [shingle_sets([text.encode() for text in batch.column(n).to_pylist()]) for n in (2, 3)]
            keep = []
            for x, y in zip(*sides):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * 100 >= percent * (len(x) + len(y) - common))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(chosen) for n in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "of_a", "of_b").mapInArrow(lean(run), "a bigint, b bigint")


class SignatureTree:
    """Leaves in order of size; levels of nodes over FANOUT children, each with OR bitmap and size range.

    ``rests`` are the shingles of each set from the block's place on, ``before`` the block ahead of this one
    in each set, where it is not the ``first``.
    """

    def __init__(
        self, ids: np.ndarray, sizes: np.ndarray, groups: np.ndarray, bitmaps: np.ndarray, rests: np.ndarray,
        before: np.ndarray, first: np.ndarray,
    ) -> None:
        order = np.lexsort((ids, sizes))
        self.ids, self.groups, self.before, self.first = ids[order], groups[order], before[order], first[order]
        bitmaps, sizes = bitmaps[order], sizes[order]
        slack = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)  # shingles that share a bit
        self.levels = [(bitmaps, sizes, rests[order], slack, self.groups, self.groups, sizes)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FANOUT)
            ors, low, rest, loose, least, last, high = self.levels[-1]
            self.levels.append((
                np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(low, at), np.maximum.reduceat(rest, at),
                np.maximum.reduceat(loose, at), np.minimum.reduceat(least, at), np.maximum.reduceat(last, at),
                np.maximum.reduceat(high, at),
            ))


def traverse(one: SignatureTree, two: SignatureTree, percent: int) -> np.ndarray:
    """Leaf pairs (x of one, y of two) of different groups that the bitmaps cannot rule out.

    An overlap is at most the common bits plus the smaller slack, and in the first common block at most the
    smaller rest; a link of sizes m and n needs percent * (m + n) / (100 + percent).
    """
    top = max(len(one.levels), len(two.levels)) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        a, b = one.levels[min(level, len(one.levels) - 1)], two.levels[min(level, len(two.levels) - 1)]
        fine = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(x), 1 << 15):
            p, q = x[start:start + (1 << 15)], y[start:start + (1 << 15)]
            common = np.bitwise_count(a[0][p] & b[0][q]).sum(1, dtype=np.int64)
            overlap = np.minimum(common + np.minimum(a[3][p], b[3][q]), np.minimum(a[2][p], b[2][q]))
            ok = overlap * (100 + percent) >= percent * (a[1][p] + b[1][q])
            ok &= (a[6][p] * 100 >= percent * b[1][q]) & (b[6][q] * 100 >= percent * a[1][p])
            ok &= ~((a[4][p] == a[5][p]) & (b[4][q] == b[5][q]) & (a[4][p] == b[4][q]))
            if one is two:
                ok &= p <= q
            fine = np.concatenate([fine[0], p[ok]]), np.concatenate([fine[1], q[ok]])
        x, y = fine
        if level:
            x, y = _children(x, y, one.levels, two.levels, level)
    if one is two:
        x, y = x[x < y], y[x < y]
    met = ~one.first[x] & ~two.first[y] & (one.before[x] == two.before[y])
    x, y = x[~met], y[~met]
    return np.stack([one.ids[x], two.ids[y]], axis=1)


def _children(x: np.ndarray, y: np.ndarray, one: list, two: list, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of each node pair; a tree without that level stays at its root."""

    def below(nodes: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
        if level >= len(levels):
            return nodes, np.ones(len(nodes), np.int64)
        first = nodes * FANOUT
        return first, np.minimum(FANOUT, len(levels[level - 1][0]) - first)

    (xf, xn), (yf, yn) = below(x, one), below(y, two)
    owner = np.repeat(np.arange(len(x)), xn * yn)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(xn * yn) - xn * yn, xn * yn)
    return xf[owner] + place // yn[owner], yf[owner] + place % yn[owner]


def tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of (block, part, doc_id, n, component, bitmap, rest, before) rows: every block's
    parts are traversed in pairs, each pair of parts in a task of its own."""
    parts = members.groupBy("block").agg(F.max("part").alias("last"))
    dealt = members.join(parts.hint("merge"), "block").select(
        "block", "doc_id", "n", "component", "bitmap", "rest", "before", "part",
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"),
    ).select(
        "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        "part", "doc_id", "n", "component", "bitmap", "rest", "before",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def result() -> pa.RecordBatch:
            trees = {}
            for part in {row[3] for row in held}:
                own = [row for row in held if row[3] == part]
                trees[part] = SignatureTree(
                    np.array([r[4] for r in own]), np.array([r[5] for r in own]), np.array([r[6] for r in own]),
                    np.frombuffer(b"".join(r[7] for r in own), np.uint64).reshape(len(own), -1),
                    np.array([r[8] for r in own]), np.array([r[9] or 0 for r in own]),
                    np.array([r[9] is None for r in own]),
                )
            low, high = key[1], key[2]
            pairs = traverse(trees[low], trees[high], percent) if low in trees and high in trees else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs.min(1) if len(pairs) else [], pa.int64()), pa.array(pairs.max(1) if len(pairs) else [], pa.int64())],
                names=["a", "b"],
            )

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[:3] != key:
                    if held:
                        yield result()
                    held, key = [], row[:3]
                held.append(row)
        if held:
            yield result()

    grouped = dealt.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high")
    return grouped.mapInArrow(lean(run), "a bigint, b bigint").distinct()


def jaccard_links(
    docs: DataFrame, percent: int = PERCENT, leaves: int = LEAVES, frequent: int = FREQUENT, every_row: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each shingle set, and the smallest id reachable by links.

    Documents link when 100 * |intersection| >= percent * |union|. A null text or one without words is
    empty and linked with nothing; fewer than five words are one shingle. Rows without an id are left out and
    each id and text is a document of its own, or with ``every_row`` each row; a component whose rows have no
    id has null. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    return by_row(docs, lambda rows: _links(rows, percent, leaves, frequent), "doc_id", "component_id", every_row=every_row)


def _links(docs: DataFrame, percent: int, leaves: int, frequent: int) -> DataFrame:
    """The same where the doc_id tells rows apart."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = texts(docs)
    late = frequent_shingles(rows, frequent)
    firsts = scratch.store(prefixes(rows, late, percent), "prefixes")

    # documents with equal sets are one class, named by its smallest id
    classes = firsts.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class"))
    member = scratch.store(
        firsts.select("doc_id", "n", "digest").join(classes.hint("merge"), "digest", "left")
        .select("doc_id", "n", F.coalesce("class", "doc_id").alias("class")), "members",
    )
    leading = member.filter("doc_id = class AND n > 0").select("doc_id")
    tokens = (
        firsts.join(leading.hint("merge"), "doc_id", "left_semi")
        .select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    )
    # of tokens with the same members the first in the order is enough
    blocks = scratch.store(
        tokens.groupBy("token").agg(
            F.count(F.lit(1)).alias("members"), F.min(F.struct("doc_id", "pos")).alias("one"),
            F.sum(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"),
            F.bit_xor(F.xxhash64("doc_id", F.lit(3))).alias("xor"),
        ).filter("members > 1")
        .groupBy("members", "one.doc_id", "sum", "xor").agg(F.min(F.struct("one.pos", "token")).alias("first"))
        .select("first.token", "members"), "blocks",
    )
    # a document's blocks in the order of its shingles: at most a quarter of those
    own = Window.partitionBy("doc_id")
    placed = scratch.store(
        tokens.join(blocks.hint("merge"), "token").select(
            F.col("token").alias("block"), "doc_id", "n", "members", (F.col("n") - F.col("pos")).alias("rest"),
            F.lag("token").over(own.orderBy("pos")).alias("before"), F.count(F.lit(1)).over(own).alias("weight"),
        ), "placed",
    )
    involved = placed.select("doc_id").distinct()
    sets = scratch.store(bitmaps(rows.join(involved.hint("merge"), "doc_id", "left_semi")), "sets")
    scratch.drop("prefixes", "blocks")

    # each document is compared with one centre: of most of its blocks the member that is in most blocks,
    # where their sizes allow a link
    hubs = (
        placed.groupBy("block")
        .agg(F.max_by(F.struct("doc_id", "n"), F.struct("weight", -F.col("doc_id"))).alias("hub"))
        .select("block", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    stars = (
        placed.join(hubs.hint("merge"), "block")
        .filter((F.col("doc_id") != F.col("hub")) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent))
        .groupBy("doc_id", "hub").count()
        .groupBy("doc_id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("a"))
        .select("a", F.col("doc_id").alias("b"))
    )
    near = scratch.store(linked(possible(stars, sets, percent), sets, percent), "near")
    found = scratch.store(components(near, scratch, "first"), "found")
    labelled = placed.join(found.hint("merge"), "doc_id", "left").select(
        "block", "doc_id", "n", "members", "rest", "before", F.coalesce("component_id", "doc_id").alias("component")
    )
    mixed = (
        labelled.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high").select("block")
    )
    spread = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.floor(F.col("members") / leaves) + 1).cast("int")
    open_members = scratch.store(
        labelled.join(mixed.hint("merge"), "block", "left_semi").withColumn("part", spread)
        .join(sets.select("doc_id", "bitmap").hint("merge"), "doc_id")
        .select("block", "part", "doc_id", "n", "component", "bitmap", "rest", "before"), "open",
    )
    close = scratch.store(possible(tree_pairs(open_members, percent), sets, percent), "close")
    more = scratch.store(linked(close, sets, percent), "more")
    final = scratch.store(components(near.unionByName(more), scratch, "second"), "components")
    scratch.drop("placed", "sets", "near", "found", "open", "close", "more")
    return (
        member.withColumnRenamed("doc_id", "id").join(
            final.withColumnRenamed("doc_id", "class").hint("merge"), "class", "left"
        ).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "class").alias("component_id"))
    )


def op7_ngram_join(spark, sf_dir):
    return jaccard_links(documents(spark, sf_dir), every_row=True)


def brute_force(texts: dict[int, str], percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The same result for few documents, with the words themselves and every pair that shares a shingle."""
    sets, holders = {}, defaultdict(list)
    for doc_id in sorted(texts):
        words = texts[doc_id].encode().lower().split()
        size = min(WORDS, len(words))
        sets[doc_id] = {tuple(words[n:n + size]) for n in range(len(words) - size + 1)} if words else set()
        for shingle in sets[doc_id]:
            holders[shingle].append(doc_id)
    parent = {doc_id: doc_id for doc_id in sets}

    def root(doc_id: int) -> int:
        while parent[doc_id] != doc_id:
            doc_id = parent[doc_id]
        return doc_id

    for doc_id in sorted(sets):
        shared = Counter(other for shingle in sets[doc_id] for other in holders[shingle] if other < doc_id)
        for other, common in shared.items():
            if 100 * common >= percent * (len(sets[doc_id]) + len(sets[other]) - common):
                low, high = sorted((root(doc_id), root(other)))
                parent[high] = low
    return {doc_id: (len(sets[doc_id]), root(doc_id)) for doc_id in sets}
