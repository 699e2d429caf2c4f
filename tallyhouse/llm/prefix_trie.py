"""The trie of conversation prefixes, as balanced parentheses per shard.

A conversation is the path of its turns; the id of a node is the chained digest of the turns that lead to it.
Equal conversations are combined first. Their distinct paths, in the order of their bytes, are cut into
shards, and each shard is the trie of its paths, written as parentheses in depth-first order. A range min-max
tree over the excess of the parentheses finds the close of every node at once, which delimits its subtree;
the rank of the pairs "()" counts the subtree's leaves, and differences of cumulative arrays give what its
nodes add up to.

Only the nodes on the first and the last path of a shard can belong to other shards too. These spines leave
the shard with what hangs below them and are merged in the order of the shards, in the same way and level by
level, until one trie of spines is left. A shard holds a bounded number of turns (or one conversation), so
neither a frequent prefix nor a frequent conversation meets in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, prepare

WIDTH = 16
ROOT = bytes(WIDTH)
EVERY, LONGEST = 5, 9
SHARD_TURNS = 200_000
FAN_IN = 256
IDS_SHIFT = 12
BLOCK = 128
NOBODY = np.iinfo(np.int64).max


class Parentheses:
    """A trie given by the depths of its nodes in depth-first order, the first one being its top."""

    def __init__(self, depth: np.ndarray) -> None:
        count = len(depth)
        closes = np.diff(depth, append=depth[:1] - 1)
        closes = 1 - closes
        self.opens = np.arange(count) + np.concatenate([[0], np.cumsum(closes)[:-1]])
        self.bits = np.zeros(2 * count, np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int32) - 1)
        blocks = -(-len(self.excess) // BLOCK)
        # beyond the end nothing is found: the excess stays at a value that no node closes with
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(self.excess)] = self.excess
        self.blocks = padded.reshape(blocks, BLOCK)
        low, high = [self.blocks.min(axis=1)], [self.blocks.max(axis=1)]
        while len(low[-1]) > 1:
            odd = len(low[-1]) % 2
            low.append(np.pad(low[-1], (0, odd), constant_values=np.iinfo(np.int32).max).reshape(-1, 2).min(axis=1))
            high.append(np.pad(high[-1], (0, odd), constant_values=np.iinfo(np.int32).min).reshape(-1, 2).max(axis=1))
        self.low, self.high = low, high

    def _in_block(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """First position in the block, beyond ``after``, with that excess; -1 without one."""
        place = np.arange(BLOCK)
        hit = (self.blocks[block] == target[:, None]) & (block[:, None] * BLOCK + place > after[:, None])
        return np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the parenthesis opened at each place is closed: the first later place with one less excess."""
        out = np.empty(len(opens), np.int64)
        for start in range(0, len(opens), 8192):
            at = opens[start:start + 8192]
            target = self.excess[at] - 1
            found = self._in_block(at // BLOCK, target, at)
            rest = np.flatnonzero(found < 0)
            node, want, level = at[rest] // BLOCK, target[rest], np.zeros(len(rest), np.int64)
            climbing = np.ones(len(rest), bool)
            # up to the first right neighbour whose range of excess holds the target
            for height in range(len(self.low)):
                mine = np.flatnonzero(climbing)
                beside = np.minimum(node[mine] + 1, len(self.low[height]) - 1)
                holds = (node[mine] % 2 == 0) & (beside > node[mine]) & (self.low[height][beside] <= want[mine]) & (want[mine] <= self.high[height][beside])
                stops = mine[holds]
                node[stops], level[stops], climbing[stops] = beside[holds], height, False
                node[mine[~holds]] //= 2
            # and down again to its first block
            for height in range(len(self.low) - 1, 0, -1):
                mine = np.flatnonzero(level == height)
                left = node[mine] * 2
                holds = (self.low[height - 1][left] <= want[mine]) & (want[mine] <= self.high[height - 1][left])
                node[mine], level[mine] = np.where(holds, left, left + 1), height - 1
            found[rest] = self._in_block(node, want, at[rest])
            out[start:start + 8192] = found
        return out


class Totals:
    """What the subtrees of a trie add up to.

    ``weight`` of every node; ``own`` convs that end at it and the smallest of them; and from below, what
    subtrees that are not part of this trie add to a node: convs, weighted convs, weights, leaves, children
    and the smallest conv.
    """

    BELOW = ("n", "weighted", "weights", "leaves", "children", "first")

    def __init__(self, depth: np.ndarray, weight: np.ndarray, own: np.ndarray, first: np.ndarray, below: dict[str, np.ndarray]) -> None:
        count = len(depth)
        tree = Parentheses(depth)
        closes = tree.findclose(tree.opens)
        number = np.arange(count)
        ends = number + (closes - tree.opens + 1) // 2

        def total(values: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values)])
            return running[ends] - running[number]

        self.n = total(own + below["n"])
        self.weighted = total(self.n * weight + below["weighted"])
        self.weights = total(weight + below["weights"])
        # pairs "()" up to each place; a node with children elsewhere is no leaf
        pair = tree.bits.astype(np.int64)
        pair[:-1] &= 1 - tree.bits[1:]
        pair[tree.opens[below["children"] > 0]] = 0
        rank = np.concatenate([[0], np.cumsum(pair)])
        self.leaves = rank[closes + 1] - rank[tree.opens] + total(below["leaves"])
        self.parent = _parents(depth)
        self.children = np.bincount(self.parent[1:], minlength=count) + below["children"]
        smallest = np.minimum(first, below["first"]).tolist()
        for node in range(count - 1, 0, -1):
            above = self.parent[node]
            if smallest[node] < smallest[above]:
                smallest[above] = smallest[node]
        self.first = np.array(smallest, np.int64)


def _parents(depth: np.ndarray) -> np.ndarray:
    last, out = [0] * (int(depth.max()) + 2), []
    for number, at in enumerate(depth.tolist()):
        out.append(last[at - 1])
        last[at] = number
    return np.array(out)


# --- conversations as paths ---


def turns_of(conversations: DataFrame, weight: Column | None = None) -> DataFrame:
    """(conv_id, turn, key, weight): a turn's key is a digest of role and text, null counting as empty. Rows
    without a conv_id are left out. The weight is the text's UTF-8 bytes unless another one is given."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.substring(F.unhex(F.sha2(content, 256)), 1, WIDTH).alias("key"),
        (F.octet_length(text) if weight is None else weight).cast("bigint").alias("weight"),
    )


def head_length(conv_id: int, longest: int = LONGEST) -> int:
    return zlib.crc32(str(conv_id).encode()) % longest


def rebuilt(turns: DataFrame, every: int = EVERY, longest: int = LONGEST) -> DataFrame:
    """(conv_id, path, weights) of every conversation: the first turns of conversation ``c - c % every`` take
    the place of as many of its own; ``every=1`` leaves conversations as they are.

    Turns are in the order of ``turn``, null first; those of one turn in the order of their keys, repeated
    ones each count. The path has 16 bytes per turn. Rows stream in order, so a task holds one conversation.
    """

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], list[int]]]:
        owner, base, keys, weights = None, None, [], []
        for batch in batches:
            for new_base, conv, key, weight in zip(*(column.to_pylist() for column in batch.columns)):
                if conv != owner:
                    if owner is not None:
                        yield base, owner, keys, weights
                    owner, base, keys, weights = conv, new_base, [], []
                keys.append(key)
                weights.append(weight)
        if owner is not None:
            yield base, owner, keys, weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_of, rows, held = ([], []), None, [], 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 3
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "path", "weights"])

        for base, conv, keys, weights in conversations(batches):
            if conv == base:
                head, head_of = (keys[: longest - 1], weights[: longest - 1]), base
            elif head_of != base:
                head, head_of = ([], []), base
            cut = head_length(conv, longest)
            if conv != base:
                keys, weights = head[0][:cut] + keys[cut:], head[1][:cut] + weights[cut:]
            path, node = [], ROOT
            for key in keys:
                node = hashlib.blake2b(node + key, digest_size=WIDTH).digest()
                path.append(node)
            rows.append((conv, b"".join(path), weights))
            held += len(path)
            if held > 50_000:
                yield packed()
                rows, held = [], 0
        yield packed()

    base = F.col("conv_id") - F.col("conv_id") % every
    ordered = turns.withColumn("base", base).repartition("base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "key"
    )
    return ordered.select("base", "conv_id", "key", "weight").mapInArrow(run, "conv_id bigint, path binary, weights array<bigint>")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, weights, n, first, ends_sha256): the convs of each distinct path, the smallest of them, and the
    digest of all their ids in order. Ids are joined per range of 4096 first; a frequent path then sends one
    row per range to the task that digests them, which holds one row at a time."""
    last = F.when(F.octet_length("path") == 0, F.lit(ROOT)).otherwise(F.expr(f"substring(path, -{WIDTH})"))
    ranges = (
        paths.withColumn("end", last)
        .groupBy("end", F.shiftright("conv_id", IDS_SHIFT).alias("ids"))
        .agg(
            F.first("path").alias("path"), F.first("weights").alias("weights"), F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("first"), F.sort_array(F.collect_list("conv_id")).alias("members"),
        )
        .withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, row, sha = None, None, None
        for batch in batches:
            rows = []
            for end, path, weights, n, first, members in zip(*(column.to_pylist() for column in batch.columns)):
                if end != current:
                    if current is not None:
                        rows.append((*row, sha.hexdigest()))
                    current, row, sha = end, [path, weights, n, first], hashlib.sha256(members.encode())
                else:
                    row[2] += n
                    row[3] = min(row[3], first)
                    sha.update(b"," + members.encode())
            yield _packed(rows)
        yield _packed([] if current is None else [(*row, sha.hexdigest())])

    def _packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        names = ["path", "weights", "n", "first", "ends_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ordered = ranges.repartition("end").sortWithinPartitions("end", "ids")
    return ordered.select("end", "path", "weights", "n", "first", "members").mapInArrow(
        run, "path binary, weights array<bigint>, n bigint, first bigint, ends_sha256 string"
    )


# --- shards and spines ---

_NODE = [
    ("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("ends_sha256", pa.string()),
]
_SPINE = [
    ("shard", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("depth", pa.int32()), ("id", pa.binary()),
    ("weight", pa.int64()), ("own", pa.int64()), ("own_first", pa.int64()), ("ends_sha256", pa.string()),
    *((f"below_{name}", pa.int64()) for name in Totals.BELOW),
]
_SQL_KIND = {pa.binary(): "binary", pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string"}


def _struct(fields: list[tuple[str, pa.DataType]]) -> str:
    return "struct<" + ",".join(f"{name}:{_SQL_KIND[kind]}" for name, kind in fields) + ">"


_OUT = f"node {_struct(_NODE)}, spine {_struct(_SPINE)}"


def _batch(nodes: dict[str, list], spines: dict[str, list]) -> pa.RecordBatch:
    """Finished nodes, then spine nodes; a row is one or the other."""
    sizes = len(nodes["id"]), len(spines["id"])

    def column(values: dict[str, list], fields: list, before: int, after: int) -> pa.StructArray:
        arrays = [pa.array([None] * before + list(values[name]) + [None] * after, kind) for name, kind in fields]
        missing = pa.array([True] * before + [False] * len(values["id"]) + [True] * after)
        return pa.StructArray.from_arrays(arrays, fields=[pa.field(*field) for field in fields], mask=missing)

    return pa.RecordBatch.from_arrays(
        [column(nodes, _NODE, 0, sizes[1]), column(spines, _SPINE, sizes[0], 0)], names=["node", "spine"]
    )


def _solved(
    shard: int, piece: int, ids: list[bytes], depth: np.ndarray, weight: np.ndarray, own: np.ndarray, first: np.ndarray,
    sha: list[str | None], below: dict[str, np.ndarray], top: bool,
) -> pa.RecordBatch:
    """The nodes of one trie: finished ones, and unless it is the ``top`` one its spines for the next level."""
    found = Totals(depth, weight, own, first, below)
    count, parent = len(ids), found.parent
    spine = np.zeros(count, bool)
    if not top:
        # the first path goes down until the depth falls, the last one up from the last node
        spine[: np.append(np.flatnonzero(np.diff(depth) < 1), count - 1)[0] + 1] = True
        node = count - 1
        while node > 0 and not spine[node]:
            spine[node] = True
            node = parent[node]
    done = np.flatnonzero(~spine)
    # a spine node's smallest conv may be in another shard, so its children learn it at the end
    above = np.where(spine[parent] | (np.arange(count) == 0), -1, parent)
    nodes = {
        "id": [ids[k] for k in done], "parent": [ids[parent[k]] if k else None for k in done],
        "depth": depth[done], "conv_id": found.first[done],
        "parent_conv_id": [int(found.first[k]) if k >= 0 else None for k in above[done].tolist()],
        "n_convs": found.n[done], "n_children": found.children[done], "n_leaves": found.leaves[done],
        "saved": (found.weighted - found.weights)[done], "ends_sha256": [sha[k] for k in done],
    }
    kept = np.flatnonzero(spine)
    hanging = done[spine[parent[done]]] if len(kept) else done[:0]
    onto = parent[hanging]
    for name, values in (
        ("n", found.n), ("weighted", found.weighted), ("weights", found.weights), ("leaves", found.leaves),
        ("children", np.ones(count, np.int64)),
    ):
        np.add.at(below[name], onto, values[hanging])
    np.minimum.at(below["first"], onto, found.first[hanging])
    spines = {
        "shard": [shard] * len(kept), "piece": [piece] * len(kept), "at": kept, "depth": depth[kept],
        "id": [ids[k] for k in kept], "weight": weight[kept], "own": own[kept], "own_first": first[kept],
        "ends_sha256": [sha[k] for k in kept], **{f"below_{name}": below[name][kept] for name in Totals.BELOW},
    }
    return _batch(nodes, spines)


def _nothing_below(count: int) -> dict[str, np.ndarray]:
    below = {name: np.zeros(count, np.int64) for name in Totals.BELOW}
    below["first"][:] = NOBODY
    return below


def _shard(shard: int, piece: int, rows: list[tuple]) -> pa.RecordBatch:
    """The trie of consecutive distinct paths."""
    data = b"".join(row[0] for row in rows)
    pairs = np.frombuffer(data, np.uint64).reshape(-1, WIDTH // 8)
    size = np.array([len(row[0]) // WIDTH for row in rows], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(owner)) - start[owner]
    earlier = np.maximum(owner - 1, 0)
    shared = (owner > 0) & (place < size[earlier])
    twin = np.where(shared, start[earlier] + place, 0)
    fresh = np.flatnonzero(~(shared & (pairs[twin] == pairs).all(axis=1)))
    count = 1 + len(fresh)
    depth = np.concatenate([[0], place[fresh] + 1])
    weights = np.fromiter((w for row in rows for w in row[1]), np.int64, len(owner))
    # every path but the empty one, which is the first, ends with a node of its own
    ends = np.cumsum(np.bincount(owner[fresh], minlength=len(rows)))
    own, first, sha = np.zeros(count, np.int64), np.full(count, NOBODY), [None] * count
    for end, row in zip(ends.tolist(), rows):
        own[end], first[end], sha[end] = row[2], row[3], row[4]
    ids = [ROOT, *(data[k * WIDTH:(k + 1) * WIDTH] for k in fresh.tolist())]
    weight = np.concatenate([[0], weights[fresh]])
    return _solved(shard, piece, ids, depth, weight, own, first, sha, _nothing_below(count), top=False)


def _merged(shard: int, rows: Iterator[tuple], top: bool) -> pa.RecordBatch:
    """The trie of spines that come in the order of their shards; what belongs to one node is added up."""
    stack: list[int] = []
    out: list[list] = []
    for depth, node, weight, own, own_first, sha, *below in rows:
        if depth < len(stack) and out[stack[depth]][1] == node:
            mine = out[stack[depth]]
            mine[3] += own
            mine[4] = min(mine[4], own_first)
            mine[5] = mine[5] or sha
            mine[6:11] = [a + b for a, b in zip(mine[6:11], below[:5])]
            mine[11] = min(mine[11], below[5])
        else:
            del stack[depth:]
            stack.append(len(out))
            out.append([depth, node, weight, own, own_first, sha, *below])
    depth, ids, weight, own, first, sha, *below = zip(*out)
    numbers = [np.array(values, np.int64) for values in (depth, weight, own, first)]
    sums = {name: np.array(values, np.int64) for name, values in zip(Totals.BELOW, below)}
    return _solved(shard, 0, list(ids), *numbers, list(sha), sums, top=top)


def trie(paths: DataFrame, shard_turns: int = SHARD_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, weights), its columns those of ``_NODE``.

    Without a path there is no node, not even the root.
    """
    spark = prepare(paths.sparkSession)
    scratch = Scratch(spark, "prefix-trie")
    sequences = scratch.store(distinct_paths(paths), "paths")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, piece, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and held + len(row[1]) > shard_turns:
                    yield _shard(shard, piece, rows)
                    piece, rows, held = piece + 1, [], 0
                rows.append(row)
                held += len(row[1])
        if rows:
            yield _shard(shard, piece, rows)

    ordered = sequences.repartitionByRange("path").sortWithinPartitions("path")
    level, out = 0, [scratch.store(ordered.mapInArrow(shards, _OUT), "level-0")]
    while True:
        spines = out[-1].filter("spine IS NOT NULL").select("spine.*")
        last = spines.agg(F.max("shard")).first()[0]
        if last is None:
            return out[0].select("node.*")
        top = last < fan_in
        level += 1

        def merge(batches: Iterator[pa.RecordBatch], top: bool = top) -> Iterator[pa.RecordBatch]:
            def stream() -> Iterator[tuple]:
                for batch in batches:
                    yield from zip(*(column.to_pylist() for column in batch.columns))

            rows = stream()
            ahead = next(rows, None)
            while ahead:
                group = ahead[0]

                def mine() -> Iterator[tuple]:
                    nonlocal ahead
                    while ahead and ahead[0] == group:
                        yield ahead[1:]
                        ahead = next(rows, None)

                yield _merged(group, mine(), top)

        grouped = spines.withColumn("group", F.floor(F.col("shard") / fan_in))
        placed = grouped.repartition(1) if top else grouped.repartition("group")
        columns = ["group", *(name for name, _ in _SPINE[3:])]
        merged = placed.sortWithinPartitions("group", "shard", "piece", "at").select(columns).mapInArrow(merge, _OUT)
        out.append(scratch.store(merged, f"level-{level}"))
        if top:
            break
    nodes = [part.filter("node IS NOT NULL").select("node.*") for part in out]
    upper = nodes[1]
    for part in nodes[2:]:
        upper = upper.unionByName(part)
    every = nodes[0].unionByName(upper)
    known = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    owners = upper.select(F.col("id").alias("parent"), F.col("conv_id").alias("owner"))
    late = every.filter(~known).join(owners, "parent").withColumn("parent_conv_id", F.col("owner")).select(every.columns)
    return every.filter(known).unionByName(late)


def op12_prefix_trie(spark, sf_dir):
    """The trie of all conversations, rebuilt."""
    conversations = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    nodes = trie(rebuilt(turns_of(conversations)))
    return nodes.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


OP12_SQL = f"""
WITH own AS (
    SELECT conv_id, coalesce(text, '') AS text,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
    SELECT conv_id, conv_id - conv_id % {EVERY} AS base,
           xor(list_reduce(
               list_concat([cast(4294967295 AS bigint)], list_transform(range(8 * length(cast(conv_id AS varchar))), lambda k:
                   CASE WHEN k % 8 = 0 THEN cast(ascii(substr(cast(conv_id AS varchar), cast(k // 8 + 1 AS bigint), 1)) AS bigint)
                        ELSE cast(0 AS bigint) END)),
               lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)),
               cast(4294967295 AS bigint)) % {LONGEST} AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
joined AS (
    SELECT conv.conv_id, 0 AS part, i, key, text FROM conv JOIN own ON own.conv_id = base WHERE i <= h
    UNION ALL
    SELECT conv.conv_id, 1, i, key, text FROM conv JOIN own ON own.conv_id = conv.conv_id WHERE i > h),
step AS (
    SELECT conv_id, key, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM joined),
path AS (
    SELECT conv_id, depth, octet_length(encode(text)) AS weight,
           sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
    FROM step
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM conv),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM path),
node AS (
    SELECT node, depth, any_value(parent) AS parent, any_value(weight) AS weight, min(conv_id) AS conv_id, count(*) AS n_convs
    FROM linked GROUP BY node, depth),
child AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent),
ended AS (
    SELECT node, sha256(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(node, depth) AS node FROM path GROUP BY conv_id) GROUP BY node),
pair AS (
    SELECT DISTINCT a.node AS node, b.node AS below
    FROM path AS a JOIN path AS b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
subtree AS (
    SELECT pair.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * weight) AS saved
    FROM pair JOIN node ON node.node = below LEFT JOIN child ON child.node = below
    GROUP BY pair.node)
SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, cast(saved AS bigint) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node JOIN subtree USING (node) LEFT JOIN child USING (node) LEFT JOIN ended USING (node)
LEFT JOIN node AS above ON node.parent = above.node AND node.depth > 0"""
