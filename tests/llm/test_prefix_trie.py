"""The prefix trie: parentheses against plain search, shards and spines against loops over all prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from check import twin_tables

from tallyhouse.llm import prefix_trie
from tallyhouse.llm.queries import QUERIES, SQL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, id string"
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(rows, every=5, longest=9):
    """{conv: [(role, text)]}; turns that tie are in the order of the digest of role and text."""
    def tie(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]

    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {conv: [turn[3:] for turn in sorted(turns)] for conv, turns in own.items()}
    out = {}
    for conv, turns in own.items():
        cut = zlib.crc32(str(conv).encode()) % longest
        base = conv - (abs(conv) % every) * (1 if conv >= 0 else -1)
        out[conv] = own.get(base, [])[:cut] + turns[cut:]
    return out


def plain(conversations):
    """Rows of the trie from all prefixes of all conversations."""
    prefixes = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            prefixes.setdefault(tuple(turns[:depth]), []).append(conv)
    children, leaves, saved = Counter(p[:-1] for p in prefixes if p), Counter(), Counter()
    for p, members in prefixes.items():
        for depth in range(len(p) + 1):
            leaves[p[:depth]] += p not in children
            saved[p[:depth]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    rows = []
    for top, members in prefixes.items():
        ends = sorted(conv for conv in members if len(conversations[conv]) == len(top))
        rows.append((
            min(members), len(top), min(prefixes[top[:-1]]) if top else None, len(members), children[top], leaves[top], saved[top],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def found(nodes):
    return sorted(
        ((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"],
          r["ends_sha256"] or NOTHING) for r in nodes.collect()), key=repr,
    )


def random_rows(seed, convs=60, longest=9):
    pick = random.Random(seed)
    rows = [
        (conv, turn, pick.choice(["user", "assistant", None]), pick.choice(["a", "b", "ü", None]), "x", "y")
        for conv in pick.sample(range(-20, 200), convs) for turn in range(pick.randrange(1, longest))
    ]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_findclose(seed):
    pick, depth = random.Random(seed), [0]
    for _ in range(3000):
        depth.append(pick.randrange(max(1, depth[-1] - 6), depth[-1] + 2))
    if seed == 2:
        depth = list(range(2000))
    tree = prefix_trie.Parentheses(np.array(depth))
    stack, want = [], {}
    for place, bit in enumerate(tree.bits.tolist()):
        if bit:
            stack.append(place)
        else:
            want[stack.pop()] = place
    assert not stack and tree.findclose(tree.opens).tolist() == [want[place] for place in tree.opens.tolist()]


@pytest.mark.parametrize("shard_turns, fan_in, parts", [(1, 2, 7), (5, 2, 4), (40, 3, 3), (10_000, 256, 1)])
def test_shards_and_levels(spark, shard_turns, fan_in, parts):
    rows = random_rows(shard_turns)
    # one conversation many times, under a prefix that many share, and a very long one
    rows += [(1000 + n, turn, "user", "same", "", "") for n in range(0, 200, 5) for turn in range(6)]
    rows += [(5000, turn, "user", str(turn % 3), "", "") for turn in range(300)]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(5))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = prefix_trie.trie(prefix_trie.rebuilt(turns), shard_turns, fan_in)
        assert found(nodes) == plain(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_as_they_are(spark):
    rows = random_rows(8)
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)), every=1), 7, 2)
    assert found(nodes) == plain(rebuilt(rows, every=1))


def test_members_in_numeric_order_over_several_ranges(spark):
    rows = [(conv, 0, "user", "hi", "", "") for conv in (-9000, -5, 0, 5, 10, 95, 100, 9000, 10 ** 12)]
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA)), every=1))
    assert found(nodes) == plain(rebuilt(rows, every=1))


def test_awkward_rows_equal_sql(spark, tmp_path):
    rows = [
        (None, 1, "user", "lost", "", ""), (7, None, None, None, "", ""), (7, 2, "user", "long " * 50_000, "", ""),
        (7, 2, "user", "tie", "", ""), (7, 2, "user", "tie", "", ""), (12, 3, "", "", "", ""), (10, 1, "user", "", "", ""),
        (11, 1, "user", "", "", ""), (11, 1, "user", "", "", ""), (3, 5, "a", "bc", "", ""), (4, 5, "ab", "c", "", ""),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    names = got.columns
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == plain(rebuilt(rows))
    twin = twin_tables("/nowhere")
    twin.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(twin.execute(f"SELECT {', '.join(names)} FROM ({SQL['op12_prefix_trie']})").fetchall(), key=repr) == got


def test_no_conversation(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x", "", "")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_prefix_trie"](spark, str(tmp_path)).count() == 0
