"""Vector codes: masks against plain search, the whole training against a plain loop, awkward vectors."""

import hashlib
import math

import numpy as np
import pytest
from check import twin_tables

from tallyhouse.llm import vector_codes
from tallyhouse.llm.queries import QUERIES, SQL

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def plain(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """{row number: (code, error)} and the entries, by loops over Python numbers."""
    size = len(vectors[0])
    cut = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    whole = [[math.floor(x * scale) for x in v] for v in vectors]
    books = [[v[a:b] for v in whole[:entries]] for a, b in cut]

    def assign(v):
        out = []
        for (a, b), book in zip(cut, books):
            squares = [sum((x - c) ** 2 for x, c in zip(v[a:b], entry)) for entry in book]
            out.append((squares.index(min(squares)), min(squares)))
        return out

    for _ in range(rounds):
        found = [assign(v) for v in whole]
        for p, (a, b) in enumerate(cut):
            for e in range(len(books[p])):
                mine = [v[a:b] for v, f in zip(whole, found) if f[p][0] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [assign(v) for v in whole]
    codes = [("".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for f in found]
    return codes, ",".join(str(x) for book in books for entry in book for x in entry)


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("count", [1, 16, 64, 100])
def test_masks_find_the_nearest_entry(kind, count):
    random = np.random.default_rng(count)
    entries = random.integers(-6, 6, (count, 4)).astype(kind)
    points = random.integers(-9, 9, (500, 4)).astype(kind)
    slices = vector_codes.Slices(entries)
    index, square = slices.nearest(points)
    every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == [row.index(min(row)) for row in every.tolist()]
    assert square.tolist() == [min(row) for row in every.tolist()]
    # the masks hold exactly the entries within the radius in every dimension, and so every nearest one
    near = (abs(points[:, None, :] - entries[None]) <= slices.radius(points)[:, None, None]).all(axis=2)
    masks = slices.candidates(points)
    for entry in range(count):
        held = masks[:, entry // 64] >> np.uint64(entry % 64) & np.uint64(1)
        assert (held.astype(bool) == near[:, entry]).all()


def test_training_equals_a_plain_loop(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(0, 0.3, (90, 24)).astype(np.float32).tolist()
    vectors[40:60] = vectors[:20]
    table = spark.createDataFrame([(n, v, n % 3, "x", "y") for n, v in enumerate(vectors)], SCHEMA).repartition(5)
    codebooks = vector_codes.train(table)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode(table, codebooks).collect()}
    codes, numbers = plain(vectors)
    assert [got[n] for n in range(90)] == codes
    assert codebooks.sha256() == hashlib.sha256(numbers.encode()).hexdigest()


def test_decoded_codes_are_the_entries(spark):
    table = spark.createDataFrame([(n, [n / 10.0] * 10, 0, "", "") for n in range(20)], SCHEMA)
    codebooks = vector_codes.train(table)
    coded = vector_codes.encode(table, codebooks)
    for row in vector_codes.decode(coded, codebooks).collect():
        whole = [math.floor(4096 * float(np.float32(row["vec_id"] / 10))) for _ in range(10)]
        assert sum((a - round(b * 4096)) ** 2 for a, b in zip(whole, row["approximation"])) == row["error"]


def test_awkward_vectors(spark, tmp_path):
    rows = [
        (5, [0.5] * 16, None), (5, [0.5] * 16, None), (None, [0.25] * 16, 1), (1, None, 1), (2, [None] * 16, 1),
        (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1), (6, [], 2), (7, [1.0] * 3, 2), (8, [-0.5] * 16, None),
    ]
    spark.createDataFrame([(*row, "x", "y") for row in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect(), key=repr)
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 5, 5, 8] and all(r["error"] == 0 for r in got)
    twin = twin_tables("/nowhere")
    twin.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names = sorted(got[0].asDict())
    want = twin.execute(f"SELECT {', '.join(names)} FROM ({SQL['op11_vector_codes']})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r[n] for n in names) for r in got), key=repr)


def test_parts_of_a_length_that_is_no_multiple(spark):
    table = spark.createDataFrame([(n, [float(n), 1.0, 2.0], 0, "", "") for n in range(5)], SCHEMA)
    codebooks = vector_codes.train(table, parts=2, entries=3, rounds=2)
    assert codebooks.bounds == [(0, 1), (1, 3)]
    assert vector_codes.encode(table, codebooks).count() == 5


def test_huge_components_are_exact(spark):
    vectors = [[3e30, -1.0], [3e30, 1.0], [0.5, 0.25], [1e9, 2.0]]
    table = spark.createDataFrame([(n, v, 0, "", "") for n, v in enumerate(vectors)], SCHEMA)
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    codebooks = vector_codes.train(table, parts=1, entries=2, rounds=2)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode(table, codebooks).collect()}
    codes, numbers = plain(vectors, parts=1, entries=2, rounds=2)
    assert [got[n] for n in range(4)] == [(c, e if e < 1 << 63 else None) for c, e in codes]
    assert codebooks.sha256() == hashlib.sha256(numbers.encode()).hexdigest()


def test_no_usable_vector(spark, tmp_path):
    table = spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)
    assert vector_codes.train(table) is None and vector_codes.train(table.limit(0)) is None
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_vector_codes"](spark, str(tmp_path)).count() == 0
