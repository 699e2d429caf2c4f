"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

An item of n shingles is contained when at least PERCENT of them are in a document. Then, of any
n - ceil(n * PERCENT / 100) + 1 of its shingles, one is in the document; the search takes those with the
smallest hashes, the item's MinHash sketch. Items are partitioned by size, and each partition has its own
limit: the largest hash in any of its sketches. A long document offers each partition only the shingles up
to its limit, where they are made, and meets the sketches of that partition alone. Nothing is missed; what
is found is verified on the words.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, documents, prepare, texts

WORDS = 5
PERCENT = 75
BROADCAST_BYTES = 12 << 20  # of a side as counted; a larger benchmark is joined by sorting


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of characters other than ASCII blanks."""
    lowered = F.translate(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, " ", -1), lambda w: w != "")


def shingles_of(text: Column, length: int, value) -> Column:
    """``value`` (a function of five words) of each run of ``length`` words; the outer transform binds the
    word list once."""
    return F.transform(
        F.array(words_of(text)),
        lambda words: F.when(
            F.size(words) >= length,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0))),
                lambda at: value(*[F.get(words, at + n) for n in range(length)]),
            ),
        ).otherwise(F.array().cast("array<bigint>" if value is F.xxhash64 else "array<string>")),
    )[0]


def joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def benchmark_texts(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): every distinct text under an id, or under none, is an item with a number."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text")


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """(item, length, n, shingle, hash): distinct shingles of each item. An item of fewer words than ``words``
    is one shingle of its own length; one without words has none."""
    cut = items.select("item", words_of(F.col("text")).alias("words"))
    length = F.least(F.size("words"), F.lit(words))
    runs = cut.filter(F.size("words") > 0).select(
        "item", length.alias("length"), "words",
        F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"),
    )
    shingle = F.slice("words", F.col("at") + 1, F.col("length"))
    each = runs.select("item", "length", F.array_join(shingle, " ").alias("shingle"), shingle.alias("list")).distinct()
    hashed = F.lit(None).cast("bigint")
    for n in range(1, words + 1):
        hashed = F.when(F.col("length") == n, F.xxhash64(*[F.get("list", F.lit(i)) for i in range(n)])).otherwise(hashed)
    sizes = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return each.select("item", "length", "shingle", hashed.alias("hash")).join(sizes, "item")


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(item, length, size_class, n, hash): of each item the smallest hashes that suffice."""
    lists = items.groupBy("item", "length", "n").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    enough = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return lists.select(
        "item", "length", "n", F.floor(F.log2(F.col("n"))).cast("int").alias("size_class"),
        F.explode(F.slice("hashes", F.lit(1), enough.cast("int"))).alias("hash"),
    )


def offered(text: Column, length: int, limits: dict[int, int]) -> Column:
    """(size_class, hash) of the text's shingles: each size class gets those up to its own limit."""

    def up_to(hashes: Column, limit: int) -> Column:
        return F.filter(hashes, lambda h: h <= F.lit(limit))

    def of_class(hashes: Column, size_class: int) -> Column:
        within = up_to(hashes, limits[size_class])
        return F.transform(within, lambda h: F.struct(F.lit(size_class).alias("size_class"), h.alias("hash")))

    below = F.array_distinct(up_to(shingles_of(text, length, F.xxhash64), max(limits.values())))
    # the outer transform binds the hashes once for all classes
    return F.transform(
        F.array(below), lambda hashes: F.flatten(F.array(*(of_class(hashes, size_class) for size_class in sorted(limits))))
    )[0]


def sized(df: DataFrame, size: int) -> DataFrame:
    """A side of a known number of bytes: broadcast up to the bound, joined by sorting beyond it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items contained in a document, with the size of the item's
    shingle set and how much of it the document has.

    Null texts count as empty; an empty item or document matches nothing. An item of fewer than ``words``
    words is contained where its words appear in a row. Different texts under one item_id, or under none, are
    items of their own. Rows sharing a doc_id are one document with the shingles of all, and so are the rows
    without one; other columns are ignored. All shingles of one text are held at once.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "decontaminate")
    rows = texts(docs).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("nameless"), "text"
    )
    named = scratch.store(benchmark_texts(benchmark), "texts")
    items = scratch.store(item_shingles(named, words), "items")
    wanted = scratch.store(sketches(items, percent), "sketches")
    limits = wanted.groupBy("length", "size_class").agg(F.max("hash").alias("limit"), F.count(F.lit(1)).alias("rows"))
    partitions = [tuple(row) for row in limits.collect()]  # at most `words` lengths times 64 size classes
    lengths = sorted({row[0] for row in partitions})
    found = None
    for length in lengths:
        of_length = [row for row in partitions if row[0] == length]
        offers = rows.select(
            "doc", "nameless", F.explode(offered(F.col("text"), length, {row[1]: row[2] for row in of_length})).alias("of")
        ).select("doc", "nameless", "of.size_class", "of.hash")
        sketch = wanted.filter(F.col("length") == length).select("size_class", "hash", "item")
        hits = offers.join(sized(sketch, 24 * sum(row[3] for row in of_length)), ["size_class", "hash"])
        hits = hits.select("doc", "nameless", "item")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint")
    candidates = scratch.store(found.distinct(), "candidates")
    repeated = not rows.groupBy("doc", "nameless").count().filter("count > 1").isEmpty()
    held = verified(rows, items, candidates, percent, lengths, repeated)
    return held.join(named.select("item", "item_id"), "item").select(
        F.when(~F.col("nameless"), F.col("doc")).alias("doc_id"), "item_id", F.col("n").alias("n_shingles"), "n_shared"
    )


def verified(
    rows: DataFrame, items: DataFrame, candidates: DataFrame, percent: int, lengths: list[int], repeated: bool
) -> DataFrame:
    """Exact containment of the candidate pairs, on the words themselves. ``repeated`` tells that rows share
    ids, so that several may hold a shingle."""
    suspects = candidates.select("doc", "nameless").distinct()
    texts = rows.join(sized(suspects, 16 * suspects.count()), ["doc", "nameless"], "left_semi")
    size = items.agg(F.sum(F.octet_length("shingle") + 40)).first()[0]
    shared = None
    for length in lengths:
        held = texts.select(
            "doc", "nameless", F.explode(F.array_distinct(shingles_of(F.col("text"), length, joined))).alias("shingle")
        )
        own = items.filter(F.col("length") == length).select("shingle", "item", "n")
        hits = held.join(sized(own, size), "shingle")
        if repeated:
            hits = hits.distinct()
        part = hits.groupBy("doc", "nameless", "item", "n").agg(F.count(F.lit(1)).alias("n_shared"))
        shared = part if shared is None else shared.unionByName(part)
    return shared.filter(F.col("n_shared") * 100 >= F.col("n") * percent).join(
        candidates.hint("merge"), ["doc", "nameless", "item"], "left_semi"
    )


def op6_decontaminate(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH item AS (
    SELECT row_number() OVER () AS item, item_id, text
    FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
text AS (
    SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'i', item, text FROM item),
cut AS (
    SELECT kind, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM text),
lengths AS (SELECT DISTINCT least(len(words), 5) AS length FROM cut WHERE kind = 'i' AND len(words) > 0),
place AS (
    SELECT kind, id, words, length, unnest(range(1, len(words) - length + 2)) AS p
    FROM cut JOIN lengths ON kind = 'd' OR length = least(len(words), 5)
    WHERE len(words) >= length),
shingle AS (SELECT DISTINCT kind, id, length, array_to_string(words[p : p + length - 1], ' ') AS s FROM place),
size AS (SELECT id, count(*) AS n FROM shingle WHERE kind = 'i' GROUP BY id),
held AS (
    SELECT d.id AS doc_id, i.id AS item, count(*) AS n_shared
    FROM shingle d JOIN shingle i ON d.kind = 'd' AND i.kind = 'i' AND d.length = i.length AND d.s = i.s
    GROUP BY d.id, i.id)
SELECT doc_id, item_id, n AS n_shingles, n_shared
FROM held JOIN size ON size.id = held.item JOIN item USING (item)
WHERE n_shared * 100 >= n * 75"""
