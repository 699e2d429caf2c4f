"""Exact duplicates by skew-safe combining.

Equal texts are combined three times, each time by comparing the texts themselves: within a task ahead of
the shuffle, within a share (salt) of a digest's documents, and across the shares. A group of copies that
holds a third of all rows sends one row per task and share, so no task sees the group as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, documents, one_per_text, prepare, texts

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): the group of equal texts each document is in.

    The document with the largest id stays. Null and empty texts are equal. Rows without an id are left
    out; each id and text counts once, so an id with several texts is in several groups; other columns are
    ignored. An empty table gives an empty result. ``digest`` only groups: texts with the same digest are
    told apart.
    """
    prepare(docs.sparkSession)
    return equal_texts(one_per_text(docs), digest, salts)


def equal_texts(rows: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The same for every row of (doc_id, text): ``group_size`` counts rows, and a row without an id has its
    group's largest id, and null for ``kept``."""
    scratch = Scratch(prepare(rows.sparkSession), "exact-dedup")
    rows = rows.withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    )
    groups = scratch.store(
        salted.groupBy("digest", "text")
        .agg(F.max("winner").alias("keep_id"), F.sum("copies").alias("group_size"))
        .drop("text"),
        "groups",
    )
    # stored, so that the join below has plain shuffles on both sides, whose hot partitions Spark can split
    per_digest = scratch.store(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "per-digest",
    )
    alone = per_digest.filter("contents = 1").drop("contents")
    sha = F.sha2("text", 256).alias("text_sha256")
    found = ["doc_id", "keep_id", "group_size", "text_sha256"]
    members = rows.select("doc_id", "digest", sha).join(alone.hint("merge"), "digest").select(found)
    mixed = per_digest.filter("contents > 1").select("digest")
    if not mixed.isEmpty():
        clash = rows.join(mixed, "digest", "left_semi")
        told = clash.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        members = members.unionByName(clash.join(told, ["digest", "text"]).select("*", sha).select(found))
    return members.withColumn("kept", F.col("doc_id") == F.col("keep_id"))


def op5_exact_dedup(spark, sf_dir):
    return equal_texts(texts(documents(spark, sf_dir)))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))"""
