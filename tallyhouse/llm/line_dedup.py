"""Lines that an earlier document already has, as per-document bitmaps.

Line hashes are placed by range, each range sorted by hash, document and position. One pass over a sorted
run streams the first document of every hash. A hash is placed in several salted runs, so a line that a
third of all documents hold is spread over tasks; the runs' first documents are then combined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shared import OWNER, Scratch, by_row, documents, one_per_text, prepare, repeated_ids

SALTS = 16
MIN_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
WORD = 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def later_lines(rows: DataFrame, scratch: Scratch, min_chars: int, salts: int) -> DataFrame:
    """(doc_id, pos) of lines whose key a document with a smaller id holds. Numbered rows are compared by the
    ids they had; without one they neither lose lines nor hold them first."""
    rows = rows.filter(F.col(OWNER).isNotNull()) if OWNER in rows.columns else rows
    owner = [OWNER] if OWNER in rows.columns else []
    of = [*owner, "doc_id"][0]
    keyed = (
        rows.select("doc_id", *owner, F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", *owner, "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select(
            F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", *owner, "pos",
        )
    )
    placed = keyed.repartitionByRange("hash", "salt").sortWithinPartitions("hash", "salt", *owner, "doc_id", "pos")
    run = Window.partitionBy("hash", "salt").orderBy(*owner, "doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    streamed = scratch.store(
        placed.select("hash", "doc_id", *owner, "pos", F.first(of).over(run).alias("run_first")), "streamed"
    )
    repeated = (
        streamed.groupBy("hash").agg(F.min("run_first").alias("first"), F.max("run_first").alias("last"))
        .filter(F.col("first") < F.col("last")).select("hash", "first")
    )
    within = streamed.filter(F.col(of) > F.col("run_first")).select("doc_id", "pos")
    across = (
        streamed.filter(F.col(of) == F.col("run_first"))
        .join(repeated.hint("merge"), "hash").filter(F.col(of) > F.col("first")).select("doc_id", "pos")
    )
    return within.unionByName(across)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """(doc_id, words): for documents that lose lines, the 64-bit words of their bitmap that have a dropped
    line, as (word number, dropped bits). Words that are left out keep all their lines.

    A key is the line with ASCII blanks stripped and A-Z lower-cased. A key of at least ``min_chars`` code
    points that several documents hold stays in the smallest id only, with all its lines there. Null text
    is one empty line. Rows without an id are left out, and an id may have one text; ``line_dedup`` takes any.
    """
    return _bitmaps(_told_apart(docs), min_chars, salts)


def _told_apart(docs: DataFrame) -> DataFrame:
    rows = one_per_text(docs)
    if repeated_ids(rows):
        raise ValueError("an id has several texts, which bitmaps by id cannot tell apart: use line_dedup")
    return rows


def _bitmaps(rows: DataFrame, min_chars: int, salts: int) -> DataFrame:
    scratch = Scratch(prepare(rows.sparkSession), "line-dedup")
    dropped = later_lines(rows, scratch, min_chars, salts)
    words = (
        dropped.groupBy("doc_id", F.floor(F.col("pos") / WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("dropped"))
    )
    bitmaps = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word", "dropped"))).alias("words"))
    stored = scratch.store(bitmaps, "bitmaps")
    scratch.drop("streamed")
    return stored


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): each document without the lines its bitmap drops."""
    return _applied(_told_apart(docs), bitmaps)


def _applied(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    joined = rows.select("doc_id", "text").join(bitmaps.hint("merge"), "doc_id", "left")
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    n_dropped = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w["dropped"]))
    gone = F.flatten(
        F.transform(
            "words",
            lambda w: F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.lit(WORD - 1)),
                    lambda b: F.when(F.getbit(w["dropped"], b) == 1, w["word"] * WORD + b),
                ),
                lambda p: p.isNotNull(),
            ),
        )
    )
    # the outer transforms bind the line list and the kept positions once per document
    kept = F.transform(
        F.array(split_lines(F.col("text"))),
        lambda lines: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda p: F.get(lines, p)
            ),
            "\n",
        ),
    )[0]
    return joined.select(
        "doc_id", n_lines.cast("bigint").alias("n_lines"),
        F.when(F.col("words").isNull(), 0).otherwise(n_dropped).cast("bigint").alias("n_dropped"),
        F.when(F.col("words").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS, every_row: bool = False
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): each id and text without the lines that a smaller id has.

    Texts of one id do not take lines from each other. With ``every_row`` each row of the table is returned;
    those without an id keep all their lines, as no id is smaller."""
    prepare(docs.sparkSession)
    return by_row(docs, lambda rows: _applied(rows, _bitmaps(rows, min_chars, salts)), "doc_id", every_row=every_row)


def op10_line_dedup(spark, sf_dir):
    return line_dedup(documents(spark, sf_dir), every_row=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP10_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM split),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM line),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
    SELECT keyed.*, coalesce(held.first < keyed.doc_id, false) AS dropped
    FROM keyed LEFT JOIN held ON keyed.key = held.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
