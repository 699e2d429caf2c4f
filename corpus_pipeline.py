"""A corpus from documents: language, exact and near duplicates, benchmark items, tokens.

STAGES are applied in order; each gets what its predecessor kept, written as Parquet and read again. All but
the last return the columns of documents. Every row meets its own decision: where rows share a doc_id or have
none, a stage judges them by numbers that it gives to the rows of its stored input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, decontaminate, exact_dedup, lang_id, ngram_join
from tallyhouse.llm.shared import OWNER, Scratch, numbered, prepare

MIN_LANGUAGE_SCORE = 0.3
VOCABULARY = "word_bpe_49k.json"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the dropped ones."""
    return docs.join(dropped.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def _left(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], nulls_first: bool = False) -> DataFrame:
    """The rows that ``judge``, given rows whose doc_id tells them apart, does not name as dropped."""
    rows = numbered(docs, nulls_first)
    if rows is None:
        return _without(docs, judge(docs))
    left = _without(rows, judge(rows.drop(OWNER)))
    return left.select(*(F.col(OWNER if name == "doc_id" else name).alias(name) for name in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or in none of the known languages, go. The prediction is per row."""
    return lang_id.keep_known(docs, lang_id.fit(docs), MIN_LANGUAGE_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one without an id only where none has one."""
    return _left(docs, lambda rows: exact_dedup.exact_dedup(rows).filter(~F.col("kept")), nulls_first=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by similarity that with the smallest doc_id stays, one without an id only where none
    has one."""
    return _left(docs, lambda rows: ngram_join.jaccard_links(rows).filter("component_id <> doc_id"))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _left(docs, lambda rows: decontaminate.contaminated(rows, benchmark))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, decoded again: doc_id, lang, source, n_tokens, ids and decoded text."""
    path = bpe.public_vocabulary(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "decoded",
    )


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_items", benchmark_items),
    ("tokens", tokens),
]

# a trained network and an approximate order of merges have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next one reads it."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
