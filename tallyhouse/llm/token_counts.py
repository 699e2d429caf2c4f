"""Token totals by source, language and tokenizer version, maintained from signed changes.

A change inserts a document, deletes one, or revises its counts; it carries the counts it adds and those it
takes away, so totals are sums of signed deltas and no document has to be looked up. A batch of changes is
added up first (one row per group) and then combined with the totals, never with the documents again.

State lives in a folder the cluster shares. A commit writes the next version of the totals, with the batch
ids that are in it, and becomes visible by the success mark that ends the write. A batch that is already in
the current version is left out, so replaying it, after a crash or by mistake, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.shared import Scratch, documents, prepare

GROUP = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, n_docs bigint, n_tokens bigint, n_chars bigint"
BATCHES = "batch_id string"


def counted(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, n_chars) of documents under one tokenizer."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", "lang", F.lit(version).alias("version"), tokens.cast("bigint").alias("n_tokens"),
        F.char_length(text).cast("bigint").alias("n_chars"),
    )


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as changes: 1 inserts, -1 deletes. A revision is the deletion of the old counts and the
    insertion of the new ones, which may be under another group."""
    return counts.select(
        *GROUP, F.lit(sign).cast("bigint").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"),
        (F.col("n_chars") * sign).alias("n_chars"),
    )


def deltas(changes: DataFrame) -> DataFrame:
    """One row per group with the sum of its changes; null keys are groups, null counts are zero."""
    return changes.groupBy(*GROUP).agg(
        *(F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in ("n_docs", "n_tokens", "n_chars"))
    )


class TokenRollup:
    """The totals below one folder: ``v-<n>/totals`` and ``v-<n>/batches``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last complete version; 0 before the first commit."""
        files, n = self._files(), 0
        root = self._path("")
        if not files.exists(root):
            return 0
        for entry in files.listStatus(root):
            name = entry.getPath().getName()
            if name.startswith("v-") and files.exists(self._path(f"{name}/batches/_SUCCESS")):
                n = max(n, int(name[2:]))
        return n

    def totals(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.folder}/v-{version}/totals")

    def batches(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], BATCHES)
        return self.spark.read.schema(BATCHES).parquet(f"{self.folder}/v-{version}/batches")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch to the totals; False if it is in them already.

        Totals are written first and the batch ids last: the mark of the latter makes both visible. What a
        failed attempt left behind is overwritten. One writer at a time is assumed.
        """
        current = self.version()
        done = self.batches(current)
        if not done.filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        parts = deltas(changes)
        if current:
            parts = parts.unionByName(self.totals(current))
        target = f"{self.folder}/v-{current + 1}"
        merged = deltas(parts).filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")
        merged.write.mode("overwrite").parquet(f"{target}/totals")
        own = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"))
        (own.unionByName(done) if current else own).coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
        return True


def word_tokens() -> Column:
    """Runs of characters other than ASCII blanks."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def piece_tokens() -> Column:
    """Runs of ASCII letters or digits, and every other character that is no ASCII blank alone."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"))


def op3_token_counts(spark, sf_dir):
    """All documents are inserted under the word tokenizer; a second batch revises every tenth document to
    the piece tokenizer and a third deletes every tenth, one of them delivered twice."""
    docs = documents(spark, sf_dir)
    rollup = TokenRollup(spark, Scratch(spark, "token-rollup").folder)
    by_words = counted(docs, "words-1", word_tokens())
    revised, deleted = F.col("doc_id") % 10 == 3, F.col("doc_id") % 10 == 7
    rollup.commit("insert", signed(by_words, 1))
    revision = signed(by_words.filter(revised), -1).unionByName(
        signed(counted(docs.filter(revised), "pieces-2", piece_tokens()), 1)
    )
    rollup.commit("revise", revision)
    rollup.commit("delete", signed(by_words.filter(deleted), -1))
    rollup.commit("revise", revision)
    return rollup.totals()


OP3_SQL = r"""
WITH counts AS (
    SELECT source, lang, CASE WHEN doc_id % 10 = 3 THEN 'pieces-2' ELSE 'words-1' END AS version,
           len(regexp_extract_all(coalesce(text, ''),
               CASE WHEN doc_id % 10 = 3 THEN '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]' ELSE '[^\x20\x09-\x0D]+' END)) AS tokens,
           length(coalesce(text, '')) AS chars
    FROM documents WHERE doc_id IS NULL OR doc_id % 10 <> 7)
SELECT source, lang, version, count(*) AS n_docs, cast(sum(tokens) AS bigint) AS n_tokens,
       cast(sum(chars) AS bigint) AS n_chars
FROM counts GROUP BY source, lang, version"""
