"""What the text operators share: session settings, intermediate tables, rows told apart."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER = "_owner"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: skewed joins are split, Arrow batches stay small for long texts, and the shuffle
    files of a finished job go at once instead of waiting for the driver's garbage collection."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
    }.items():
        spark.conf.set(key, value)
    return spark


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker gives back the memory that it no longer uses. Spark keeps
    workers for later tasks, and without this each keeps the most that any task of it ever needed."""

    def and_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library than glibc
                pass

    return and_release


class Scratch:
    """Intermediate tables of one operator call, in the folder all machines share.

    A stored table outlives the executors that computed it and cuts the lineage. ``drop`` removes tables
    that nothing lazy reads any more; the table behind a returned DataFrame has to stay.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            root = tempfile.mkdtemp(prefix="tallyhouse-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all rows; a null text is the empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_ids(docs: DataFrame) -> bool:
    """Whether some rows share a doc_id."""
    return not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()


def one_per_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), one row per id and text. Rows without an id are left out."""
    rows = texts(docs).filter(F.col("doc_id").isNotNull())
    return rows.distinct() if repeated_ids(rows) else rows


def numbered(docs: DataFrame, nulls_first: bool = False) -> DataFrame | None:
    """The rows with a number of their own in place of the doc_id, which is OWNER then; None where the ids
    tell all rows apart. The numbers grow with the ids; rows without an id come last, or first."""
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return None
    by_id = F.asc_nulls_first(OWNER) if nulls_first else F.asc_nulls_last(OWNER)
    # the last column splits a row that the table holds very often
    order = [by_id, F.xxhash64("text"), F.xxhash64(*docs.columns), F.col("_at")]
    rows = docs.select(*docs.columns, F.col("doc_id").alias(OWNER), F.monotonically_increasing_id().alias("_at"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return Scratch(docs.sparkSession, "rows").store(
        placed.drop("_at").withColumn("doc_id", F.monotonically_increasing_id()), "rows"
    )


def by_row(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], *names: str, every_row: bool = False) -> DataFrame:
    """``judge`` over rows whose doc_id tells them apart; its columns ``names`` become ids again. Each id and
    text is one row, and rows without an id are left out, unless ``every_row`` counts as one of its own."""
    docs = texts(docs) if every_row else one_per_text(docs)
    rows = numbered(docs)
    if rows is None:
        return judge(docs)
    found = judge(rows)
    columns = found.columns
    for name in names:
        owners = rows.select(F.col("doc_id").alias(name), F.col(OWNER).alias("_id"))
        found = found.join(owners.hint("merge"), name).drop(name).withColumnRenamed("_id", name)
    return found.select(columns)
