"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What a task sorts and hashes takes about twenty times the compressed bytes it reads, so a task reads few.
MOST_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}
STORED_BYTES_PER_PARTITION = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession, stored_bytes: int | None = None) -> SparkSession:
    """Pin what results depend on (UTC calendar), what hot keys depend on (skew splitting), and the bytes of a task.

    Hot join keys are left to adaptive execution: it cuts an oversized sort-merge partition into
    several tasks and repeats the small side. The force flag lets it do so even where the join
    feeds an aggregation on the same key.

    Smaller sizes that the session was given stay. ``stored_bytes`` is the size of the tables to be read:
    large ones are dealt into more partitions than the session's number, which adaptive execution
    merges again up to the size of a task.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # ranked groups are cut to their first rows ahead of the shuffle up to this rank
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        # Spark 4.1 may take a union for partitioned on a key after adaptive execution has changed its
        # inputs, and then fails on the partition count; the union is shuffled again instead
        "spark.sql.unionOutputPartitioning": "false",
    }.items():
        spark.conf.set(key, value)
    for key, most in MOST_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")
    if stored_bytes is not None:
        wanted = stored_bytes // STORED_BYTES_PER_PARTITION
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(INITIAL_PARTITIONS, str(wanted))
        else:
            spark.conf.unset(INITIAL_PARTITIONS)
    return spark


def _bytes(size: str) -> int:
    """The bytes that a Spark setting such as ``64MB`` or ``8m`` stands for."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1])


@contextmanager
def file_sizes(spark: SparkSession) -> Iterator[None]:
    """Inside, a task has the bytes that the session was started with, as what it writes becomes a file."""
    small = {key: spark.conf.get(key) for key in MOST_BYTES}
    try:
        for key in MOST_BYTES:
            started = spark.sparkContext.getConf().get(key)
            spark.conf.unset(key) if started is None else spark.conf.set(key, started)
        yield
    finally:
        for key, size in small.items():
            spark.conf.set(key, size)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    A machine-local folder is used only where Spark itself runs in one local process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="tallyhouse-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
