"""Reading and writing contract tables."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import file_sizes

MONTH = "order_month"
KEYS_SENT = 1_000_000  # so many keys of changes are sent to every executor; more are joined by sorting
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder for rows without a value


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table under an explicit schema: no inference pass, and a wrong type fails early."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, options: dict[str, str], schema: T.StructType) -> DataFrame:
    """The same table from a relational database.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` among the
    options for a parallel read; without them Spark reads over a single connection.
    """
    table = spark.read.format("jdbc").options(**options).load()
    return table.select(*(F.col(field.name).cast(field.dataType) for field in schema.fields))


def write_table(df: DataFrame, path: str, month_of: str | None = None, sort_by: tuple[str, ...] = ()) -> None:
    """Write parquet; with ``month_of`` partitioned by the month of that timestamp.

    Rows of one month are spread over tasks by Spark's own rebalancing, which splits a month that
    holds most of the table; ``sort_by`` orders each file, so that row-group statistics can skip.
    """
    if month_of is None:
        out = df.sortWithinPartitions(*sort_by) if sort_by else df
        out.write.mode("overwrite").parquet(path)
        return
    keyed = df.withColumn(MONTH, F.date_format(month_of, "yyyy-MM"))
    balanced = keyed.hint("rebalance", MONTH)
    balanced = balanced.sortWithinPartitions(MONTH, *sort_by)
    with file_sizes(df.sparkSession):
        balanced.write.mode("overwrite").partitionBy(MONTH).parquet(path)


def merge_months(
    path: str, schema: T.StructType, month_of: str, changed: DataFrame | None = None, deleted: DataFrame | None = None,
    key: str = "id", delete_by: str = "id", sort_by: tuple[str, ...] = (), spark: SparkSession | None = None,
    keys_sent: int = KEYS_SENT,
) -> list[str | None]:
    """Bring changes into a table that ``write_table`` has written by month; the months they touch are returned.

    ``changed`` holds whole rows, new ones or in place of those with the same ``key``; ``deleted`` the values of
    ``delete_by`` whose rows go, changed ones too. Months with none of these rows keep their files: they are
    neither read beyond the key columns nor written. A month left empty loses its folder. The new files become
    visible when the write has ended; the same changes once more give the same table.

    Up to ``keys_sent`` keys are held once and sent to every executor. Rows that stay are then written from where
    their files are read, without a shuffle, so a month keeps about as many files as it had, and gets those of the
    changes. With more keys all rows of the months are joined by sorting and dealt anew.
    """
    spark = spark or (changed if changed is not None else deleted).sparkSession
    current = spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])).parquet(path)
    stale, new = [], None
    if changed is not None:
        new = changed.withColumn(MONTH, F.date_format(month_of, "yyyy-MM"))
        stale.append((changed.select(key).distinct().persist(), key))
    if deleted is not None:
        stale.append((deleted.select(delete_by).distinct().persist(), delete_by))
    held = [keys for keys, _ in stale]
    try:
        few = sum(keys.count() for keys in held) <= keys_sent
        if few:
            stale = [(F.broadcast(keys), by) for keys, by in stale]
        if new is not None and deleted is not None:
            new = new.join(stale[-1][0], delete_by, "left_anti").select(new.columns)
        return _merge(current, path, new, stale, few, sort_by)
    finally:
        for keys in held:
            keys.unpersist()


def _merge(
    current: DataFrame, path: str, new: DataFrame | None, stale: list[tuple[DataFrame, str]], few: bool, sort_by: tuple[str, ...]
) -> list[str | None]:
    spark = current.sparkSession
    touched = new.select(MONTH) if new is not None else current.select(MONTH).limit(0)
    rest = current
    for keys, by in stale:
        touched = touched.unionByName(current.join(keys, by, "left_semi").select(MONTH))
        rest = rest.join(keys, by, "left_anti").select(current.columns)
    months = [row[0] for row in touched.distinct().collect()]
    if not months:
        return []
    # literal months, so that the scan opens no other folder
    rest = rest.where(F.col(MONTH).isin([m for m in months if m is not None]) | (F.col(MONTH).isNull() & F.lit(None in months)))
    if new is not None:
        new = new.select(rest.columns)
    if few:
        merged = rest if new is None else rest.unionByName(new.hint("rebalance", MONTH))
    else:
        merged = (rest if new is None else rest.unionByName(new)).hint("rebalance", MONTH)
    folders = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH}={NO_MONTH if month is None else month}") for month in months]
    before = [_files(spark, folder) for folder in folders]
    with file_sizes(spark):
        (
            merged.sortWithinPartitions(MONTH, *sort_by)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
        )
    for folder, files in zip(folders, before):
        if files & _files(spark, folder):  # the write replaces the files of every month that has rows
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(months, key=str)


def _files(spark: SparkSession, folder: JavaObject) -> set[str]:
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {file.getPath().getName() for file in system.listStatus(folder)} if system.exists(folder) else set()


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Save a catalogue table bucketed on ``key``: tables bucketed alike join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
