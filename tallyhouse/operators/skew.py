"""Finding the keys that hold too many rows to be gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# At most this many hot keys are brought to the driver; beyond, they stay a distributed table.
KEYS_ON_DRIVER = 100_000


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame | None:
    """(key, rows) of the keys with more than ``limit`` rows, or None where there are none.

    This runs a job over the key column alone, counted ahead of the shuffle. Its answer decides the
    plan: without hot keys the caller needs no second path at all. A hot key table that fits
    ``KEYS_ON_DRIVER`` comes back as local rows, whose size Spark knows when it picks the join; a
    larger one is left to be joined by shuffling.
    """
    hot = df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > limit)
    found = hot.limit(KEYS_ON_DRIVER + 1).collect()
    if not found:
        return None
    if len(found) > KEYS_ON_DRIVER:
        return hot
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("rows", T.LongType())])
    return df.sparkSession.createDataFrame(found, schema)
