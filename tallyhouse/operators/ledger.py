"""Stock kept as a snapshot and the signed movements that came after it.

The ledger lives in a folder that the cluster shares. A batch of movements is added up to one signed row per
product and stored under its batch id; it counts from the moment its success mark is there, and a batch that
counts already is left out. The position is the latest snapshot plus the batches after it, so neither the
movements nor the batches a snapshot holds are read again.

    snapshot-<n>/stock       product_id, reserved, sold
    snapshot-<n>/batches     batch_id of everything in it
    batch-<id in hex>/       product_id, reserved, sold
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUCCESS = "_SUCCESS"


def signed(movements: DataFrame) -> DataFrame:
    """What movements add to the reserved and sold quantity of each product; a release takes away."""

    def moved(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("movement") == kind, F.col("quantity"))), F.lit(0))

    return movements.groupBy("product_id").agg(
        (moved("RESERVE") - moved("CONFIRM_SALE") - moved("RELEASE")).alias("reserved"), moved("CONFIRM_SALE").alias("sold"),
    )


class StockLedger:
    """One writer at a time is assumed; readers see whole batches and whole snapshots only."""

    def __init__(self, spark: SparkSession, folder: str, product_type: str = "string") -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType.fromDDL(f"product_id {product_type}, reserved bigint, sold bigint")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, prefix: str, mark: str) -> list[str]:
        """What follows the prefix in the names of folders that have their success mark."""
        files, root = self._files(), self._path("")
        names = [entry.getPath().getName() for entry in files.listStatus(root)] if files.exists(root) else []
        return [n[len(prefix):] for n in names if n.startswith(prefix) and files.exists(self._path(f"{n}/{mark}"))]

    def _snapshot(self) -> int:
        return max(map(int, self._complete("snapshot-", f"batches/{SUCCESS}")), default=0)

    def _held(self, snapshot: int) -> DataFrame:
        if not snapshot:
            return self.spark.createDataFrame([], "batch_id string")
        return self.spark.read.schema("batch_id string").parquet(f"{self.folder}/snapshot-{snapshot}/batches")

    def _later(self, snapshot: int) -> list[str]:
        """Batches after the snapshot, in hex. There are as many as were committed since the last ``compact``."""
        stored = self._complete("batch-", SUCCESS)
        if not stored:
            return []
        known = self._held(snapshot).where(F.col("batch_id").isin([bytes.fromhex(name).decode() for name in stored]))
        held = {row["batch_id"].encode().hex() for row in known.collect()}
        return sorted(set(stored) - held)

    def commit(self, batch_id: str, movements: DataFrame) -> bool:
        """Add a batch; False if it is in the ledger already. A failed attempt is written over."""
        name = batch_id.encode().hex()
        snapshot = self._snapshot()
        if name in self._complete("batch-", SUCCESS) or not self._held(snapshot).where(F.col("batch_id") == batch_id).isEmpty():
            return False
        delta = signed(movements).where("reserved <> 0 OR sold <> 0")
        delta.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).write.mode("overwrite").parquet(
            f"{self.folder}/batch-{name}"
        )
        return True

    def stock(self) -> DataFrame:
        """(product_id, reserved, sold) after everything committed so far."""
        return self._stock(snapshot := self._snapshot(), self._later(snapshot))

    def _stock(self, snapshot: int, later: list[str]) -> DataFrame:
        folders = [f"{self.folder}/snapshot-{snapshot}/stock"] if snapshot else []
        folders += [f"{self.folder}/batch-{name}" for name in later]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = self.spark.read.schema(self.schema).parquet(*folders)
        return parts.groupBy("product_id").agg(F.sum("reserved").alias("reserved"), F.sum("sold").alias("sold"))

    def compact(self) -> int:
        """Take the batches after the snapshot into a new one; its number. Their folders are not needed then,
        and go; a reader of the old state has to be done."""
        snapshot = self._snapshot()
        later = self._later(snapshot)
        if not later:
            return snapshot
        target = f"{self.folder}/snapshot-{snapshot + 1}"
        self._stock(snapshot, later).where("reserved <> 0 OR sold <> 0").write.mode("overwrite").parquet(f"{target}/stock")
        new = self.spark.createDataFrame([(bytes.fromhex(name).decode(),) for name in later], "batch_id string")
        self._held(snapshot).unionByName(new).write.mode("overwrite").parquet(f"{target}/batches")
        for name in later:
            self._files().delete(self._path(f"batch-{name}"), True)
        return snapshot + 1


def position(stock: DataFrame, products: DataFrame) -> DataFrame:
    """Reserved, sold and available quantity of every product; products that never moved included."""
    moved = stock.select("product_id", F.col("reserved").alias("_reserved"), F.col("sold").alias("_sold"))
    on_hand = F.coalesce("available_quantity", F.lit(0))
    reserved, sold = F.coalesce("_reserved", F.lit(0)), F.coalesce("_sold", F.lit(0))
    return products.select(F.col("id").alias("product_id"), "available_quantity").join(moved, "product_id", "left").select(
        "product_id", on_hand.cast("bigint").alias("on_hand"), reserved.alias("reserved"), sold.alias("sold"),
        (on_hand - reserved - sold).alias("available"),
    )
