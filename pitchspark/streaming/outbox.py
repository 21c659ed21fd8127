"""An outbox published exactly once: files are staged, published by one rename, and entered in a ledger of (query, epoch).

``foreachBatch`` may hand the same epoch over again after a failure. A replay looks at what is there: an epoch in the ledger
is done; one that was renamed but isn't in the ledger is whole, since a rename is one step, and only gets its entry; staged
files without a rename count for nothing and are written again. Readers see epochs of the ledger alone, so a store whose
rename is not one step shows nothing half done either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "query string, epoch long, rows long"


class _Files:
    """The file system that holds ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, tail: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}" if tail else self.root)

    def exists(self, tail: str) -> bool:
        return self.fs.exists(self.path(tail))

    def remove(self, tail: str) -> None:
        self.fs.delete(self.path(tail), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} could not become {new}")


def publish(df: DataFrame, root: str, query: str, epoch: int, partition: list[str] | None = None, fail: Callable[[str], None] = lambda step: None) -> bool:
    """Publish an epoch unless it is already; whether this call did it. ``fail`` is called after each step (for tests)."""
    files = _Files(df.sparkSession, root)
    part, entry = f"query={query}/epoch={epoch}", f"ledger/query={query}/epoch={epoch}"
    if files.exists(entry):
        return False
    staging = f"staging/{part}"
    if not files.exists(f"data/{part}"):
        files.remove(staging)
        df.write.mode("overwrite").partitionBy(*(partition or [])).parquet(f"{files.root}/{staging}")
        fail("staged")
        files.rename(staging, f"data/{part}")
    fail("published")
    rows = df.sparkSession.read.parquet(f"{files.root}/data/{part}").count() if df.columns else 0
    made = f"staging/ledger/{part}"
    df.sparkSession.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").json(f"{files.root}/{made}")
    files.rename(made, entry)
    fail("entered")
    return True


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """query, epoch and rows of what was published."""
    if not _Files(spark, root).exists("ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{root.rstrip('/')}/ledger")


def published(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of published epochs, with query and epoch."""
    if not _Files(spark, root).exists("data"):
        return spark.createDataFrame([], f"{schema}, query string, epoch long")
    table = spark.read.schema(f"{schema}, query string, epoch long").parquet(f"{root.rstrip('/')}/data")
    return table.join(F.broadcast(ledger(spark, root).select("query", "epoch")), ["query", "epoch"], "left_semi")  # one row for each epoch


def outbox(stream: DataFrame, root: str, query: str, checkpoint: str, partition: list[str] | None = None, fail: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Publish a stream's rows epoch by epoch up to what is there now; run again, it goes on where it was."""

    def sink(batch: DataFrame, epoch: int) -> None:
        publish(batch, root, query, epoch, partition, fail)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
