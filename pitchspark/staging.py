"""Tables that are written once into the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

#: A side of a join is broadcast only if it was measured and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may go without: it gets a temporary folder. On a cluster a folder of one machine would lose rows,
    so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage is cut, and losing an executor loses nothing.

    The table goes away when the driver process ends, or with :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores: a file of one row group is read by one task, whatever comes after.

    Only for rows that much work is done on, since it may shuffle them; tables of many parts stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` in parts by ``key``, before its rows are multiplied or widened: joins and groups by that key, also under another
    name, then move nothing more. The number of parts is fixed, so that parts which are small here stay small when they grow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def release(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more; plans built on it must have run."""
    path = getattr(table, "_staged_path", None)
    if path:
        _remove(table.sparkSession, path)


def _bytes_of(value: Column, kind: types.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (types.StringType, types.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 24
    if isinstance(kind, types.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes_of(x, kind.elementType)), F.lit(0)) + 24
    if isinstance(kind, types.StructType):
        return sum((_bytes_of(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def shared_side(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df``, staged, with a broadcast hint if it is measured to have at most so many rows and bytes, else for a shuffled join."""
    if not hasattr(df, "_staged_path"):
        df = staged(df, "side")
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    fits = seen["n"] <= rows and seen["b"] <= most
    return (F.broadcast(df) if fits else df), fits


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before; the folder is the cluster's to clear then
        return
