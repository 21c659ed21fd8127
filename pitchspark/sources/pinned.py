"""Pinned reads: a manifest of a table's files, so that several scans of a study see one state of it.

The manifest holds names, sizes and times, one row for each file. A pinned scan reads exactly these files: later ones don't
show, and a file that changed or went away is an error, before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.operators.ledger import fingerprint

MANIFEST = "path string, length long, at long"


class SourceChanged(RuntimeError):
    pass


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths)
    return found.select("path", "length", F.unix_micros("modificationTime").alias("at"))


def pin(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Write the manifest of a table's files as they are now, once: a manifest that is there stays and is given back."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        _files(spark, [path]).coalesce(1).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def changes(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that changed or are gone: path and what happened."""
    rows = manifest.collect()  # as many as files, which the driver lists for any scan
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for r in rows:
        where = hadoop(r["path"])
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            out.append((r["path"], "GONE"))
            continue
        status = system.getFileStatus(where)
        if (status.getLen(), status.getModificationTime() * 1000) != (r["length"], r["at"]):
            out.append((r["path"], "CHANGED"))
    return spark.createDataFrame(out, "path string, change string")


def read_pinned(spark: SparkSession, path: str, manifest: DataFrame, schema: str) -> DataFrame:
    """The table as the manifest has it; partition columns come from the folders below ``path``."""
    broken = changes(spark, manifest).limit(3).collect()
    if broken:
        raise SourceChanged("; ".join(f"{r['path']}: {r['change']}" for r in broken))
    files = [r["path"] for r in manifest.select("path").orderBy("path").collect()]
    return spark.read.schema(schema).option("basePath", path).parquet(*files) if files else spark.createDataFrame([], schema)


def identity(manifest: DataFrame) -> DataFrame:
    """One row that stands for the manifest: number of files and a checksum, for reports."""
    return fingerprint(manifest, ["path", "length", "at"])
