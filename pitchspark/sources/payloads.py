"""Raw payloads by content: what was observed when, replay as of an instant, and retention.

A payload is stored once under the hash of its canonical text (keys sorted, no spaces), whoever observed it; observations
are narrow rows (kind, identity, halftime, observed_at, payload_hash). An observation holds until the next one of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.operators.joins import latest_by
from pitchspark.operators.windows import change_only
from pitchspark.sources.documents import table_or_empty
from pitchspark.staging import staged

PAYLOADS = "payload_hash string, payload string, prefix string"
OBSERVATIONS = "kind string, identity string, halftime boolean, observed_at timestamp, payload_hash string, day string"
KEY = ["kind", "identity", "halftime"]


def canonical(payload: Column) -> Column:
    """JSON with sorted keys and no spaces; text that isn't JSON as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload)


def tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Payloads and observations, empty where nothing is stored."""
    return table_or_empty(spark, f"{root}/payloads", PAYLOADS), table_or_empty(spark, f"{root}/observations", OBSERVATIONS)


def store(spark: SparkSession, root: str, incoming: DataFrame) -> DataFrame:
    """Add ``incoming`` (kind, identity, halftime, observed_at, payload) and give the observations that were added.

    An observation whose payload is that of the one before it, on the same UTC day and key, is not stored again. Doing it
    again adds nothing. Payloads go first, so that no observation lacks its payload if the second write fails.
    """
    payloads, observations = tables(spark, root)
    rows = incoming.select("kind", "identity", F.coalesce("halftime", F.lit(False)).alias("halftime"), "observed_at", canonical(F.col("payload")).alias("payload"))
    rows = rows.withColumns({"payload_hash": F.sha2("payload", 256), "day": F.date_format("observed_at", "yyyy-MM-dd")})
    rows = staged(rows, "payloads-incoming")
    fresh = rows.groupBy("payload_hash").agg(F.first("payload").alias("payload")).join(payloads.select("payload_hash"), "payload_hash", "left_anti")
    fresh = staged(fresh.withColumn("prefix", F.substring("payload_hash", 1, 2)), "payloads-new")
    fresh.write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(f"{root}/payloads")

    days = rows.select("day").distinct()
    names = [*KEY, "observed_at", "payload_hash", "day"]
    there = observations.join(days, "day", "left_semi").select(*names)
    every = there.withColumn("_new", F.lit(0)).unionByName(rows.select(*names).distinct().join(there, names, "left_anti").withColumn("_new", F.lit(1)))
    changed = change_only(every, [*KEY, "day"], ["observed_at", "_new", "payload_hash"], ["payload_hash"])
    added = staged(changed.where("_new = 1").drop("_new"), "payloads-added")
    added.write.mode("append").partitionBy("day").parquet(f"{root}/observations")
    return added


def validity(observations: DataFrame) -> DataFrame:
    """Observations with ``until``: when the next one of their key was made, or null."""
    return observations.withColumn("until", F.lead("observed_at").over(Window.partitionBy(*KEY).orderBy("observed_at", "payload_hash")))


def replay(spark: SparkSession, root: str, at: Column | None = None) -> DataFrame:
    """What was known at an instant: each key's observation that held then, with its payload; without ``at``, all observations
    in the order to replay them (``observed_at``)."""
    payloads, observations = tables(spark, root)
    if at is not None:
        seen = observations.where(F.col("observed_at") <= at)
        observations = latest_by(seen.select(*KEY, "observed_at", "payload_hash"), KEY, ["observed_at"])
    return observations.select(*KEY, "observed_at", "payload_hash").join(payloads.select("payload_hash", "payload"), "payload_hash")


def expired(observations: DataFrame, now: Column, days: int, preserve: tuple[str, ...] = ("paper_entries",)) -> DataFrame:
    """The observations that retention deletes: older than ``days``, but for preserved kinds; fewer than no days delete none."""
    if days < 0:
        return observations.limit(0)
    kept = F.coalesce(F.col("kind").isin(*preserve), F.lit(False)) if preserve else F.lit(False)
    return observations.where((F.col("observed_at") < now - F.make_dt_interval(F.lit(days))) & ~kept)


def orphans(payloads: DataFrame, observations: DataFrame, gone: DataFrame) -> DataFrame:
    """Hashes of payloads that no observation needs once ``gone`` is deleted."""
    names = [*KEY, "observed_at", "payload_hash"]
    left = observations.select(*names).exceptAll(gone.select(*names)).select("payload_hash")
    return payloads.select("payload_hash", "prefix").join(left, "payload_hash", "left_anti")


def retain(spark: SparkSession, root: str, now: Column, days: int, preserve: tuple[str, ...] = ("paper_entries",)) -> tuple[int, int]:
    """Delete what :func:`expired` names, and payloads that nothing needs then: numbers of observations and payloads.

    Only days and hash prefixes that lose rows are written again. Observations go first: a payload too many does no harm.
    """
    payloads, observations = tables(spark, root)
    gone = staged(expired(observations, now, days, preserve), "payloads-expired")
    unused = staged(orphans(payloads, observations, gone), "payloads-orphans")
    counts = gone.count(), unused.count()
    names = [*KEY, "observed_at", "payload_hash", "day"]
    _rewrite(observations.select(*names), gone.select(*names), "day", names, f"{root}/observations")
    _rewrite(payloads, unused, "prefix", ["payload_hash"], f"{root}/payloads")
    return counts


def _rewrite(table: DataFrame, gone: DataFrame, partition: str, keys: list[str], path: str) -> None:
    """Take rows out of the partitions that have them. Partitions that lose all their rows are removed."""
    spark = table.sparkSession
    touched = gone.select(partition).distinct()
    left = staged(table.join(touched, partition, "left_semi").join(gone.select(*keys), keys, "left_anti").select(*table.columns), "payloads-left")
    emptied = touched.join(left.select(partition), partition, "left_anti").collect()  # days or prefixes
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(partition).parquet(path)
    for r in emptied:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={r[0]}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
