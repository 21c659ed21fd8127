"""Latest-state, interval, range, pairing and tiered joins, each one plan of equality joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.functions.numbers import two_way_probability
from pitchspark.operators.scans import Carry


#: Rows of a table of bins.
MOST_BINS = 10_000


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``. One partly aggregated shuffle, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_with_fallback(tiers: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of the first tier that has the key; ``tier`` tells which (0 is the best)."""
    every = None
    for k, tier in enumerate(tiers):
        rows = tier.withColumn("tier", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    every = every.withColumn("_best", -F.col("tier"))
    return latest_by(every, keys, ["_best", *order]).drop("_best")


def anti_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def semi_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, on: list[str]) -> DataFrame:
    """Pairs with equal ``on`` and times at most ``seconds`` apart.

    Times are cut in buckets of that width; a left row looks in its bucket and both neighbours, so every pair meets in
    exactly one equality join and nothing is compared across far buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: bucket(left_time) + d)))
    b = right.withColumn("_bucket", bucket(right_time))
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*on, "_bucket"]).where(gap <= seconds * 1_000_000).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], most: int | None = None) -> DataFrame:
    """Each left row with the latest right ``values`` at or before its time: one union, one window per key, no range join.
    A key with more than ``most`` rows of both sides is scanned in slices."""
    kinds = dict(right.dtypes)
    a = left.withColumn("_at", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(f"struct<{','.join(f'{v}:{kinds[v]}' for v in values)}>"))
    b = right.select(*on, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    every = Carry(fill={"_found": F.col("_value")}).over(a.unionByName(b, allowMissingColumns=True), on, ["_at", "_side"], most)
    return every.where("_side = 1").select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def range_join(rows: DataFrame, bins: DataFrame, value: Column, low: str = "low", high: str = "high") -> DataFrame:
    """Rows with each half-open bin that holds ``value`` (null ``high``: open). ``bins`` is a small table of settings, which is
    checked: it is broadcast, and every row is held against all of it."""
    if bins.limit(MOST_BINS + 1).count() > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins: join by a key instead")
    inside = (value >= F.col(low)) & (F.col(high).isNull() | (value < F.col(high)))
    return rows.join(F.broadcast(bins), inside)


def tiered_lookup(left: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """``value`` from the first tier whose keys match, and ``tier``; a key with several rows gives the smallest value."""
    out, names = left, []
    for k, (table, keys) in enumerate(tiers):
        found = table.groupBy(*keys).agg(F.min(value).alias(f"_value{k}"))
        out = out.join(found, keys, "left")
        names.append(f"_value{k}")
    tier = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)])
    return out.withColumn(value, F.coalesce(*names)).withColumn("tier", tier).drop(*names)


def two_sided_pairs(quotes: DataFrame, market: list[str], side: str, sides: tuple[str, str], value: str) -> DataFrame:
    """One row per market that has both sides: the quotes ``a`` and ``b`` and the probability of ``a`` without margin.
    A market's best quote of a side counts. A pivoting aggregate takes the place of the self-join."""
    best = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    pairs = quotes.where(F.col(side).isin(*sides)).groupBy(*market).agg(best(sides[0]).alias("a"), best(sides[1]).alias("b"))
    return pairs.dropna(subset=["a", "b"]).withColumn("p", two_way_probability("a", "b"))


def in_all(frames: list[DataFrame], key: str, values: list[str]) -> DataFrame:
    """Keys that every frame has, with the mean of ``values``; each frame has a key once."""
    every = None
    for f in frames:
        rows = f.select(key, *values)
        every = rows if every is None else every.unionByName(rows)
    found = every.groupBy(key).agg(F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values])
    return found.where(F.col("_n") == len(frames)).drop("_n")
