"""Unions, differences and audits of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_with_fallback(current: DataFrame, legacy: DataFrame, on: list[str]) -> DataFrame:
    """All of ``current`` and those of ``legacy`` whose key it lacks."""
    return current.unionByName(legacy.join(current.select(*on).distinct(), on, "left_anti").select(*current.columns))


def distinct_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, null and empty left out."""
    return df.select(column).where(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")).distinct()


def key_membership(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Every key of either side once, as BOTH, LEFT_ONLY or RIGHT_ONLY, from one grouped pass."""
    a = left.select(*on, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = right.select(*on, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    both = a.unionByName(b).groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    label = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "BOTH").when(F.col("_a") == 1, "LEFT_ONLY").otherwise("RIGHT_ONLY")
    return both.select(*on, label.alias("membership"))


def disappeared(active: DataFrame, batch: DataFrame, on: list[str]) -> DataFrame:
    return active.join(batch.select(*on).distinct(), on, "left_anti")


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def raised_flags(before: DataFrame, after: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Keys in both inventories whose flag went up."""
    a, b = before.select(*on, F.col(flag).alias("_before")), after.select(*on, F.col(flag).alias("_after"))
    return a.join(b, on).where(F.col("_after") > F.col("_before")).select(*on)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    columns = sorted(left.columns)
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge_duplicates(df: DataFrame, on: list[str], order: list[str], policy: dict[str, str]) -> DataFrame:
    """One row per key with how many there were; each column by its policy: ``max``, ``min``, or ``last`` by ``order``."""
    rules = {"max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.struct(*order))}
    return df.groupBy(*on).agg(F.count("*").alias("n"), *[rules[p](c).alias(c) for c, p in policy.items()])


def verify_export(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """One row: rows of both sides, keys that the right side lacks or has too many, and keys whose values differ. Keys are
    unique; one full join of narrow columns."""
    a, b = left.select(*on, F.struct(*values).alias("_a")), right.select(*on, F.struct(*values).alias("_b"))
    both = a.join(b, on, "full")
    known, other = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    return both.agg(n(known, "n_left"), n(other, "n_right"), n(~other, "missing"), n(~known, "extra"), n(known & other & ~F.col("_a").eqNullSafe(F.col("_b")), "different"))
