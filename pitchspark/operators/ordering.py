"""Top-k, ranks, pages and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.operators.scans import ranked


def best_per_group(df: DataFrame, keys: list[str], value: str, tie: list[str], alternatives: int = 2) -> DataFrame:
    """The best row of each group and how many others there are; rows of rank up to 1 + ``alternatives`` stay."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *[F.col(t).desc() for t in tie])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 1 + alternatives)


def top_ranked(df: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    """Rows with fewer than ``k`` strictly better ones in their group (ties share a rank)."""
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """A page of a total order; no limit means all."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(max(1, limit))


def scanner_value(c: str, legacy_zero: bool = True) -> Column:
    """The value to rank by: a missing one, and with ``legacy_zero`` an exact 0 too, is below all others."""
    return F.when(F.col(c).isNull() | (F.lit(legacy_zero) & (F.col(c) == 0)), -1e9).otherwise(F.col(c))


def scanner_order(rankable: str, buffer: str, roi: str, tie: str, legacy_zero: bool = True) -> list[Column]:
    """Rankable first, then buffer and return; with ``legacy_zero`` an exact 0 goes to the end like a missing one."""
    return [F.col(rankable).desc(), scanner_value(buffer, legacy_zero).desc(), scanner_value(roi, legacy_zero).desc(), F.col(tie)]


def quantile_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Rows at k evenly spaced positions of the order, first and last included; positions that coincide count once."""
    n = df.count()
    if n == 0 or k < 1:
        return df.limit(0)
    places = sorted({int((i / (k - 1) if k > 1 else 0.0) * (n - 1) + 0.5) + 1 for i in range(k)})
    return ranked(df, order, "_rank").where(F.col("_rank").isin(places)).drop("_rank")


def round_robin(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """k keys taken in rounds over the strata, the smallest keys of a stratum first; a key counts in its first stratum."""
    once = df.groupBy(key).agg(F.min(stratum).alias(stratum))
    w = Window.partitionBy(stratum).orderBy(key)
    return once.withColumn("round", F.row_number().over(w)).orderBy("round", stratum).limit(k)


def filtered_page(df: DataFrame, equal: dict[str, object], sortable: dict[str, list[Column]], sort: str, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of rows that meet all given equalities (None: not asked for), and one row with how many meet them.

    Only the named orders of ``sortable`` may be asked for; each must be total."""
    if sort not in sortable:
        raise ValueError(f"no order named {sort}")
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return page(df, sortable[sort], limit, offset), df.agg(F.count("*").alias("n"))
