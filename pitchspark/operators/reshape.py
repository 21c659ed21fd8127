"""Long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_pairs(df: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, metric, home, away) for each named pair of columns; metrics without either side are left out."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(h).cast("double").alias("home"), F.col(a).cast("double").alias("away")) for m, (h, a) in pairs.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("home IS NOT NULL OR away IS NOT NULL")


def explode_items(df: DataFrame, keys: list[str], items: str, id_field: str, own_id: str) -> DataFrame:
    """One row per array item with its position; items without an id get ``<own id>-<position>``."""
    rows = df.select(*keys, F.posexplode(items).alias("position", "_item"))
    return rows.select(*keys, "position", "_item.*").withColumn(
        id_field, F.coalesce(F.col(id_field).cast("string"), F.concat(F.col(own_id).cast("string"), F.lit("-"), F.col("position").cast("string")))
    )


def windowed_wide(df: DataFrame, keys: list[str], windows: dict[str, Column], sides: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """One row per key with a column for every (side, window, measure): sums in a single grouped pass, no pivot shuffle."""
    cells = [
        F.sum(F.when(w & s, m)).alias(f"{side}_{window}_{name}")
        for window, w in windows.items()
        for side, s in sides.items()
        for name, m in measures.items()
    ]
    return df.groupBy(*keys).agg(*cells)


def momentum(df: DataFrame, now: str, before: str, name: str) -> DataFrame:
    """Difference of two periods; null if either is missing."""
    return df.withColumn(name, F.col(now) - F.col(before))


def feature_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of the features that aren't null, per row."""
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in features), F.lit(0))
    return df.withColumn("feature_coverage", known / F.lit(len(features)))


def category_counts(df: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """Rows per category; a row may be in several."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in categories.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(names).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
