"""Exact quantiles and distinct counts of many groups and measures at once, without a buffer of values in any task.

A quantile is found by selection: values become integers that sort as they do (:func:`ordered_bits`), rows are counted by the
leading 16 bits, each wanted rank picks its range, and only rows of picked ranges are counted again by the next 16 bits.
After four passes at most (fewer when a range holds one value only) every rank is a value. Counts are partly aggregated
before each shuffle, and a group's ranges are 65536 at most, so a group with a third of all rows is no task's burden.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from pitchspark.staging import release, shared_side, staged

#: Bits counted in one pass; groups of as many different values at most are ranked at once.
DIGIT, FEW = 16, 65536


def ordered_bits(x: Column) -> Column:
    """The bits of a double as a long that sorts as the double does; both zeros are one, NaN is above all.

    An Arrow UDF: built-in expressions can't read a double's bits, and finding them by arithmetic took most of a selection.
    """
    x = x.cast("double")
    return F.when(x.isNotNull(), _bits(x))


@F.pandas_udf(LongType())
def _bits(values: pd.Series) -> pd.Series:
    x = values.to_numpy(dtype=np.float64, na_value=np.nan)
    raw = np.abs(x).view(np.int64)
    return pd.Series(np.where(np.isnan(x), 2047 * 2**52 + 1, np.where(x < 0, -raw, raw)))


def counted_cells(flat: DataFrame, label: str) -> DataFrame:
    """Staged (g, value, n, bits) of rows (g, value), or of rows counted before (g, value, n): equal values of a group once with
    their number, partly aggregated before the shuffle, so that the passes over them read no value twice."""
    n = F.sum("n") if "n" in flat.columns else F.count("*")
    return staged(flat.groupBy("g", "value").agg(n.alias("n")).withColumn("bits", ordered_bits(F.col("value"))), label)


def order_statistics(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The value at each wanted rank (from 0) of its group: ``cells`` are those of :func:`counted_cells`, ``wanted`` (g, rank);
    gives g, rank, value.

    ``g`` may be any struct, with null fields as well. ``cells`` should be staged: they are read once for each pass.
    If no group has more values than a pass has ranges, one pass over the values themselves does.
    """
    most = cells.groupBy("g").count().agg(F.max("count")).first()[0]
    if (most or 0) <= FEW:
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        ranked = cells.withColumn("upto", upto).join(shared_side(wanted)[0], "g")
        return ranked.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("g", "rank", "value")
    found, rest = [], wanted.select("g", "rank", F.col("rank").alias("left"), F.lit(None).cast("long").alias("prefix"))
    shift = 64 - DIGIT
    while True:
        prefix = F.shiftright("bits", shift)
        rows = cells
        if shift < 64 - DIGIT:
            picked, _ = shared_side(rest.select("g", F.col("prefix").alias("parent")).distinct())
            rows = cells.withColumn("parent", F.shiftright("bits", shift + DIGIT)).join(picked, ["g", "parent"])
        else:
            rows = cells.withColumn("parent", F.lit(0).cast("long"))
            rest = rest.withColumn("prefix", F.lit(0).cast("long"))
        counted = rows.groupBy("g", "parent", prefix.alias("own")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("g", "parent").orderBy("own").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("upto", upto)  # over 65536 ranges at most
        aims, _ = shared_side(rest.withColumnRenamed("prefix", "parent"))
        inside = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        hit = staged(counted.join(aims, ["g", "parent"]).where(inside).select("g", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("own").alias("prefix"), "low", "high"), "selection-hit")
        done = (F.col("low") == F.col("high")) | F.lit(shift == 0)
        found.append(hit.where(done).select("g", "rank", F.col("low").alias("value")))
        rest = hit.where(~done).select("g", "rank", "left", "prefix")
        if shift == 0 or rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        shift -= DIGIT


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], how: str = "linear") -> DataFrame:
    """One row per key with each wanted quantile: name -> (value, q). Null values don't count; a measure without values gives
    null, and a key without any value has no row.

    ``how``: ``linear`` interpolates between the two nearest ranks of q * (n - 1); ``nearest`` takes sorted[ceil(q * n) - 1];
    ``truncated`` takes sorted[int(q * n) - 1], the first at least. Equal values are exact; so are the ranks.
    """
    measures: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (value, q) in wanted.items():  # one value may have several quantiles
        measures.setdefault(str(value), (value, {}))[1][name] = q
    values = F.array(*[F.struct(F.lit(k).alias("m"), value.cast("double").alias("value")) for k, (value, _) in enumerate(measures.values())])
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    flat = df.select(group.alias("key"), F.explode(values).alias("c")).where("c.value IS NOT NULL").select("key", "c.m", "c.value")
    return counted_quantiles(flat, keys, {name: (k, q) for k, (_, own) in enumerate(measures.values()) for name, q in own.items()}, how)


def counted_quantiles(flat: DataFrame, keys: list[str], wanted: dict[str, tuple[int, float]], how: str = "linear") -> DataFrame:
    """:func:`exact_quantiles` of rows (key: a struct of the keys, m: which measure, value), which may be counted (n) already:
    name -> (m, q)."""
    if how not in ("linear", "nearest", "truncated"):
        raise ValueError(f"no way of ranking named {how}")
    cells = counted_cells(flat.select(F.struct("key", "m").alias("g"), *[c for c in ("value", "n") if c in flat.columns]), "selection-cells")
    sizes = staged(cells.groupBy("g").agg(F.sum("n").alias("n")), "selection-sizes")

    n = F.col("n")
    aims = []
    for name, (k, q) in wanted.items():
        if how == "linear":
            at = (n - 1) * F.lit(float(q))
            places = (F.floor(at), F.ceil(at), at)
        else:
            place = F.greatest(F.lit(0), (F.ceil(n * F.lit(float(q))) if how == "nearest" else F.floor(n * F.lit(float(q)))) - 1)
            places = (place, place, place)
        aims.append(F.when(F.col("g.m") == k, F.struct(F.lit(name).alias("name"), *[p.cast(t).alias(a) for p, t, a in zip(places, ("long", "long", "double"), ("lo", "hi", "at"), strict=True)])))
    aimed = staged(sizes.select("g", F.explode(F.array_compact(F.array(*aims))).alias("a")).select("g", "a.*"), "selection-aims")
    ranks = aimed.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    found = staged(order_statistics(cells, ranks), "selection-found")
    low, high = (found.select("g", F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("lo", "below"), ("hi", "above")))
    both = aimed.join(low, ["g", "lo"]).join(high, ["g", "hi"])
    value = F.when((F.col("lo") == F.col("hi")) | (F.col("below") == F.col("above")), F.col("below")).otherwise((F.col("hi") - F.col("at")) * F.col("below") + (F.col("at") - F.col("lo")) * F.col("above"))
    out = both.groupBy("g.key").agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted])
    out = staged(out.select(*[F.col(f"key.{k}").alias(k) for k in keys], *wanted), "selection-quantiles")
    for table in (cells, sizes, aimed, found):
        release(table)
    return out


def quantile_grid(df: DataFrame, values: list[Column], steps: int, count: Column | None = None) -> DataFrame:
    """measure (place in ``values``), i, value: the linear quantile at i / steps of each measure, for i from 1 to steps - 1.
    A row stands for ``count`` rows, if that is given."""
    cells = F.array(*[F.struct(F.lit(k).alias("m"), v.cast("double").alias("value")) for k, v in enumerate(values)])
    own = [] if count is None else [count.alias("n")]
    flat = df.select(*own, F.explode(cells).alias("c")).where("c.value IS NOT NULL")
    table = counted_cells(flat.select(F.struct("c.m").alias("g"), "c.value", *[x for x in ("n",) if own]), "grid-cells")
    sizes = table.groupBy("g").agg(F.sum("n").alias("n"))
    at = (F.col("n") - 1) * (F.col("i") / F.lit(steps))
    aims = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select("g", "i", at.alias("at"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"))
    aims = staged(aims, "grid-aims")
    found = staged(order_statistics(table, aims.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct()), "grid-found")
    low, high = (found.select("g", F.col("rank").alias(r), F.col("value").alias(v)) for r, v in (("lo", "below"), ("hi", "above")))
    value = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise((F.col("hi") - F.col("at")) * F.col("below") + (F.col("at") - F.col("lo")) * F.col("above"))
    out = staged(aims.join(low, ["g", "lo"]).join(high, ["g", "hi"]).select(F.col("g.m").alias("measure"), "i", value.alias("value")), "quantile-grid")
    for side in (table, aims, found):
        release(side)
    return out


def distinct_counts(df: DataFrame, keys: list[str], wanted: dict[str, list[Column]]) -> DataFrame:
    """One row per key with how many different combinations of the wanted columns it has; a combination with a null doesn't
    count, and a key without any has no row. Two levels for all together: combinations of each key and name, then their number."""
    group = [F.col(k) for k in keys]
    dims = []
    for name, columns in wanted.items():
        known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
        texts = [c.cast("string") for c in columns]
        value = texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))
        dims.append(F.when(known, F.struct(F.lit(name).alias("name"), value.alias("value"))))
    flat = df.select(*group, F.explode(F.array_compact(F.array(*dims))).alias("d"))
    once = flat.groupBy(*keys, "d.name", "d.value").agg(F.lit(1).alias("one"))
    return once.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("name") == name, 1)), F.lit(0)).cast("long").alias(name) for name in wanted])


def with_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; ``right`` has one row per key."""
    if not keys:
        return left.crossJoin(right)  # one row each
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])
