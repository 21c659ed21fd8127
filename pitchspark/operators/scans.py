"""Ordered scans that no single task does: row numbers of a whole table, and windows of keys with very many rows.

A table, or the rows of a hot key, is cut into slices that follow each other in the order, each of bounded size. Windows run
within slices; what a slice needs from those before it (the last row, a maximum, a sum) is carried over one row for each
slice. A slice that comes out too large is cut again; equal rows are told apart by a tie-breaker, so they split too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.staging import release, shared_side, staged

#: Rows of a slice, and rows of a key from which it is sliced instead of sorted in one task.
SLICE_ROWS, HOT_ROWS = 1_000_000, 1_000_000
#: Slices that one cut may make, as bits of a slice's number, and cuts of a slice that is too large.
BITS, CUTS = 20, 2


def slices(df: DataFrame, order: list[str], most: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` staged with ``_part``, ascending with the order, and ``_tie``, which orders equal rows; a part has about ``most``
    rows at most, so their number grows with the table. ``parts``: how many there are before large ones are cut again."""
    most = most or SLICE_ROWS
    spark, key = df.sparkSession, [*order, "_tie"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    out = staged(tied.repartitionByRange(n, *key).withColumn("_part", F.spark_partition_id().cast("long")), "slices")
    for _ in range(CUTS):
        sizes = staged(out.groupBy("_part").agg(F.count("*").alias("n")).where(F.col("n") > most), "slices-large")
        pieces = sizes.agg(F.sum(F.ceil(2 * F.col("n") / most))).first()[0]
        if not pieces:
            break
        large, _ = shared_side(sizes.select("_part"))
        again = out.join(large, "_part", "left_semi").repartitionByRange(int(min(pieces, 1 << BITS)), "_part", *key)
        again = again.withColumn("_part", F.shiftleft("_part", BITS) + F.spark_partition_id())
        rest = out.join(large, "_part", "left_anti").withColumn("_part", F.shiftleft("_part", BITS))
        cut = staged(rest.unionByName(again.select(*rest.columns)), "slices")
        release(out)
        out = cut
    return out


def ranked(df: DataFrame, order: list[str], name: str, most: int | None = None, parts: int | None = None) -> DataFrame:
    """Row numbers (from 1) of a total order over the whole table: slices, their sizes, offsets of their blocks and theirs."""
    if not df.columns or df.isEmpty():
        return df.withColumn(name, F.lit(None).cast("long"))
    spread = slices(df, order, most, parts)
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = staged(_running(sizes, "_part", "_n", "_before"), "ranked-offsets")
    side, _ = shared_side(before)
    local = spread.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie")))
    return local.join(side, "_part").withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)


def _running(sizes: DataFrame, part: str, n: str, name: str) -> DataFrame:
    """The sum of ``n`` over smaller parts, in two levels: one narrow row for each slice, so 2 ** BITS of them fit one task,
    and blocks keep it short beyond that."""
    rows = sizes.withColumn("_block", F.shiftright(part, BITS))
    blocks = rows.groupBy("_block").agg(F.sum(n).alias("_all"))
    prior = F.sum("_all").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", F.coalesce(prior, F.lit(0)).alias("_base"))
    own = F.sum(n).over(Window.partitionBy("_block").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(blocks, "_block").select(part, (F.col("_base") + F.coalesce(own, F.lit(0))).alias(name))


def split_hot(df: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with ``most`` rows at most, and those of the others (none if there is no such key)."""
    hot = staged(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (most or HOT_ROWS)).drop("_n"), "hot-keys")
    if hot.isEmpty():
        return df, None
    side = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    side, _ = shared_side(side)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"_hot_{k}"]) for k in keys])
    return df.join(side, same, "left_anti"), df.join(side, same, "left_semi")


class Carry:
    """What the rows before a row of its key say, over all slices: each is a column with a name.

    ``last``: the value in the row before. ``ever``: the greatest value in all rows before. ``fill``: the last known value up
    to and with this row. ``total``: the sum up to and with this row.
    """

    def __init__(self, last: dict[str, Column] | None = None, ever: dict[str, Column] | None = None, fill: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> None:
        self.last, self.ever, self.fill, self.total = last or {}, ever or {}, fill or {}, total or {}

    def windowed(self, df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        """By one window for each key."""
        w = Window.partitionBy(*keys).orderBy(*order)
        upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {n: F.lag(c).over(w) for n, c in self.last.items()}
            | {n: F.max(c).over(prior) for n, c in self.ever.items()}
            | {n: F.last(c, ignorenulls=True).over(upto) for n, c in self.fill.items()}
            | {n: F.sum(c).over(upto) for n, c in self.total.items()}
        )

    def sliced(self, df: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
        """By slices of about ``most`` rows; ``_part`` and ``_tie`` stay in the result."""
        rows = slices(df, [*keys, *order], most)
        local = self.windowed(rows.withColumn("_first", F.lit(1)), [*keys, "_part"], [*order, "_tie"])
        local = local.withColumn("_first", F.lag(F.lit(1)).over(Window.partitionBy(*keys, "_part").orderBy(*order, "_tie")).isNull())
        at = F.struct(*order, "_tie")
        ends = rows.groupBy(*keys, "_part").agg(
            F.lit(True).alias("_known"),
            *[F.max_by(F.struct(c.alias("v")), at).alias(f"_last_{n}") for n, c in self.last.items()],
            *[F.max(c).alias(f"_ever_{n}") for n, c in self.ever.items()],
            *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_fill_{n}") for n, c in self.fill.items()],
            *[F.sum(c).alias(f"_total_{n}") for n, c in self.total.items()],
        )
        over = Window.partitionBy(*keys).orderBy("_part")  # one row for each slice of the key
        prior = over.rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_part").alias("_slice"),
            *[F.lag(f"_last_{n}").over(over).alias(f"_last_{n}") for n in self.last],
            *[F.max(f"_ever_{n}").over(prior).alias(f"_ever_{n}") for n in self.ever],
            *[F.last(f"_fill_{n}", ignorenulls=True).over(prior).alias(f"_fill_{n}") for n in self.fill],
            *[F.sum(f"_total_{n}").over(prior).alias(f"_total_{n}") for n in self.total],
            F.lag("_known").over(over).alias("_known"),
        )
        side, _ = shared_side(carried.where("_known").drop("_known"))  # slices that continue a key
        same = reduce(lambda a, b: a & b, [local[k].eqNullSafe(side[f"_key_{k}"]) for k in keys], local["_part"] == side["_slice"])
        joined = local.join(side, same, "left")
        out = {n: F.when(F.col("_first"), F.col(f"_last_{n}.v")).otherwise(F.col(n)) for n in self.last}
        out |= {n: F.greatest(F.col(n), F.col(f"_ever_{n}")) for n in self.ever}
        out |= {n: F.coalesce(F.col(n), F.col(f"_fill_{n}")) for n in self.fill}
        none = F.col("_slice").isNull()
        out |= {n: F.when(none, F.col(n)).otherwise(F.coalesce(F.col(n) + F.col(f"_total_{n}"), F.col(n), F.col(f"_total_{n}"))) for n in self.total}
        names = [*self.last, *self.ever, *self.fill, *self.total]
        return joined.withColumns(out).select(*df.columns, *names, "_part", "_tie")

    def over(self, df: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
        """By a window for each key, and by slices for keys with more than ``most`` rows."""
        names = [*df.columns, *self.last, *self.ever, *self.fill, *self.total]
        rest, hot = split_hot(df, keys, most)
        out = self.windowed(rest, keys, order).select(*names)
        return out if hot is None else out.unionByName(self.sliced(hot, keys, order, most).select(*names))
