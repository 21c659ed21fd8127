"""History, streak, drawdown and leak-free rolling operators over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.operators.scans import Carry, ranked, split_hot


def change_only(df: DataFrame, keys: list[str], order: list[str], values: list[str], most: int | None = None) -> DataFrame:
    """Rows whose values differ (null-safe) from those of the row before; the first row of a key always stays."""
    now = F.struct(*values)
    rows = Carry(last={"_before": now}).over(df, keys, order, most)
    return rows.where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def transitions(df: DataFrame, keys: list[str], order: list[str], eligible: str, source: str, most: int | None = None) -> DataFrame:
    """``transition``: FIRST_ELIGIBLE, ELIGIBLE, INELIGIBLE, BEST_ODDS_SOURCE_CHANGED or null, by the row before."""
    is_now = F.col(eligible)
    rows = Carry(last={"_was": is_now, "_had": F.col(source)}, ever={"_ever": is_now.cast("int")}).over(df, keys, order, most)
    was = F.col("_was")
    label = (
        F.when(is_now & (F.coalesce("_ever", F.lit(0)) == 0), "FIRST_ELIGIBLE")
        .when(is_now & ~was, "ELIGIBLE")
        .when(~is_now & was, "INELIGIBLE")
        .when(is_now & was & ~F.col(source).eqNullSafe(F.col("_had")), "BEST_ODDS_SOURCE_CHANGED")
    )
    return rows.withColumn("transition", label).drop("_was", "_had", "_ever")


def drawdown(df: DataFrame, keys: list[str], order: list[str], pnl: str, start: float = 0.0, most: int | None = None) -> DataFrame:
    """Per key: final balance, peak (never below ``start``), greatest fall below a peak, and that as a share of the peak."""
    rest, hot = split_hot(df, keys, most)
    rows = Carry(total={"_sum": F.col(pnl)}).windowed(rest, keys, order).withColumn("_balance", F.lit(start) + F.col("_sum"))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.greatest(F.lit(start), F.max("_balance").over(upto)))
    last = F.struct(*order)
    if hot is not None:  # balances over slices first, then peaks over the same slices of balances
        sums = Carry(total={"_sum": F.col(pnl)}).sliced(hot, keys, order, most).drop("_part", "_tie").withColumn("_balance", F.lit(start) + F.col("_sum"))
        peaks = Carry(ever={"_high": F.col("_balance")}).sliced(sums, keys, order, most).withColumn("_peak", F.greatest(F.lit(start), "_high", "_balance"))
        rows = rows.unionByName(peaks.select(*rows.columns))
    rows = rows.withColumn("_fall", F.col("_peak") - F.col("_balance"))
    return rows.groupBy(*keys).agg(
        F.max_by("_balance", last).alias("balance"),
        F.max("_peak").alias("peak"),
        F.max("_fall").alias("max_drawdown"),
        F.max(F.when(F.col("_peak") > 0, F.col("_fall") / F.col("_peak"))).alias("max_drawdown_share"),
    )


def longest_streaks(df: DataFrame, keys: list[str], order: list[str], flags: dict[str, Column], most: int | None = None) -> DataFrame:
    """Longest run of consecutive rows for which each flag holds.

    A row's run is named by how many rows before it, of its key, the flag didn't hold for; runs are counted by name, so a run
    over several slices is one.
    """
    on = {f"_on_{name}": F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}
    rows = df.select(*keys, *[c for c in order if c not in keys], *[c.alias(n) for n, c in on.items()])
    counted = Carry(total={f"_off_{name}": 1 - F.col(f"_on_{name}") for name in flags}).over(rows, keys, order, most)
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("flag"), F.col(f"_off_{name}").alias("run"), F.col(f"_on_{name}").alias("on")) for name in flags]))
    runs = counted.select(*keys, cells.alias("c")).groupBy(*keys, "c.flag", "c.run").agg(F.sum("c.on").alias("n"))
    return runs.groupBy(*keys).agg(*[F.max(F.when(F.col("flag") == name, F.col("n"))).alias(name) for name in flags])


def prior_mean(df: DataFrame, keys: list[str], time: str, value: str, n: int, tie: list[str], name: str) -> DataFrame:
    """Mean of ``value`` over the last ``n`` rows strictly earlier than each row; rows of the same time don't count, null
    values take a place but don't count in the mean.

    One sort per key: the first row of a time sees the ``n`` rows before it in a frame of rows, and its peers take its mean.
    """
    rows = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    by_row = Window.partitionBy(*keys).orderBy("_t", *tie)
    seen = F.avg(value).over(by_row.rowsBetween(-n, -1))
    peers = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumn("_mean", F.struct(seen.alias("m"))).withColumn("_k", F.row_number().over(by_row))
    return rows.withColumn(name, F.min_by("_mean", "_k").over(peers)["m"]).select(*df.columns, name)


def expanding_mean(df: DataFrame, keys: list[str], time: str, value: str, name: str, strict: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    """Mean of all earlier rows: strictly earlier times, or with ``strict`` false the rows before in (time, ``tie``) order."""
    w = Window.partitionBy(*keys)
    if strict:
        rows = df.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
        return rows.withColumn(name, F.avg(value).over(w.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1))).drop("_t")
    return df.withColumn(name, F.avg(value).over(w.orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, -1)))


def first_crossings(df: DataFrame, keys: list[str], order: str, value: str, thresholds: list[float], carry: list[str]) -> DataFrame:
    """For each key and threshold, the first row at or above it: threshold, the order column and ``carry``."""
    hits = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col(value) >= F.col("threshold"))
    return hits.groupBy(*keys, "threshold").agg(F.min(F.struct(order, *carry)).alias("_r")).select(*keys, "threshold", "_r.*")


def walk_forward(df: DataFrame, order: list[str], folds: int = 3, locked: float = 0.2) -> DataFrame:
    """``part`` of each row by time: LOCKED for the newest share, FOLD0 to FOLDn of equal size, oldest first.

    The ranking goes over counts of narrow time ranges, not over one task with all rows.
    """
    n = df.count()
    cut = n - (round(locked * n) if n >= 10 else 0)
    size = max(1, cut // (folds + 1))
    k = ranked(df, order, "_rank") if n else df.withColumn("_rank", F.lit(1).cast("long"))
    part = F.when(F.col("_rank") > cut, "LOCKED").otherwise(F.concat(F.lit("FOLD"), F.least(F.lit(folds), F.floor((F.col("_rank") - 1) / size)).cast("string")))
    return k.withColumn("part", part).drop("_rank")


def sliding_counts(df: DataFrame, now: Column, time: str, minutes: tuple[int, ...], kind: str) -> DataFrame:
    """Per kind: rows of the last 5, 15, 60 ... minutes up to ``now``, in one pass."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 60e6
    inside = lambda m: F.sum(F.when((age >= 0) & (age <= m), 1).otherwise(0)).cast("long").alias(f"last_{m}")
    return df.groupBy(kind).agg(*[inside(m) for m in minutes])


def rate_decisions(requests: DataFrame, keys: list[str], order: list[str], size: int = 20, start: float = 10.0, step: float = 2.0, least: float = 1.0, most: float = 60.0) -> DataFrame:
    """The rate after each full window of ``size`` requests of a key, with the window's state.

    A window with a refusal (429, 403) or an answer that can't be read is UNSTABLE, one with too many errors (over a tenth) or
    a nearest-rank p95 over two seconds DEGRADED, else STABLE. STABLE adds ``step``, DEGRADED takes a quarter, UNSTABLE half,
    within ``least`` and ``most``. Windows are counted apart; only their few states are folded in order.

    ``requests``: status (int), ok, parse_failure, elapsed_ms."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c = F.col
    rows = requests.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    hard = F.coalesce(c("status").isin(429, 403), F.lit(False)) | F.coalesce(c("parse_failure"), F.lit(False))
    seen = rows.groupBy(*keys, "window").agg(F.count("*").alias("n"), F.max(hard).alias("_hard"), F.avg((~c("ok")).cast("int")).alias("error_rate"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)").alias("p95"))
    state = F.when(c("_hard"), "UNSTABLE").when((c("error_rate") > 0.1) | (c("p95") > 2000), "DEGRADED").otherwise("STABLE")
    full = seen.where(c("n") == size).withColumn("state", state)
    cells = F.array_sort(F.collect_list(F.struct("window", "state", "error_rate", "p95")))

    def decide(rates: Column, x: Column) -> Column:
        last = F.element_at(rates, -1)
        new = F.when(x["state"] == "STABLE", F.least(F.lit(most), last + step)).when(x["state"] == "UNSTABLE", F.greatest(F.lit(least), last / 2)).otherwise(F.greatest(F.lit(least), last * 0.75))
        return F.concat(rates, F.array(new))

    folded = full.groupBy(*keys).agg(cells.alias("_w")).withColumn("_r", F.aggregate("_w", F.array(F.lit(float(start))), decide))
    return folded.select(*keys, F.posexplode("_w").alias("_i", "x"), "_r").select(*keys, "x.window", "x.state", "x.p95", F.element_at("_r", c("_i") + 2).alias("rate"))
