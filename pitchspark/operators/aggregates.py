"""Coverage, trade, calibration and interval aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.functions.numbers import ratio, wilson
from pitchspark.operators.selection import distinct_counts, exact_quantiles, with_keys

#: What draws are taken modulo, and how many a task holds at a time.
PRIME, DRAWS = 2147483647, 1_000_000


def count_if(condition: Column | str) -> Column:
    """Rows for which the condition holds; unknown doesn't count, and no rows give 0."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def coverage(df: DataFrame, sets: list[tuple[str, list[str]]], measures: list[Column]) -> DataFrame:
    """The same measures for several groupings at once (GROUPING SETS): scope, the key columns (ALL where rolled up), measures.

    Null keys become UNKNOWN before grouping, so a rolled-up key can't be taken for one.
    """
    keys = list(dict.fromkeys(k for _, own in sets for k in own))
    rows = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN")) for k in keys})
    masks = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own): name for name, own in sets}
    scope = None
    grouping = F.grouping_id()
    for mask, name in masks.items():
        scope = F.when(grouping == mask, name) if scope is None else scope.when(grouping == mask, name)
    grouped = rows.groupingSets([[F.col(k) for k in own] for _, own in sets], *[F.col(k) for k in keys])
    out = grouped.agg(scope.alias("scope"), *measures)
    return out.select("scope", *[F.coalesce(k, F.lit("ALL")).alias(k) for k in keys], *[c for c in out.columns if c not in ("scope", *keys)])


def percent_of_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each group and its share of all rows in per cent, four digits. The window is over groups, not rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def trade_summary(trades: DataFrame, keys: list[str], stake: str, pnl: str, outcome: str, day: str, resolved: Column) -> DataFrame:
    """Counts, sums, rates, interval, medians and statuses of trades; days are counted and the median selected apart.

    ``outcome`` is 0, 1 or 2 (two or more). Open trades count in ``trades`` only.
    """
    won, lost = resolved & (F.col(pnl) > 0), resolved & (F.col(pnl) < 0)
    sum_if = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        count_if(resolved).alias("settled"),
        count_if(won).alias("won"),
        count_if(lost).alias("lost"),
        *[count_if(resolved & (F.col(outcome) == k)).alias(f"outcome_{k}") for k in (0, 1, 2)],
        F.round(sum_if(resolved, F.col(stake)), 2).alias("stake"),
        F.round(sum_if(resolved, F.col(pnl)), 2).alias("pnl"),
        F.round(sum_if(won, F.col(pnl)), 2).alias("gains"),
        F.round(-sum_if(lost, F.col(pnl)), 2).alias("losses"),
    )
    out = with_keys(out, distinct_counts(trades, keys, {"days": [F.when(resolved, F.col(day))]}), keys).na.fill(0, ["days"])
    out = with_keys(out, exact_quantiles(trades, keys, {"median_pnl": (F.when(resolved, F.col(pnl)), 0.5)}), keys)
    low, high = wilson("won", "settled")
    return (
        out.withColumn("roi", ratio("pnl", "stake"))
        .withColumn("hit_rate", ratio("won", "settled"))
        .withColumn("hit_low", low)
        .withColumn("hit_high", high)
        .withColumn("profit_factor", ratio("gains", "losses"))
        .withColumn("sample_status", F.when(F.col("settled") < 30, "SMALL_SAMPLE").otherwise("OK"))
        .withColumn("temporal_status", F.when(F.col("days") < 14, "SHORT_PERIOD").otherwise("OK"))
    )


def calibration(df: DataFrame, predicted: str, actual: str, bins: int = 20) -> DataFrame:
    """For each of ``bins`` half-open ranges: rows, mean prediction and observed rate; empty ranges too."""
    table = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high"))
    p = F.col(predicted)
    counted = (
        df.where((p >= 0) & (p < 1))
        .groupBy(F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(actual).cast("double")).alias("observed"))
    )
    return F.broadcast(table).join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def legacy_bucket(x: Column, width: float = 0.05) -> Column:
    """Start of the bucket by truncation towards zero, null as 0; keeps the edges of binary division (0.15 / 0.05 is 2)."""
    return F.coalesce((x / width).cast("int"), F.lit(0)) * width


def drawn(r: Column, j: Column, n: Column, seed: int) -> Column:
    """A number from 0 to n - 1 for draw j of round r: three rounds of squaring modulo a prime, which SQL engines can say too."""
    x = F.pmod(F.lit(seed).cast("long") + r * 73856093 + j * 19349663, F.lit(PRIME).cast("long"))
    for _ in range(3):
        x = (x * x + 12345) % PRIME
    return x % n


def bootstrap_by_day(df: DataFrame, keys: list[str], day: str, stake: str, pnl: str, rounds: int = 500, seed: int = 6301) -> DataFrame:
    """95 % interval of pnl over stake by resampling whole days; null for fewer than two days.

    Days are summed first, so what is resampled is one short list of days per key, whatever the number of rows. Rounds are
    drawn in numpy by the seeded function of (round, draw) that :func:`drawn` is, ``DRAWS`` at a time; nothing passes through
    the driver.
    """
    daily = df.groupBy(*keys, day).agg(F.sum(stake).alias("_stake"), F.sum(pnl).alias("_pnl"))
    lists = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day), F.col("_stake").cast("double").alias("s"), F.col("_pnl").cast("double").alias("p")))).alias("_d"))
    lists = lists.withColumn("days", F.size("_d").cast("long"))

    @F.pandas_udf("array<double>")
    def limits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for stakes, profits in batches:
            yield pd.Series([_limits(s, p, rounds, seed) for s, p in zip(stakes, profits, strict=True)], dtype=object)

    known = lambda x: F.transform("_d", lambda d: F.coalesce(d[x], F.lit(float("nan"))))
    out = lists.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if keys else lists  # small lists, much work
    out = out.withColumn("_l", limits(known("s"), known("p")))
    return out.select(*keys, "days", F.col("_l")[0].alias("roi_low"), F.col("_l")[1].alias("roi_high"))


def _limits(stakes: np.ndarray, profits: np.ndarray, rounds: int, seed: int) -> list[float | None]:
    """The two limits of one key: linear quantiles of the rounds' ratios; a round with an unknown sum or no stake has none."""
    n = len(stakes)
    if n < 2:
        return [None, None]
    found, own = [], np.arange(n, dtype=np.int64) * 19349663
    step = max(1, DRAWS // n)
    for first in range(0, rounds, step):
        s, p = np.zeros(min(step, rounds - first)), np.zeros(min(step, rounds - first))
        for lo in range(0, n, DRAWS):
            x = (seed + np.arange(first, first + len(s), dtype=np.int64)[:, None] * 73856093 + own[None, lo : lo + DRAWS]) % PRIME
            for _ in range(3):
                x = (x * x + 12345) % PRIME
            x %= n
            s += stakes[x].sum(axis=1)
            p += profits[x].sum(axis=1)
        usable = (s != 0) & ~np.isnan(s) & ~np.isnan(p)
        found.append(p[usable] / s[usable])
    roi = np.sort(np.concatenate(found))
    return [float(np.quantile(roi, q)) for q in (0.025, 0.975)] if len(roi) else [None, None]


def classification_metrics(df: DataFrame, label: str, p: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows, log loss, Brier score over all classes, Brier score of class 1 and |mean p1 - rate of class 1|."""
    chosen = F.element_at(F.array(*p), F.col(label).cast("int") + 1)
    square = lambda k: F.pow(F.col(p[k]) - F.when(F.col(label) == k, 1.0).otherwise(0.0), 2)
    brier = square(0)
    for k in range(1, len(p)):
        brier = brier + square(k)
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.avg(-F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), chosen)))).alias("log_loss"),
        F.avg(brier).alias("brier"),
        F.avg(square(1)).alias("p1_brier"),
        F.abs(F.avg(p[1]) - F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0))).alias("p1_bias"),
    )


def json_key_coverage(df: DataFrame, json_col: str) -> DataFrame:
    """Of each key of a JSON map: rows with a non-empty value, share of all rows, label."""
    total = df.count()
    keys = df.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value")).where("value IS NOT NULL AND trim(value) <> ''")
    share = F.col("n") / F.lit(max(1, total))
    label = F.when(share >= 0.8, "HIGH").when(share >= 0.5, "MEDIUM").when(share > 0, "LOW")
    return keys.groupBy("key").agg(F.count("*").alias("n")).withColumn("share", share).withColumn("label", label)


def calendar_coverage(df: DataFrame, day: Column, measures: list[Column]) -> DataFrame:
    """Measures of every calendar day between the first and the last, empty days with nulls as 0."""
    counted = df.groupBy(day.alias("day")).agg(*measures)
    span = counted.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counted, "day", "left").na.fill(0)


def value_distribution(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("UNKNOWN")).alias("value")) for d in dims])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def breadth_guard(df: DataFrame, dims: list[str], least: int = 100, dominant: float = 0.8, signature: float = 0.2) -> DataFrame:
    """One row: whether a plan of at least ``least`` rows varies enough: no value above the dominant share, no combination
    above the signature share; smaller plans pass."""
    rows = df.count()
    shares = value_distribution(df, dims).agg((F.max("n") / F.lit(max(1, rows))).alias("dominant_share"))
    widest = df.groupBy(*dims).agg(F.count("*").alias("n")).agg((F.max("n") / F.lit(max(1, rows))).alias("signature_share"))
    fail = (F.col("dominant_share") > dominant) | (F.col("signature_share") > signature)
    return shares.crossJoin(widest).select(F.lit(rows).cast("long").alias("n"), "dominant_share", "signature_share", F.when(F.lit(rows >= least) & fail, "FAIL").otherwise("PASS").alias("status"))


def stage_status(strict: bool = False, most_p95: float = 3000.0) -> Column:
    """STABLE, DEGRADED or UNSTABLE of a measured stage: requests, successful, refused (429 and 403), unreadable, server_errors,
    timeouts, connection_errors, p95. ``strict`` allows half a per cent of failures and looks at no latency."""
    c = F.col
    n = F.greatest(F.lit(1), c("requests"))
    hard = (c("refused") > 0) | (c("unreadable") > 0)
    if strict:
        return F.when(hard | (c("successful") / n < 0.995), "UNSTABLE").when((c("server_errors") + c("timeouts") + c("connection_errors")) / n > 0.005, "DEGRADED").otherwise("STABLE")
    soft = ((c("requests") - c("successful")) / n > 0.1) | (c("p95") > most_p95)
    for name in ("server_errors", "timeouts", "connection_errors"):
        soft = soft | (c(name) / n > 0.05)
    return F.when(hard, "UNSTABLE").when(soft, "DEGRADED").otherwise("STABLE")


def worker_choice(stages: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """Fewest workers whose stable throughput is within ``share`` of the best stable one, per run."""
    stable = stages.where("status = 'STABLE'")
    best = stable.groupBy(*keys).agg(F.max("throughput").alias("_best"))
    return stable.join(best, keys).where(F.col("throughput") >= share * F.col("_best")).groupBy(*keys).agg(F.min("workers").alias("workers"))


def bottleneck(stages: DataFrame, keys: list[str]) -> DataFrame:
    """What limits a run, by the first rule that any of its stages meets: refusals, unreadable answers, transport failures, CPU,
    then the first stage whose starts or completions stay below nine tenths of the target, then flat worker scaling.

    ``stages``: place (order in the run), phase, target, slots, starts, effective (rates), controller, parse_median, parse_p95,
    cpu, throughput and the counts of :func:`stage_status`."""
    c = F.col
    slow_start = (c("target") > 0) & (c("starts") > 0) & (c("starts") < 0.9 * c("target"))
    parser = (c("parse_median") >= 50) | (c("parse_p95") >= 100)
    lag = (c("target") > 0) & (c("starts") >= 0.9 * c("target")) & (c("effective") < 0.9 * c("target"))
    own = F.when(slow_start, F.when(parser, "PARSER").when((c("slots") >= 0.9 * c("target")) | (c("controller") >= 0.95 * c("target")), "REQUEST_SCHEDULING").otherwise("RATE_CONTROLLER")).when(lag, "NETWORK")
    some = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    worker = F.when(c("phase") == "WORKER", c("throughput"))
    found = stages.withColumn("_own", own).groupBy(*keys).agg(
        some(c("refused") > 0).alias("_a"), some(c("unreadable") > 0).alias("_b"), some((c("timeouts") > 0) | (c("connection_errors") > 0)).alias("_c"), some(c("cpu") >= 85).alias("_d"),
        F.min_by("_own", F.when(c("_own").isNotNull(), c("place"))).alias("_e"), F.count(worker).alias("_n"), F.max(worker).alias("_hi"), F.min(worker).alias("_lo"),
    )
    flat = (c("_n") >= 2) & (c("_hi") > 0) & (c("_hi") - c("_lo") <= 0.05 * c("_hi"))
    verdict = F.when(c("_a"), "PROVIDER").when(c("_b"), "PARSER").when(c("_c"), "NETWORK").when(c("_d"), "CPU").when(c("_e").isNotNull(), c("_e")).when(flat, "NETWORK").otherwise("UNKNOWN")
    return found.select(*keys, verdict.alias("bottleneck"))
