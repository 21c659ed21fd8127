"""Tables that change: merges with a policy per column, audit trails, reservations and settlements.

Spark has no row locks, so one writer computes the new table from the old one and the changes; every function here is a
plan from (table, changes) to the rows to write.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.operators.joins import latest_by


def merge(table: DataFrame, changes: DataFrame, keys: list[str], order: str, policy: dict[str, str]) -> DataFrame:
    """Old rows and changes as one row per key. Policies: ``last`` (overwrite), ``last_known`` (overwrite unless null),
    ``first_known`` (keep what is there), ``min``, ``max``, ``or``. One grouped aggregate over both."""
    both = table.unionByName(changes)
    at = F.col(order)
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    rules = {
        "last": lambda c: F.max(F.struct(at, F.col(c).alias("v")))["v"],
        "last_known": lambda c: F.max_by(c, known(c)),
        "first_known": lambda c: F.min_by(c, known(c)),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "or": lambda c: F.max(F.col(c).cast("int")).cast("boolean"),
    }
    return both.groupBy(*keys).agg(F.max(order).alias(order), *[rules[p](c).alias(c) for c, p in policy.items()])


def revise(table: DataFrame, changes: DataFrame, keys: list[str], values: list[str], revision: str = "revision") -> tuple[DataFrame, DataFrame]:
    """The new table, where rows whose values differ (null-safe) get revision + 1, and the audit rows (keys, old, new)."""
    new = changes.select(*keys, F.struct(*values).alias("_new"))
    old = table.select(*keys, F.struct(*values).alias("_old"), revision)
    both = old.join(new, keys, "full")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    kept = F.coalesce(F.when(changed, F.col("_new")), F.col("_old"))
    number = F.coalesce(F.col(revision), F.lit(0)) + F.when(changed, 1).otherwise(0)
    table = both.select(*keys, *[kept[v].alias(v) for v in values], number.alias(revision))
    audit = both.where(changed).select(*keys, F.col("_old").alias("old"), F.col("_new").alias("new"), number.alias(revision))
    return table, audit


def replace_by_key(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: keys the table lacks, the first by ``order`` of each."""
    from pitchspark.operators.joins import first_by

    return first_by(new.join(table.select(*keys).distinct(), keys, "left_anti"), keys, order)


def balances(accounts: DataFrame, ledger: DataFrame, key: str, start: str, amount: str) -> DataFrame:
    moved = ledger.groupBy(key).agg(F.sum(amount).alias("_moved"))
    return accounts.join(moved, key, "left").select(key, (F.col(start) + F.coalesce("_moved", F.lit(0))).alias("balance"))


def reserve(entries: DataFrame, start: float, share: float, least: float | None = None, most: float | None = None, event: str | None = None) -> DataFrame:
    """Stakes of a fixed share of the running balance: (portfolio, at, entry_id, pnl_share) -> stake, balance after it, reason.

    A stake depends on all before it, so each portfolio is a fold in time order. Stakes are cents, half up, within ``least``
    and ``most``; one that is more than the balance isn't taken (INSUFFICIENT_BANKROLL), nor one of nothing (INVALID_STAKE).
    With ``event`` only the first entry of a portfolio for an event counts. The fold streams over sorted rows and keeps one
    number per portfolio.
    """
    from pitchspark.operators.joins import first_by

    if event:
        entries = first_by(entries, ["portfolio", event], ["at", "entry_id"])
    cent = Decimal("0.01")
    low, high = (None if x is None else Decimal(str(x)) for x in (least, most))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, balance = object(), Decimal(0)
        for rows in batches:
            stakes, after, reasons = [], [], []
            for portfolio, pnl in zip(rows["portfolio"], rows["pnl_share"]):
                if portfolio != current:
                    current, balance = portfolio, Decimal(str(start))
                stake = max(Decimal(0), balance) * Decimal(str(share))
                stake = stake if low is None else max(stake, low)
                stake = (stake if high is None else min(stake, high)).quantize(cent, ROUND_HALF_UP)
                reason = "INVALID_STAKE" if stake <= 0 else "INSUFFICIENT_BANKROLL" if stake > balance else "OK"
                stake = stake if reason == "OK" else Decimal(0)
                balance += (stake * Decimal(str(pnl))).quantize(cent, ROUND_HALF_UP)
                stakes.append(stake)
                after.append(balance)
                reasons.append(reason)
            yield pd.DataFrame({"portfolio": rows["portfolio"], "entry_id": rows["entry_id"], "stake": stakes, "balance": after, "reason": reasons})

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartition(parts, "portfolio").sortWithinPartitions("portfolio", "at", "entry_id")
    kind = dict(entries.dtypes)
    return ordered.select("portfolio", "entry_id", "pnl_share").mapInPandas(
        fold, f"portfolio {kind['portfolio']}, entry_id {kind['entry_id']}, stake decimal(18,2), balance decimal(18,2), reason string"
    )


def settle(trades: DataFrame, results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of open trades (trade_id, event_id, stake, payout, status) with a result (event_id, verdict WON, LOST, VOID
    or UNRESOLVED) that the ledger lacks: key ``settle:<trade>``. VOID returns the stake; UNRESOLVED writes nothing."""
    amount = F.when(F.col("verdict") == "WON", F.col("payout")).when(F.col("verdict") == "VOID", F.col("stake")).when(F.col("verdict") == "LOST", F.lit(0.0))
    rows = trades.where("status = 'OPEN'").join(results, "event_id").where("verdict <> 'UNRESOLVED'")
    rows = rows.select(F.concat(F.lit("settle:"), F.col("trade_id").cast("string")).alias("idempotency_key"), "trade_id", amount.alias("amount"))
    return rows.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")


def close_open_quotes(quotes: DataFrame, terminal: DataFrame, key: str) -> DataFrame:
    """Quotes of terminal keys become stopped, without odds."""
    ended = terminal.select(key).distinct().withColumn("_ended", F.lit(True))
    over = F.coalesce("_ended", F.lit(False)) & (F.col("status") == "open")
    return quotes.join(ended, key, "left").select(
        *[c for c in quotes.columns if c not in ("status", "odds")],
        F.when(over, "stopped").otherwise(F.col("status")).alias("status"),
        F.when(~over, F.col("odds")).alias("odds"),
    )


def latest_seen(tables: list[tuple[DataFrame, str]], key: str = "event_id") -> DataFrame:
    """Latest observation of each key over several tables (frame, time column): aggregated per table, then over the union."""
    every = None
    for df, at in tables:
        rows = df.groupBy(key).agg(F.max(at).alias("last_seen"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(F.max("last_seen").alias("last_seen"))


def freeze_cohorts(items: DataFrame, as_of: Column, kickoff: str, excluded: Column, hours: int = 24) -> DataFrame:
    """Cohort of every item at a cut-off time, and its fingerprint over all ids is in :func:`fingerprint`."""
    old = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(kickoff).cast("timestamp")) >= hours * 3_600_000_000
    return items.withColumn("cohort", F.when(excluded, "EXCLUDED").when(F.col(kickoff).isNull(), "AGE_UNKNOWN").when(old, "HISTORICAL").otherwise("NOT_DUE"))


def fingerprint(items: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """One row: rows and a checksum that doesn't depend on order. Row hashes are summed in buckets first, then hashed, so
    no task ever holds a list of all rows."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = items.select(row.alias("_h")).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") % buckets)
    part = F.sum(F.conv(F.substring("_h", 4, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("_b").agg(F.count("*").alias("_n"), part.alias("_s"))  # at most ``buckets`` rows
    tokens = F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("_b").cast("string"), 4, "0"), F.col("_s").cast("string"))))
    return sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sha2(F.array_join(tokens, "\n"), 256).alias("fingerprint"))


def fill_missing(canonical: DataFrame, evidence: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """Canonical rows with gaps filled from the latest evidence; what is known is never overwritten. ``conflict`` tells where
    both are known and differ, ``filled`` where something was taken."""
    latest = latest_by(evidence.select(key, order, *values), [key], [order]).select(key, *[F.col(v).alias(f"_{v}") for v in values])
    joined = canonical.join(latest, key, "left")
    conflict, filled = F.lit(False), F.lit(False)
    for v in values:
        conflict = conflict | F.coalesce(F.col(v) != F.col(f"_{v}"), F.lit(False))
        filled = filled | (F.col(v).isNull() & F.col(f"_{v}").isNotNull())
    rest = [c for c in canonical.columns if c not in values]
    return joined.select(*rest, *[F.coalesce(v, f"_{v}").alias(v) for v in values], conflict.alias("conflict"), filled.alias("filled"))
