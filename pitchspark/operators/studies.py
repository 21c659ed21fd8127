"""Backtest studies: observations, simulated trades, summaries, buckets, variants, audits.

A trade's path (balance, drawdown, streaks) is folded by chunks of time: each chunk gives a few numbers that combine, so no
task has to sort all trades of a group. Everything is expressions, joins with small literal tables and grouped aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.functions.numbers import haircut, ratio, two_way_probability, wilson
from pitchspark.operators.aggregates import count_if
from pitchspark.operators.markets import bound, covered_stakes
from pitchspark.operators.selection import counted_quantiles, with_keys
from pitchspark.staging import shared_side, spread, staged

COMBINATION, SINGLE_ZERO, SINGLE_TWO = "COMBINATION", "SINGLE_ZERO", "SINGLE_TWO_PLUS"
OUTCOMES = ("H2_GOALS_0", "H2_GOALS_1", "H2_GOALS_2_PLUS")
LEVELS = ("A_VERIFIED_REPLAY", "B_LEGACY_EXPLORATORY", "C_UNUSABLE_OR_PENDING")
#: Variants of the study as (id, form, field, lower, upper); a range holds its lower end only.
VARIANTS = (
    ("R00", COMBINATION, None, None, None), ("R01", SINGLE_ZERO, None, None, None), ("R02", SINGLE_TWO, None, None, None),
    ("P10", COMBINATION, "p1_market", 0.0, 0.2), ("P11", COMBINATION, "p1_market", 0.2, 0.25), ("P12", COMBINATION, "p1_market", 0.25, 0.3),
    ("P13", COMBINATION, "p1_market", 0.3, 0.35), ("P14", COMBINATION, "p1_market", 0.35, 0.4), ("P15", COMBINATION, "p1_market", 0.4, 1.01),
    ("B10", COMBINATION, "p1_break_even", 0.0, 0.2), ("B11", COMBINATION, "p1_break_even", 0.2, 0.3), ("B12", COMBINATION, "p1_break_even", 0.3, 1.0),
    ("G10", COMBINATION, "p1_buffer", None, -0.1), ("G11", COMBINATION, "p1_buffer", -0.1, -0.05), ("G12", COMBINATION, "p1_buffer", -0.05, 1.0),
    ("H10", COMBINATION, "ht_goals", 0.0, 1.0), ("H11", COMBINATION, "ht_goals", 1.0, 2.0), ("H12", COMBINATION, "ht_goals", 2.0, 100.0),
)
#: Buckets of patterns as (dimension, label, field, lower, upper).
BUCKETS = (
    ("P1", "0-20%", "p1_market", 0.0, 0.2), ("P1", "20-25%", "p1_market", 0.2, 0.25), ("P1", "25-30%", "p1_market", 0.25, 0.3), ("P1", "30-35%", "p1_market", 0.3, 0.35),
    ("P1", "35-40%", "p1_market", 0.35, 0.4), ("P1", "40-100%", "p1_market", 0.4, 1.01),
    ("Q0", "1.01-2.00", "q_zero", 1.01, 2.0), ("Q0", "2.00-3.00", "q_zero", 2.0, 3.0), ("Q0", "3.00-4.00", "q_zero", 3.0, 4.0), ("Q0", "4.00-5.00", "q_zero", 4.0, 5.0), ("Q0", "5.00+", "q_zero", 5.0, None),
    ("Q2_PLUS", "1.01-1.50", "q_two", 1.01, 1.5), ("Q2_PLUS", "1.50-2.00", "q_two", 1.5, 2.0), ("Q2_PLUS", "2.00-2.50", "q_two", 2.0, 2.5), ("Q2_PLUS", "2.50-3.00", "q_two", 2.5, 3.0), ("Q2_PLUS", "3.00+", "q_two", 3.0, None),
    ("HT_TOTAL", "0", "ht_goals", 0.0, 1.0), ("HT_TOTAL", "1", "ht_goals", 1.0, 2.0), ("HT_TOTAL", "2+", "ht_goals", 2.0, None),
)
LEAST_GAMES, LEAST_DAYS, CANDIDATE_GAMES = 30, 14, 100
PAIR_TOLERANCE = 1e-6

ITEMS = "array<struct<canonical_type: string, line: double, market_id: string, outcome_id: string, odds: double, period: string, scope: string, raw_market_type: string, raw_market_caption: string>>"


# --- observations ------------------------------------------------------------------------------------------------


def archived_pair(items: Column, line: float) -> Column:
    """Struct of the under and over quote of one market at ``line`` out of an archived list of outcomes; of a market's
    doubled entries the one with more facts counts, of several markets the highest sum of quotes, then the highest id."""
    usable = F.filter(
        items,
        lambda x: (F.abs(x["line"] - line) <= PAIR_TOLERANCE) & (x["odds"] > 1) & (F.coalesce(x["market_id"], F.lit("")) != "") & (F.coalesce(x["outcome_id"], F.lit("")) != ""),
    )
    has = lambda v: (F.coalesce(v, F.lit("")) != "").cast("int")
    richness = lambda x: F.struct(has(x["period"]).alias("a"), has(x["scope"]).alias("b"), has(x["raw_market_type"]).alias("c"), has(x["raw_market_caption"]).alias("d"))
    one_side = lambda v, side: F.filter(v, lambda x: x["canonical_type"] == f"REMAINING_TOTAL_{side}")
    best = lambda v, market: F.array_max(F.transform(F.filter(v, lambda x: x["market_id"] == market), lambda x, i: F.struct(richness(x).alias("r"), (-i).alias("i"), x.alias("x"))))["x"]
    ids = lambda v: F.transform(v, lambda x: x["market_id"])

    def chosen(v: Column) -> Column:
        both = F.transform(F.array_intersect(ids(v["under"]), ids(v["over"])), lambda m: F.struct(m.alias("market_id"), best(v["under"], m).alias("under"), best(v["over"], m).alias("over")))
        return F.array_max(F.transform(both, lambda x: F.struct((x["under"]["odds"] + x["over"]["odds"]).alias("sum"), x["market_id"].alias("market_id"), x["under"].alias("under"), x["over"].alias("over"))))

    return bound(usable, lambda v: F.struct(one_side(v, "UNDER").alias("under"), one_side(v, "OVER").alias("over")), chosen)


def observations(snapshots: DataFrame, results: DataFrame, events: DataFrame, markets_json: str = "relevant_markets_json") -> DataFrame:
    """Snapshots with their results and events, and what follows from them: quotes, probabilities and their recomputation,
    break-even, half-time and scope checks, goals after half time, eligibility, evidence level and the reasons against it.

    ``snapshots``: event_id, q_zero_best, q_two_best, p1_market, score_home, score_away, ht_home, ht_away, match_status,
    display_time, extra_time, penalties and the JSON of archived outcomes. ``results``: event_id (once), final_status,
    ft_home, ft_away, r_ht_home, r_ht_away, r_extra_time, r_penalties, use_ft, use_h2, quality. ``events``: event_id (once),
    competition_country, competition_name. Flags are texts; only an explicit zero excludes.
    """
    c = F.col
    zero = lambda x: F.coalesce(F.lower(F.trim(c(x).cast("string"))).isin("0", "false", "no", "off"), F.lit(False))
    pairs = bound(F.coalesce(F.from_json(markets_json, ITEMS), F.array().cast(ITEMS)), lambda items: F.struct(archived_pair(items, 0.5).alias("pair_05"), archived_pair(items, 1.5).alias("pair_15")))
    rows = snapshots.withColumn("_pairs", pairs)  # before the joins, which then move two pairs instead of the archive
    rows = rows.join(results.withColumn("_result", F.lit(True)), "event_id", "left").join(events, "event_id", "left")
    rows = rows.withColumns({"pair_05": c("_pairs.pair_05"), "pair_15": c("_pairs.pair_15")})
    p = lambda pair: two_way_probability(c(f"{pair}.under.odds"), c(f"{pair}.over.odds"))
    rows = rows.withColumns({"p0_recomputed": p("pair_05"), "p01_recomputed": p("pair_15")}).withColumn("p1_recomputed", c("p01_recomputed") - c("p0_recomputed"))
    t = PAIR_TOLERANCE
    inside = lambda x: c(x).between(-t, 1 + t)
    sound = F.coalesce(inside("p0_recomputed") & inside("p01_recomputed") & inside("p1_recomputed") & (c("p0_recomputed") <= c("p01_recomputed") + t), F.lit(False))
    fact = lambda pair, f: F.upper(F.trim(F.coalesce(f"{pair}.under.{f}", f"{pair}.over.{f}", F.lit(""))))
    other = lambda pair, f: F.upper(F.trim(F.coalesce(f"{pair}.over.{f}", f"{pair}.under.{f}", F.lit(""))))
    explicit = F.lit(True)
    for pair in ("pair_05", "pair_15"):
        explicit = explicit & c(pair).isNotNull()
        for f in ("period", "scope"):
            explicit = explicit & (fact(pair, f) != "") & (fact(pair, f) == other(pair, f))
    rows = rows.withColumns({"q_zero": F.coalesce("q_zero_best", "pair_05.under.odds"), "q_two": F.coalesce("q_two_best", "pair_15.over.odds"), "p1_recompute_valid": sound})
    quotes = F.coalesce((c("q_zero") > 1) & (c("q_two") > 1), F.lit(False))
    back = 1 / c("q_zero") + 1 / c("q_two")
    rows = rows.withColumns({"p1_break_even": F.when(quotes, 1 - back), "win_roi": F.when(quotes, 1 / back - 1)})
    same = lambda a, b: F.coalesce(c(a) == c(b), F.lit(False))
    score_equal = same("score_home", "ht_home") & same("score_away", "ht_away")
    phase = F.coalesce(F.lower("match_status") == "break", F.lit(False)) & F.coalesce(F.upper(F.trim("display_time")) == "HZ", F.lit(False)) & score_equal
    terminal = F.coalesce(F.upper("final_status").isin("FINISHED", "FINAL", "ENDED"), F.lit(False)) & c("ft_home").isNotNull() & c("ft_away").isNotNull()
    goals = F.when(terminal, c("ft_home") + c("ft_away") - c("ht_home") - c("ht_away"))
    scope_explicit = zero("extra_time") & zero("penalties")
    conflict = lambda x: c(x).isNotNull() & ~zero(x)
    scope_conflict = conflict("extra_time") | conflict("penalties")
    bad_quality = F.coalesce(F.upper("quality").isin("CONFLICT", "PENDING", "UNAVAILABLE"), F.lit(False))
    legacy = terminal & same("ht_home", "r_ht_home") & same("ht_away", "r_ht_away") & F.coalesce(goals >= 0, F.lit(False)) & ~scope_conflict & ~conflict("r_extra_time") & ~conflict("r_penalties")
    valid = F.when(c("_result").isNull(), False).when(c("use_h2").isNull(), legacy).otherwise(legacy & (c("use_h2") != 0) & ~bad_quality)
    ft_valid = terminal & F.coalesce((c("ft_home") >= 0) & (c("ft_away") >= 0), F.lit(False)) & (F.coalesce("use_ft", F.lit(1)) != 0) & ~bad_quality
    p1_valid = F.coalesce(c("p1_market").between(0, 1), F.lit(False))
    p1_conflict = F.coalesce(F.abs(c("p1_market") - c("p1_recomputed")) > t, F.lit(False))
    inconsistent = c("pair_05").isNotNull() & c("pair_15").isNotNull() & ~c("p1_recompute_valid")
    eligible = phase & quotes & p1_valid & ~p1_conflict & ~inconsistent & ~scope_conflict & F.coalesce(c("p1_break_even") > 0, F.lit(False))
    semantics = explicit & quotes & c("p1_recompute_valid")
    rows = rows.withColumns(
        {
            "phase_confirmed": phase, "scope_explicit": scope_explicit, "result_valid": F.coalesce(valid, F.lit(False)), "ft_result_valid": ft_valid, "entry_eligible": eligible,
            "market_semantics_verified": semantics, "p1_buffer": c("p1_break_even") - c("p1_market"), "ht_goals": c("ht_home") + c("ht_away"), "h2_goals": goals,
            "outcome_class": F.when(goals == 0, OUTCOMES[0]).when(goals == 1, OUTCOMES[1]).when(goals >= 2, OUTCOMES[2]),
        }
    )
    level = F.when(c("entry_eligible") & c("result_valid"), F.when(scope_explicit & c("market_semantics_verified"), LEVELS[0]).otherwise(LEVELS[1]))
    level = level.when(c("entry_eligible") | (p1_valid & c("result_valid")), LEVELS[1]).otherwise(LEVELS[2])
    reasons = [
        (c("_result").isNull(), "RESULT_MISSING"), (c("_result").isNotNull() & ~c("result_valid"), "RESULT_UNRESOLVED_OR_CONFLICT"), (~phase, "PHASE_UNCONFIRMED"), (~score_equal, "HT_SCORE_MISSING_OR_CONFLICT"),
        (~quotes, "MISSING_OR_INVALID_PURCHASE_QUOTES"), (~p1_valid, "P1_MISSING_OR_INVALID"), (p1_conflict, "P1_RECOMPUTATION_CONFLICT"), (scope_conflict, "SETTLEMENT_SCOPE_CONFLICT"),
        (~scope_conflict & ~scope_explicit, "SETTLEMENT_SCOPE_UNKNOWN"), (inconsistent, "P1_PAIR_INCONSISTENT"), (p1_valid & ~p1_conflict & ~semantics, "P1_REFERENCE_PAIR_UNVERIFIED"),
    ]
    flags = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in reasons]), lambda x: x.isNotNull())
    return rows.withColumns({"evidence_level": level, "quality_flags": flags, "primary_reject_reason": F.try_element_at(flags, F.lit(1))}).drop("_pairs", "_result")


def selected_days(rows: DataFrame, day: str, observed: str, first: str | None = None, last: str | None = None, cutoff: str | None = None) -> DataFrame:
    """Days from ``first`` to ``last``, both included, and observations up to ``cutoff``; an unknown time only goes with a cutoff."""
    if first:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col(day) <= F.lit(last).cast("date"))
    return rows.where(F.col(observed) <= F.lit(cutoff).cast("timestamp")) if cutoff else rows


# --- trades ------------------------------------------------------------------------------------------------------


def with_split(rows: DataFrame, stake: float = 10.0, cut: float = 0.0) -> DataFrame:
    """Observations with the split of their stake (``_s``): what a trade of several forms or variants needs only once."""
    split = covered_stakes(haircut("q_zero", cut), haircut("q_two", cut), stake, F.col("p1_market"))
    return rows.withColumn("_c", split).withColumn("_s", F.struct(*[F.col(f"_c.{x}").alias(x) for x in ("stake_zero", "stake_two", "payout_zero", "payout_two", "win_roi")])).drop("_c")


def simulate(rows: DataFrame, form: Column, stake: float = 10.0, cost: float = 0.0, cut: float = 0.0) -> DataFrame:
    """Each observation (q_zero, q_two, p1_market, outcome_class) as a trade of ``form``: stakes, payout, pnl, roi, hit.

    Quotes lose ``cut`` of their gain, ``cost`` counts once, cents round half up. Rows may have their split already, by
    :func:`with_split` with the same stake and cut."""
    c = F.col
    q0, q2 = haircut("q_zero", cut), haircut("q_two", cut)
    rows = (rows if "_s" in rows.columns else with_split(rows, stake, cut)).withColumn("form", form)
    paid = lambda q: F.round((F.lit(stake).cast("decimal(12,2)") * F.coalesce(q, F.lit(0.0)).cast("decimal(10,4)")), 2).cast("double")
    none, won = F.lit(0.0), c("outcome_class")
    both = F.when(won == OUTCOMES[0], c("_s.payout_zero")).when(won == OUTCOMES[2], c("_s.payout_two")).cast("double")
    payout = F.when(c("form") == SINGLE_ZERO, F.when(won == OUTCOMES[0], paid(q0))).when(c("form") == SINGLE_TWO, F.when(won == OUTCOMES[2], paid(q2))).otherwise(both)
    hit = F.when(c("form") == SINGLE_ZERO, won == OUTCOMES[0]).when(c("form") == SINGLE_TWO, won == OUTCOMES[2]).otherwise(won.isin(OUTCOMES[0], OUTCOMES[2]))
    rows = rows.withColumn("payout", F.coalesce(payout, none))
    return rows.withColumns(
        {
            "stake": F.lit(stake), "stake_zero": F.when(c("form") == SINGLE_ZERO, stake).when(c("form") == SINGLE_TWO, none).otherwise(F.coalesce(c("_s.stake_zero").cast("double"), none)),
            "stake_two": F.when(c("form") == SINGLE_TWO, stake).when(c("form") == SINGLE_ZERO, none).otherwise(F.coalesce(c("_s.stake_two").cast("double"), none)),
            "win_roi": F.when(c("form") == SINGLE_ZERO, q0 - 1).when(c("form") == SINGLE_TWO, q2 - 1).otherwise(c("_s.win_roi")),
            "pnl": F.round(c("payout") - stake - cost, 2), "covered_hit": F.coalesce(hit, F.lit(False)),
        }
    ).withColumn("roi", F.when(c("stake") > 0, c("pnl") / c("stake"))).drop("_s")


def path_stats(trades: DataFrame, keys: list[str], chunk: str, order: list[str], pnl: str) -> DataFrame:
    """Per key: balance, peak (0 at least), greatest fall below a peak and longest run of losses, in (chunk, order).

    Each chunk of time gives its sum, its highest and lowest running sum, its own greatest fall, and its runs of losses at
    the start, at the end and inside; a key's chunks, as many as there are days and not as there are trades, are folded in
    order. So only one chunk of one key has to be sorted in one task."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lost = (F.col(pnl) < 0).cast("int")
    rows = trades.select(*keys, chunk, *[c for c in order if c not in keys and c != chunk], F.col(pnl).alias("_p"), lost.alias("_l"))
    rows = rows.withColumns({"_sum": F.sum("_p").over(upto), "_k": F.row_number().over(w), "_wins": F.sum(1 - F.col("_l")).over(upto)})
    rows = rows.withColumn("_top", F.greatest(F.lit(0.0), F.max("_sum").over(upto)))
    runs = rows.groupBy(*keys, chunk, "_wins").agg(
        F.sum("_l").alias("_run"), F.sum("_p").alias("_total"), F.max("_sum").alias("_high"), F.min("_sum").alias("_low"), F.max(F.col("_top") - F.col("_sum")).alias("_fall"), F.count("*").alias("_n")
    )
    chunks = runs.groupBy(*keys, chunk).agg(
        F.sum("_total").alias("total"), F.max("_high").alias("high"), F.min("_low").alias("low"), F.max("_fall").alias("fall"), F.sum("_n").alias("n"), F.sum("_run").alias("losses"),
        F.coalesce(F.max(F.when(F.col("_wins") == 0, F.col("_run"))), F.lit(0)).alias("first"), F.max_by("_run", "_wins").alias("last"), F.max("_run").alias("most"),
    )
    return _folded(chunks.withColumns({"_day": F.col(chunk), "_seq": F.lit(0)}), keys)


def _folded(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """A key's chunks, folded in their order."""
    cells = F.struct("_day", "_seq", *["total", "high", "low", "fall", "n", "losses", "first", "last", "most"])
    start = F.struct(F.lit(0.0).alias("balance"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("longest"))

    def step(s: Column, x: Column) -> Column:
        whole = x["n"] == x["losses"]
        run = F.when(whole, s["run"] + x["n"]).otherwise(x["last"])
        return F.struct(
            (s["balance"] + x["total"]).alias("balance"), F.greatest(s["peak"], s["balance"] + x["high"]).alias("peak"),
            F.greatest(s["fall"], x["fall"], s["peak"] - (s["balance"] + x["low"])).alias("fall"), run.alias("run"),
            F.greatest(s["longest"], x["most"], s["run"] + F.when(whole, x["n"]).otherwise(x["first"])).alias("longest"),
        )

    folded = chunks.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(cells)), start, step).alias("f"))
    return folded.select(*keys, "f.balance", "f.peak", F.round("f.fall", 2).alias("max_drawdown"), F.col("f.longest").alias("longest_loss_streak"))


#: Fields of trades whose medians a summary has; the last two differ by form.
MEDIANS = ("q_zero", "q_two", "p1_break_even", "p1_buffer", "win_roi", "payout")
#: Distinct counts of a summary: what is counted, and their names for all entries and for resolved ones.
DISTINCT = (("event", "different_games", "resolved_games"), ("day", "days", "resolved_days"), ("competition_country", "countries", None), ("competition", "competitions", None))


@dataclass(frozen=True)
class Places:
    """Where an entry may stand, at once: each place has values of ``names``, a bit of an entry's mask (``_in``) and a form.

    Passes group rows by their mask, or send a row's mask along with it, and give a group to its places only when it is counted,
    so that no row is multiplied by the places that hold it."""

    names: list[str]
    rows: list[tuple]  # values of the names, bit, place of the form in ``forms``
    forms: list[str]

    def table(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join([*[f"{n} string" for n in self.names], "_bit long", "_form int", "_place int"])
        return _literal(spark, tuple((*r[:-2], 1 << r[-2], r[-1], k) for k, r in enumerate(self.rows)), schema)


def _mask(conditions: list[Column]) -> Column:
    """Bit k is set if the k-th condition holds; an unknown condition doesn't."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(x, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, x in enumerate(conditions)])


def _inside(field: str | None, lower: float | None, upper: float | None) -> Column:
    value = F.col(field).cast("double") if field else F.lit(0.0)
    return value.isNotNull() & (F.lit(lower is None) | (value >= F.lit(lower))) & (F.lit(upper is None) | (value < F.lit(upper)))


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_RATIOS = {
    "observed_p1": ("h2_goals_1", "resolved_trades"), "observed_p1_low": ("h2_goals_1", "resolved_trades"), "observed_p1_high": ("h2_goals_1", "resolved_trades"),
    "temporal_status": ("resolved_days",), "sample_status": ("resolved_games",),
}


def summary(
    rows: DataFrame, keys: list[str], day: str = "day", event: str = "event_id", order: tuple[str, ...] = ("observed_at", "event_id"), rounds: int = 500, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """All measures of trades per key. ``rows`` are the entries (simulated, with result_valid); entries without a result
    count as candidates only. Games, days and competitions are counted distinct, of all entries and of resolved ones.

    With ``columns`` only these measures are found, and passes over the rows that none of them needs are left out. Trades of
    a day are in the order of ``order``; their pnl is in whole cents, as :func:`simulate` gives it."""
    one = Places([], [(0, 0)], ["own"])
    trade = {f"_{x}0": F.col(y) for x, y in _TRADE.items()}
    rows = rows.withColumns({"_in": F.lit(1).cast("long"), **trade})
    return _placed_summary(rows, keys, one, day, event, order, rounds, columns)


#: What a trade of each form has, by the names of :func:`simulate`.
_TRADE = {"stake": "stake", "payout": "payout", "pnl": "pnl", "roi": "win_roi", "hit": "covered_hit"}


def _traded(rows: DataFrame, forms: list[str], stake: float, cost: float, cut: float) -> DataFrame:
    """Observations with the trade of each form beside each other (_stake0, _payout0, ..., _stake1, ...)."""
    kept = rows.columns
    rows = rows.withColumn("_split", F.col("_s"))
    for k, form in enumerate(forms):
        rows = simulate(rows.withColumn("_s", F.col("_split")), F.lit(form), stake, cost, cut)
        rows = rows.withColumns({f"_{x}{k}": F.col(y) for x, y in _TRADE.items()})
    return rows.select(*[c for c in kept if c not in ("_s", "win_roi")], *[f"_{x}{k}" for k in range(len(forms)) for x in _TRADE])


def _placed_summary(
    rows: DataFrame, keys: list[str], places: Places, day: str, event: str, order: tuple[str, ...], rounds: int, columns: tuple[str, ...] | None, expand: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The summary by ``keys`` and place of rows with their mask and the trades of all forms. ``expand`` gives rows their keys,
    where they stand under several."""
    expand = expand or (lambda x: x)
    every, c = [*keys, *places.names], F.col
    wants = lambda *names: columns is None or any(x in columns for x in names)
    rows = rows.withColumn("result_valid", F.coalesce("result_valid", F.lit(False)))
    table = places.table(rows.sparkSession)
    out = _sums(expand(rows), keys, places, table)
    dims = {"event": [c(event)], "day": [c(day)], "competition_country": [c("competition_country")], "competition": [c("competition_country"), c("competition_name")]}
    for dim, everywhere, resolved in DISTINCT:
        names = [x for x in (everywhere, resolved) if x]
        if wants(*names, *[r for r, needs in _RATIOS.items() if set(needs) & set(names)]):
            found = _distinct(rows, keys, places, table, dims[dim], names, expand, dim == "event")
            out = with_keys(out, found, every).na.fill(0, names)
    medians = [x for x in MEDIANS if wants(f"median_{x}")]
    if medians:
        out = with_keys(out, _medians(expand(rows), keys, places, table, medians), every)
    low, high = wilson("h2_goals_1", "resolved_trades")
    n = c("resolved_trades")
    derived = {
        "observed_p1": ratio("h2_goals_1", n), "observed_p1_low": low, "observed_p1_high": high, "covered_hit_rate": ratio("_hits", n), "profitable_trade_rate": ratio("profitable_trades", n),
        "roi": ratio("pnl", "total_stake"), "profit_factor": F.when(c("gross_loss") < 0, c("gross_profit") / -c("gross_loss")), "profit_factor_status": F.when(n == 0, "NO_TRADES").when(c("gross_loss") < 0, "FINITE").otherwise("NOT_FINITE"),
        "p1_observed_minus_market": ratio("h2_goals_1", n) - c("expected_p1_mean"),
        "temporal_status": F.when(c("resolved_days") >= LEAST_DAYS, "OK").otherwise("TEMPORAL_EVIDENCE_INSUFFICIENT") if wants("temporal_status") else None,
        "sample_status": F.when(c("resolved_games") < LEAST_GAMES, "VERY_LOW_SAMPLE").otherwise("OK") if wants("sample_status") else None,
    }
    out = out.withColumns({k: v for k, v in derived.items() if v is not None}).drop("_hits")
    path, interval = ("max_drawdown", "longest_loss_streak"), ("roi_low", "roi_high")
    if wants(*path, *interval):
        from pitchspark.operators.aggregates import bootstrap_by_day

        chunks = staged(day_chunks(expand(rows), keys, places, day, list(order)).join(table.drop("_bit", "_form"), "_place"), "studies-chunks")
        if wants(*path):
            out = with_keys(out, _folded(chunks, every).drop("balance", "peak"), every).na.fill(0, list(path))
        if wants(*interval):
            out = with_keys(out, bootstrap_by_day(chunks, every, "_day", "stake", "total", rounds).drop("days"), every)
    return out if columns is None else out.select(*every, *columns)


def _sums(rows: DataFrame, keys: list[str], places: Places, table: DataFrame) -> DataFrame:
    """Counts and sums by key and place: rows are summed by their mask first, for all forms at once."""
    c, done = F.col, F.col("result_valid")
    when = lambda x: F.when(done, x)
    plain = ["entries", "resolved_trades", "unresolved", *[o.lower() for o in OUTCOMES], *[f"level_{v[0].lower()}" for v in LEVELS], "_p1"]
    money = {"total_stake": lambda k: c(f"_stake{k}"), "total_payout": lambda k: c(f"_payout{k}"), "gross_profit": lambda k: F.greatest(f"_pnl{k}", F.lit(0.0)), "gross_loss": lambda k: F.least(f"_pnl{k}", F.lit(0.0)), "pnl": lambda k: c(f"_pnl{k}")}
    counts = {"_hits": lambda k: c(f"_hit{k}"), "profitable_trades": lambda k: c(f"_pnl{k}") > 0, "losing_trades": lambda k: c(f"_pnl{k}") < 0, "zero_pnl_trades": lambda k: c(f"_pnl{k}") == 0}
    by_form = lambda k: F.struct(*[F.sum(when(f(k))).alias(x) for x, f in money.items()], *[count_if(done & f(k)).alias(x) for x, f in counts.items()])
    cells = rows.groupBy(*keys, "_in").agg(
        F.count("*").alias("entries"), count_if(done).alias("resolved_trades"), count_if(~done).alias("unresolved"),
        *[count_if(done & (c("outcome_class") == o)).alias(o.lower()) for o in OUTCOMES], *[count_if(c("evidence_level") == v).alias(f"level_{v[0].lower()}") for v in LEVELS],
        F.sum(when(F.coalesce("p1_market", F.lit(0.0)))).alias("_p1"), F.array(*[by_form(k) for k in range(len(places.forms))]).alias("_m"),
    )
    placed = cells.join(table, c("_in").bitwiseAND(c("_bit")) != 0).withColumn("_m", F.get("_m", c("_form")))
    out = placed.groupBy(*keys, *places.names).agg(
        *[F.sum(x).alias(x) for x in plain], *[F.round(F.coalesce(F.sum(f"_m.{x}"), F.lit(0.0)), 2).alias(x) for x in money], *[F.sum(f"_m.{x}").alias(x) for x in counts]
    )
    return out.withColumn("expected_p1_mean", ratio("_p1", "resolved_trades")).drop("_p1")


def _distinct(rows: DataFrame, keys: list[str], places: Places, table: DataFrame, value: list[Column], names: list[str], expand: Callable[[DataFrame], DataFrame], many: bool) -> DataFrame:
    """How many different values each key and place has, of all rows and of resolved ones. A value's masks are united, so it is
    moved once for all places (``many``: before it gets its keys); what is left is a count by united masks."""
    c = F.col
    known = reduce(lambda a, b: a & b, [v.isNotNull() for v in value])
    parts = [f"_v{k}" for k in range(len(value))]
    rows = rows.where(known).withColumns({p: v for p, v in zip(parts, value, strict=True)} | {"_ok": F.when(c("result_valid"), c("_in")).otherwise(F.lit(0).cast("long"))})
    rows = expand(rows.repartition(_parts(rows), *parts) if many else rows)
    once = rows.groupBy(*keys, *parts).agg(F.bit_or("_in").alias("_in"), F.bit_or("_ok").alias("_ok"))
    masks = once.groupBy(*keys, "_in", "_ok").agg(F.count("*").alias("_n"))
    counts = [F.sum("_n"), F.sum(F.when(c("_ok").bitwiseAND(c("_bit")) != 0, c("_n")).otherwise(0))]
    placed = masks.join(table, c("_in").bitwiseAND(c("_bit")) != 0)
    return placed.groupBy(*keys, *places.names).agg(*[n.cast("long").alias(x) for x, n in zip(names, counts)])


def _medians(rows: DataFrame, keys: list[str], places: Places, table: DataFrame, fields: list[str]) -> DataFrame:
    """Medians by key and place of resolved trades. Values are counted by mask before they go to their places."""
    c = F.col
    cells = []
    for m, x in enumerate(fields):
        for k in range(len(places.forms)) if x in MEDIANS[4:] else (-1,):
            own = {"win_roi": f"_roi{k}", "payout": f"_payout{k}"}.get(x, x)
            cells.append(F.struct(F.lit(m).alias("m"), F.lit(k).alias("f"), c(own).cast("double").alias("value")))
    flat = rows.where("result_valid").select(*keys, "_in", F.explode(F.array(*cells)).alias("c")).where("c.value IS NOT NULL")
    counted = flat.groupBy(*keys, "_in", "c.m", "c.f", "c.value").agg(F.count("*").alias("n"))
    here = (c("_in").bitwiseAND(c("_bit")) != 0) & ((c("f") == -1) | (c("f") == c("_form")))
    every = [*keys, *places.names]
    key = F.struct(*every) if every else F.struct(F.lit(0).alias("_all"))
    placed = counted.join(table, here).select(key.alias("key"), "m", "value", "n")
    return counted_quantiles(placed, every, {f"median_{x}": (m, 0.5) for m, x in enumerate(fields)})


def day_chunks(rows: DataFrame, keys: list[str], places: Places, day: str, order: list[str]) -> DataFrame:
    """What each day's resolved trades do to a path, by key and place: sums, extremes and runs as in :func:`path_stats`.

    A row is moved and sorted once for all places. A day is read in batches, each of which gives a chunk of its own (``_seq``
    is their order), so no day has to fit in memory."""
    pnl = [F.round(F.col(f"_pnl{k}") * 100).cast("long").alias(f"_pnl{k}") for k in range(len(places.forms))]
    stake = [F.col(f"_stake{k}") for k in range(len(places.forms))]
    group = [*keys, "_day"]
    moved = rows.where("result_valid").withColumn("_day", F.col(day))
    narrow = moved.select(*group, *[F.col(x).alias(f"_o{i}") for i, x in enumerate(order)], "_in", *pnl, *stake)
    ordered = narrow.repartition(_parts(rows), *group).sortWithinPartitions(*group, *[f"_o{i}" for i in range(len(order))])
    ordered = ordered.select(*group, "_in", *[f"_{x}{k}" for x in ("pnl", "stake") for k in range(len(places.forms))])
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "_seq long, _place int, stake double, total double, high double, low double, fall double, n long, losses long, first long, last long, most long"])
    spots = [(1 << r[-2], r[-1]) for r in places.rows]

    def run(batches):
        import pyarrow as pa

        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = _starts([batch.column(i) for i in range(len(group))])
            section = np.zeros(batch.num_rows, dtype=np.int64)
            section[begin[1:]] = 1
            section = np.cumsum(section)
            value = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            mask, found = value("_in"), []
            for k, (bit, form) in enumerate(spots):
                own = np.flatnonzero(mask & bit)
                if len(own):
                    at, numbers = _chunks(section[own], value(f"_pnl{form}")[own])
                    stakes = np.add.reduceat(value(f"_stake{form}")[own].astype(np.float64), np.flatnonzero(np.diff(section[own], prepend=-1)))
                    found.append((at, np.full(len(at), k, dtype=np.int32), stakes, *numbers))
            if found:
                at, place, stakes, *numbers = (np.concatenate(x) for x in zip(*found, strict=True))
                cells = [batch.column(i).take(pa.array(begin[at])) for i in range(len(group))]
                counts = [x / 100.0 if i < 4 else x for i, x in enumerate(numbers)]
                columns = [*cells, pa.array(seq + at), pa.array(place), pa.array(stakes), *[pa.array(x) for x in counts]]
                names = [*group, "_seq", "_place", "stake", "total", "high", "low", "fall", "n", "losses", "first", "last", "most"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            seq += len(begin)

    return ordered.mapInArrow(run, schema)


def _starts(columns: list) -> np.ndarray:
    """The rows of a batch at which a value differs from the row before; the first too."""
    import pyarrow.compute as pc

    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for x in columns:
        a, b = x.slice(1), x.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _chunks(section: np.ndarray, pnl: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each section (ascending numbers of rows in order): total, highest and lowest running sum, greatest fall from a peak (0
    at least), rows, losses, run of losses at the start, at the end, and the longest. Whole numbers, so sums are exact."""
    start = np.flatnonzero(np.diff(section, prepend=-1))
    length = np.diff(start, append=len(section))
    end = start + length - 1
    upto = np.cumsum(pnl)
    running = upto - np.repeat(upto[start] - pnl[start], length)
    above = np.maximum(running, 0)
    lift = np.repeat(np.arange(len(start), dtype=np.int64) * (int(above.max()) + 1), length)  # keeps a section's peak from the next
    fall = np.maximum.accumulate(above + lift) - lift - running
    lost, place = pnl < 0, np.arange(len(section))
    before = np.maximum(np.maximum.accumulate(np.where(lost, -1, place)), np.repeat(start - 1, length))
    streak = place - before
    first = np.minimum(np.minimum.reduceat(np.where(lost, len(section), place), start), end + 1) - start
    numbers = [running[end], np.maximum.reduceat(running, start), np.minimum.reduceat(running, start), np.maximum.reduceat(fall, start)]
    return section[start], [*numbers, length, np.add.reduceat(lost.astype(np.int64), start), first, streak[end], np.maximum.reduceat(streak, start)]


def _literal(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(rows), schema))  # as many rows as the constant


#: What a summary reads of an observation.
_READ = ("competition_country", "competition_name", "outcome_class", "evidence_level", "result_valid", "p1_market", "q_zero", "q_two", "p1_break_even", "p1_buffer", "ht_goals")


def _played(rows: DataFrame, mask: Column, forms: list[str], read: list[str], stake: float, cost: float = 0.0, cut: float = 0.0) -> DataFrame:
    """Eligible observations with the mask of their places and the trades of all forms, narrowed to what is read and staged.

    A trade follows from two quotes and an outcome, which repeat: if the different ones can be broadcast, each is played once;
    else row by row."""
    rows = rows.where("entry_eligible").select(*dict.fromkeys([*_READ, *read]))
    rows = staged(spread(rows), "studies-rows")
    kind = ["q_zero", "q_two", "outcome_class"]
    kinds, fits = shared_side(rows.select(*kind).distinct())
    if fits:
        trades = staged(_traded(with_split(kinds.withColumn("p1_market", F.lit(None).cast("double")), stake, cut), forms, stake, cost, cut).drop("p1_market"), "studies-trades")
        same = reduce(lambda a, b: a & b, [rows[x].eqNullSafe(trades[x]) for x in kind])
        rows = rows.join(F.broadcast(trades), same, "left").drop(*[trades[x] for x in kind])  # as many rows as kinds, which were measured
    else:
        rows = staged(_traded(with_split(rows, stake, cut), forms, stake, cost, cut), "studies-trades")
    return rows.withColumn("_in", mask)


_FORMS = [COMBINATION, SINGLE_ZERO, SINGLE_TWO]
_ORDER = ("observed_at", "event_id")


def variant_study(
    rows: DataFrame, stake: float = 10.0, cost: float = 0.0, cut: float = 0.0, rounds: int = 500, order: tuple[str, ...] = _ORDER, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """Summary of every variant, with the number of eligible observations that it leaves out and its evaluation status."""
    places = Places(["variant"], [(v[0], k, _FORMS.index(v[1])) for k, v in enumerate(VARIANTS)], _FORMS)
    own = None if columns is None else tuple(dict.fromkeys([*columns, "entries", "resolved_games", "roi"]))
    played = _played(rows, _mask([_inside(*v[2:]) for v in VARIANTS]), _FORMS, ["day", "event_id", *order], stake, cost, cut)
    found = _placed_summary(played, [], places, "day", "event_id", order, rounds, own)
    eligible = F.max(F.when(F.col("variant") == VARIANTS[0][0], F.col("entries"))).over(Window.partitionBy())  # the first variant takes all; a window over variants
    status = (
        F.when(F.col("resolved_games") < CANDIDATE_GAMES, "INSUFFICIENT_DATA").when(F.col("roi").isNull(), "NO_RESULT_OBSERVED").when(F.col("roi") <= 0, "NEGATIVE_RESULT").otherwise("PROMISING_EXPLORATORY")
    )
    return found.withColumn("no_bet", eligible - F.col("entries")).withColumn("evaluation_status", status)


def reference_study(
    rows: DataFrame, stake: float = 10.0, cost: float = 0.0, cut: float = 0.0, rounds: int = 500, order: tuple[str, ...] = _ORDER, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """Every variant's entries played in each of the three forms."""
    places = Places(["variant", "reference"], [(v[0], f, k, i) for k, v in enumerate(VARIANTS) for i, f in enumerate(_FORMS)], _FORMS)
    more = ["day", "event_id", *order] if columns is None or not set(columns) <= SUMS else []
    played = _played(rows, _mask([_inside(*v[2:]) for v in VARIANTS]), _FORMS, more, stake, cost, cut)
    return _placed_summary(played, [], places, "day", "event_id", order, rounds, columns)


#: Columns of a summary that one pass gives.
SUMS = {
    "entries", "resolved_trades", "unresolved", *[o.lower() for o in OUTCOMES], *[f"level_{v[0].lower()}" for v in LEVELS], "expected_p1_mean", "total_stake", "total_payout", "gross_profit", "gross_loss", "pnl",
    "profitable_trades", "losing_trades", "zero_pnl_trades", "covered_hit_rate", "profitable_trade_rate", "roi", "profit_factor", "profit_factor_status", "observed_p1", "observed_p1_low", "observed_p1_high", "p1_observed_minus_market",
}


def segment_study(rows: DataFrame, stake: float = 10.0, rounds: int = 500, order: tuple[str, ...] = _ORDER, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Every variant's trades by day, country and competition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    cells = {"DATE": text("day"), "COUNTRY": text("competition_country"), "COMPETITION": F.concat_ws(" / ", text("competition_country"), text("competition_name"))}
    places = Places(["variant"], [(v[0], k, _FORMS.index(v[1])) for k, v in enumerate(VARIANTS)], _FORMS)
    played = _played(rows, _mask([_inside(*v[2:]) for v in VARIANTS]), _FORMS, ["day", "event_id", *order], stake)

    def expand(x: DataFrame) -> DataFrame:
        return x.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("segment_key")) for k, v in cells.items()]))).select("*", "_g.*").drop("_g")

    return _placed_summary(played, ["segment", "segment_key"], places, "day", "event_id", order, rounds, columns, expand)


def pattern_buckets(rows: DataFrame, stake: float = 10.0, rounds: int = 500, order: tuple[str, ...] = _ORDER, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Summary of the fixed buckets of four dimensions; observations outside all buckets of a dimension aren't in it."""
    places = Places(["dimension", "bucket"], [(*b[:2], k, 0) for k, b in enumerate(BUCKETS)], [COMBINATION])
    own = None if columns is None else tuple(dict.fromkeys([*columns, "expected_p1_mean", "resolved_trades"]))
    played = _played(rows, _mask([_inside(*b[2:]) for b in BUCKETS]), [COMBINATION], ["day", "event_id", *order], stake)
    found = _placed_summary(played, [], places, "day", "event_id", order, rounds, own)
    return found.withColumn("expected_exact_one", F.col("expected_p1_mean") * F.col("resolved_trades"))


def in_bucket(rows: DataFrame, dimension: str, label: str) -> DataFrame:
    """The observations of one bucket; goals at half time come from the score where they are missing."""
    field, lower, upper = next((b[2], b[3], b[4]) for b in BUCKETS if b[:2] == (dimension, label))
    value = F.coalesce("ht_goals", F.col("ht_home") + F.col("ht_away")) if field == "ht_goals" and "ht_home" in rows.columns else F.col(field)
    return rows.where((value >= lower) & (F.lit(upper is None) | (value < (upper or 0))))


def audit(rows: DataFrame, key: str = "event_id", kind: str = "snapshot_type") -> DataFrame:
    """Findings (code, severity, n) of observations; codes without a case are left out. One pass, and one for repeated keys."""
    c = F.col
    flag = lambda name: count_if(F.array_contains("quality_flags", name))
    facts = rows.agg(
        count_if(~c("result_valid")).alias("RESULT_COVERAGE_LIMITED"), count_if(~c("ft_result_valid")).alias("FT_COVERAGE_SEPARATE"), count_if(~c("phase_confirmed")).alias("HALFTIME_PHASE_CONFLICTS"),
        count_if(c("extra_time").isNull() | c("penalties").isNull()).alias("SETTLEMENT_SCOPE_UNKNOWN"), flag("P1_RECOMPUTATION_CONFLICT").alias("P1_RECOMPUTATION_CONFLICTS"), flag("P1_PAIR_INCONSISTENT").alias("P1_PAIR_INCONSISTENCIES"),
    )
    repeated = rows.groupBy(key, kind).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("DUPLICATE_EVENT_SNAPSHOT_KEYS"))
    both = facts.crossJoin(repeated)  # one row each
    medium = ("FT_COVERAGE_SEPARATE",)
    cells = F.array(*[F.struct(F.lit(n).alias("code"), F.lit("MEDIUM" if n in medium else "HIGH").alias("severity"), c(n).alias("n")) for n in both.columns])
    apart = (c("code") != "FT_COVERAGE_SEPARATE") | (c("n") != c("RESULT_COVERAGE_LIMITED"))
    return both.withColumn("_c", F.explode(cells)).select("RESULT_COVERAGE_LIMITED", "_c.*").where((c("n") > 0) & apart).select("code", "severity", "n")


def study_registry(old: DataFrame, run: DataFrame) -> DataFrame:
    """The registry with ``run`` in place of rows of its run_id: run_id, created_at, status, hashes (array), and the number of
    distinct hashes over all runs in every row."""
    every = old.join(run.select("run_id"), "run_id", "left_anti").unionByName(run)
    distinct = every.select(F.explode("hashes").alias("h")).agg(F.count_distinct("h").alias("total_configurations"))
    return every.crossJoin(F.broadcast(distinct))


def latest_run(registry: DataFrame) -> DataFrame:
    """The newest complete run."""
    whole = F.struct(*[F.col(c) for c in registry.columns])
    return registry.where("status = 'COMPLETE'").agg(F.max_by(whole, F.struct("created_at", "run_id")).alias("r")).where("r IS NOT NULL").select("r.*")
