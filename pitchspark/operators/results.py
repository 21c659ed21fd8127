"""Results: settlement, finalisation from evidence, backfill checks, targets, readiness and daily metrics.

Flags are three-valued: true, false or null for unknown, and unknown never counts as "no".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.operators.aggregates import count_if

# Words for states.
SETTLED = ("FINISHED", "FINAL", "ENDED", "END", "COMPLETED", "SETTLED", "FULL_TIME", "NO_LONGER_LIVE_FINAL", "COMPLETE")
VOID = ("VOID",)
CALLED_OFF = ("CANCELLED", "CANCELED", "POSTPONED", "ABANDONED")
TERMINAL = ("finished", "final", "ended", "end", "completed", "settled", "full_time", "ft")
ACTIVE = ("live", "in_play", "inplay", "running", "first_half", "second_half")
HALF = ("half_time", "halftime", "ht", "break", "hz")
BEFORE = ("pre_match", "prematch", "scheduled")
GONE = ("no_longer_live",)
STANDARD = ("PRE_KICKOFF", "HALFTIME", "HT_STABLE", "MINUTE_60", "MINUTE_70", "MINUTE_80", "FIRST_H2_GOAL_REOPEN", "MINUTE_85", "MINUTE_90", "FINAL")
EXTRA_TIME_TEXT = r"extra\s*time|after\s+extra|a\.e\.t\.|\baet\b|penalty\s+shoot|shootout|verl[äa]ngerung|\bn\.?\s*v\.?\b"
FORBIDDEN_FEATURE = r"(^|_)ft(_|$)|(^|_)final(_|$)|second[_ ]half|actual[_ ]target|(^|_)result(_|$)"
CUTOFFS = ("HALFTIME", "FIRST_HALF", "ROLLING_HISTORY")
TARGETS = ("H2_GOALS_0", "H2_GOALS_1", "H2_GOALS_2_PLUS")


def _score(x: Column) -> Column:
    """A score, or null if it isn't a whole number from zero on."""
    return F.when((x >= 0) & (x == F.floor(x)), x.cast("int"))


def settlement(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column, status: Column, extra_time: Column, penalties: Column, reg_home: Column | None = None, reg_away: Column | None = None) -> Column:
    """Struct of verdict (VOID, UNRESOLVED, WIN_ZERO, LOSS_MIDDLE, WIN_TWO_PLUS), reason and goals after half time.

    The first that holds: void, extra time or penalties without a score of regular time, either flag unknown, not final, a
    score missing (or negative, or not whole), a side below its half-time score. Regular-time scores, where both are given,
    take the place of the final ones and need no flags.
    """
    none = F.lit(None).cast("double")
    reg_home, reg_away = (none if reg_home is None else reg_home), (none if reg_away is None else reg_away)
    regular = reg_home.isNotNull() & reg_away.isNotNull()
    word = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    h, a = _score(F.when(regular, reg_home).otherwise(ft_home)), _score(F.when(regular, reg_away).otherwise(ft_away))
    hh, ha = _score(ht_home), _score(ht_away)
    goals = h + a - hh - ha
    yes = lambda x: F.coalesce(x, F.lit(False))
    reason = (
        F.when(word.isin(*VOID), F.concat(F.lit("EVENT_"), word)).when(~regular & (yes(extra_time) | yes(penalties)), "REGULATION_SCORE_REQUIRED")
        .when(~regular & (extra_time.isNull() | penalties.isNull()), "EXTRA_TIME_SCOPE_UNKNOWN").when(~word.isin(*SETTLED), "FINAL_RESULT_NOT_CONFIRMED")
        .when(h.isNull() | a.isNull() | hh.isNull() | ha.isNull(), "MISSING_HALF_TIME_OR_FINAL_SCORE").when((h < hh) | (a < ha), "FINAL_SCORE_BELOW_HALF_TIME_SCORE")
        .otherwise(F.concat(F.lit("SECOND_HALF_GOALS_"), goals.cast("string")))
    )
    counted = F.startswith(reason, F.lit("SECOND_HALF_GOALS_"))
    verdict = F.when(word.isin(*VOID), "VOID").when(~counted, "UNRESOLVED").when(goals == 0, "WIN_ZERO").when(goals == 1, "LOSS_MIDDLE").otherwise("WIN_TWO_PLUS")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"), F.when(counted, goals).alias("goals"))


def game_status(status: Column, period: Column, has_final: Column) -> Column:
    """The provider's words for state and period as one status; that an event went away is no proof of its end."""
    s, p = (F.lower(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"[\s-]+", "_")) for x in (status, period))
    either = lambda words: s.isin(*words) | p.isin(*words)
    off = tuple(w.lower() for w in CALLED_OFF)
    return (
        F.when(either(TERMINAL), "FINISHED").when(s.isin(*off), F.upper(s)).when(p.isin(*off), F.upper(p)).when(has_final, "FINISHED")
        .when(either(ACTIVE), "LIVE").when(either(HALF), "HALFTIME").when(either(BEFORE), "SCHEDULED").otherwise("UNKNOWN")
    )


def finalised(events: DataFrame, evidence: DataFrame, half_times: DataFrame, frozen: DataFrame) -> DataFrame:
    """One decision per event: final and half-time score, status of the result, what it may be used for, reason and flags.

    ``events``: event_id, status, period, extra_time, penalties. ``evidence`` (of all sources): event_id, source, observed_at,
    terminal, ft_home, ft_away, ht_home, ht_away, extra_time, penalties. ``half_times``: event_id, observed_at, ht_home,
    ht_away. ``frozen``: event_id (once), ht_home, ht_away of an entry that was taken.

    Only terminal evidence counts; the latest complete one wins, or the latest if none is complete. Several different final
    scores, or half-time scores, are conflicts; of the latter the frozen one is kept if it is among them, else the smallest.
    Evidence is partly aggregated before its one shuffle, whatever the number of observations of an event.
    """
    c = F.col
    complete = c("ft_home").isNotNull() & c("ft_away").isNotNull()
    fact = F.struct("observed_at", "source", "ft_home", "ft_away", F.col("extra_time").alias("e"), F.col("penalties").alias("p"))
    proof = evidence.where("terminal").groupBy("event_id").agg(
        F.max(F.when(complete, fact)).alias("full"), F.max(fact).alias("any"), F.count_distinct(F.when(complete, F.struct("ft_home", "ft_away"))).alias("n_ft")
    )
    pairs = evidence.where("terminal").select("event_id", "ht_home", "ht_away").unionByName(half_times.select("event_id", "ht_home", "ht_away"))
    halves = pairs.where("ht_home >= 0 AND ht_away >= 0").groupBy("event_id").agg(F.count_distinct(F.struct("ht_home", "ht_away")).alias("n_ht"), F.min(F.struct("ht_home", "ht_away")).alias("least"))
    kept = frozen.select("event_id", F.struct("ht_home", "ht_away").alias("frozen"))
    among = pairs.select("event_id", F.struct("ht_home", "ht_away").alias("frozen")).distinct().join(kept, ["event_id", "frozen"], "left_semi").withColumn("known", F.lit(True))
    rows = events.join(proof, "event_id", "left").join(halves, "event_id", "left").join(kept, "event_id", "left").join(among, ["event_id", "frozen"], "left")
    chosen = F.coalesce("full", "any")
    rows = rows.withColumn("_c", chosen)
    h, a = c("_c.ft_home"), c("_c.ft_away")
    ht = F.when(c("n_ht").isNull(), F.lit(None)).otherwise(F.when(c("known"), c("frozen")).otherwise(c("least")))
    rows = rows.withColumn("_h", ht)
    hh, ha = c("_h.ht_home"), c("_h.ht_away")
    flag = lambda name: (F.coalesce(F.coalesce(c("_c.e" if name == "extra_time" else "_c.p"), c(name)), F.lit(None)))
    extra, pens = flag("extra_time"), flag("penalties")
    scope = F.when(F.coalesce(pens, F.lit(False)), "PENALTIES").when(F.coalesce(extra, F.lit(False)), "EXTRA_TIME").when(extra.isNull() | pens.isNull(), "UNKNOWN").otherwise("REGULATION")
    status = game_status(c("status"), c("period"), c("_c").isNotNull())
    ft, many = h.isNotNull() & a.isNotNull(), F.coalesce(c("n_ft") > 1, F.lit(False))
    invalid = ft & ((h < 0) | (a < 0))
    frozen_conflict = c("frozen").isNotNull() & c("known").isNull()
    conflict = F.coalesce(c("n_ht") > 1, F.lit(False)) | frozen_conflict
    below = F.coalesce((h < hh) | (a < ha), F.lit(False))
    off = status.isin(*CALLED_OFF)
    sound = hh.isNotNull() & ft & ~below & ~conflict
    gone = F.lower(F.coalesce(c("status"), F.lit(""))).isin(*GONE)
    ladder = [
        (many, "RESULT_CONFLICT", "CONFLICT", False, False), (invalid, "INVALID_FT_SCORE", "PARTIAL", False, False), (~ft & gone, "NO_LONGER_LIVE_WITHOUT_FINAL_EVIDENCE", "PENDING", False, False),
        (~ft & off, "EVENT_CALLED_OFF", "UNAVAILABLE", False, False), (~ft, "FINAL_SCORE_MISSING", "PENDING", False, False), (scope.isin("EXTRA_TIME", "PENALTIES"), "NON_REGULATION_SCOPE", "PARTIAL", False, False),
        (scope != "REGULATION", "SCOPE_UNKNOWN", "PARTIAL", False, False), (conflict, "HALFTIME_EVIDENCE_CONFLICT", "PARTIAL", True, False), (below, "INVALID_FT_BELOW_HT", "PARTIAL", False, False),
        (~sound, "HT_MISSING", "VERIFIED", True, False), (F.lit(True), "VERIFIED_REGULATION", "VERIFIED", True, True),
    ]
    decided = None
    for cond, *values in ladder:
        cell = F.struct(*[F.lit(v).alias(k) for k, v in zip(("reason", "result_status", "use_ft", "use_h2"), values)])
        decided = F.when(cond, cell) if decided is None else decided.when(cond, cell)
    marks = [(many, "MULTIPLE_TERMINAL_FT_VALUES"), (invalid, "INVALID_FT_SCORE"), (F.coalesce(c("n_ht") > 1, F.lit(False)), "HALFTIME_EVIDENCE_CONFLICT"), (frozen_conflict, "FROZEN_ENTRY_HT_CONFLICT"), (below, "FT_BELOW_HT_SCORE")]
    flags = F.array_sort(F.filter(F.array(*[F.when(cond, F.lit(n)) for cond, n in marks]), lambda x: x.isNotNull()))
    rows = rows.select("event_id", status.alias("canonical_status"), scope.alias("scope"), h.alias("ft_home"), a.alias("ft_away"), hh.alias("ht_home"), ha.alias("ht_away"), c("_c.source").alias("ft_source"), decided.alias("d"), flags.alias("flags"))
    return rows.select("event_id", "canonical_status", "scope", "ft_home", "ft_away", "ht_home", "ht_away", "ft_source", "d.*", "flags").withColumn("h2_goals", F.when(F.col("use_h2"), h_goals()))


def h_goals() -> Column:
    return F.col("ft_home") + F.col("ft_away") - F.col("ht_home") - F.col("ht_away")


def backfill_plans(events: DataFrame, links: DataFrame, matches: DataFrame) -> DataFrame:
    """Which provider match each event's result may come from: its confirmed link, else the verdict of a match (event_id,
    provider_match_id, verdict, score), else nothing."""
    known = links.select("event_id", F.col("provider_match_id").alias("_link"))
    found = matches.select("event_id", F.col("provider_match_id").alias("_match"), "verdict", "score")
    rows = events.join(known, "event_id", "left").join(found, "event_id", "left")
    sure = F.col("verdict").isin("EXACT", "HIGH_CONFIDENCE")
    status = F.when(F.col("_link").isNotNull(), "LINKED").otherwise(F.coalesce("verdict", F.lit("NO_CANDIDATE")))
    return rows.select(*events.columns, status.alias("identity_status"), F.coalesce("_link", F.when(sure, F.col("_match"))).alias("provider_match_id"), F.when(F.col("_link").isNotNull(), 1.0).otherwise(F.col("score")).alias("confidence"))


def backfill_check(identity_ok: Column, finished: Column, scope: Column, ht: tuple[Column, Column], ft: tuple[Column, Column], own_ht: tuple[Column, Column], allow_unknown: bool = False) -> Column:
    """Status of a provider's result for an event, the first that holds."""
    missing = ft[0].isNull() | ft[1].isNull()
    negative = F.lit(False)
    for x in (*ht, *ft):
        negative = negative | F.coalesce(x < 0, F.lit(False))
    ht_missing = ht[0].isNull() | ht[1].isNull()
    conflict = F.coalesce((own_ht[0] != ht[0]) | (own_ht[1] != ht[1]), F.lit(False)) & own_ht[0].isNotNull() & own_ht[1].isNotNull()
    return (
        F.when(~identity_ok, "IDENTITY_CONFLICT").when(~finished, "NOT_FINISHED").when(missing, "INCOMPLETE_SCORE").when(negative, "INVALID_SCORE")
        .when(scope.isin("EXTRA_TIME", "PENALTIES"), "EXCLUDED_NON_REGULATION").when((scope == "UNKNOWN") & F.lit(not allow_unknown), "SCOPE_UNKNOWN")
        .when(ht_missing, "VALID_FT_ONLY").when((ft[0] < ht[0]) | (ft[1] < ht[1]), "INVALID_SCORE").when(conflict, "HT_CONFLICT")
        .when(scope == "UNKNOWN", "VALID_SCOPE_ASSUMED").otherwise("VALID_REGULATION")
    )


def retry_at(status: Column, attempts: Column, last: Column) -> Column:
    """When to try again: never after a terminal status, by status and number of attempts else."""
    terminal = ("VALID_REGULATION", "VALID_SCOPE_ASSUMED", "VALID_FT_ONLY", "EXCLUDED_NON_REGULATION")
    slow = ("AMBIGUOUS", "SCOPE_UNKNOWN", "IDENTITY_CONFLICT", "INCOMPLETE_SCORE", "INVALID_SCORE", "HT_CONFLICT")
    grown = F.when(attempts <= 1, 24).when(attempts <= 3, 72).otherwise(168)
    hours = F.when(status == "NOT_FINISHED", 5).when(status.isin(*slow), 168).when(status.isin("NO_CANDIDATE", "UNMATCHED", "NO_DATA"), grown).otherwise(24)
    return F.when(~status.isin(*terminal), F.timestamp_seconds(F.unix_timestamp(last) + hours * 3600))


def stage_items(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inventory items with the stage that follows from their provider outcome: COMPLETE, BLOCKED_PROVIDER, or blocked for
    want of an outcome; items that aren't pending stay."""
    rows = items.join(outcomes.select("event_id", F.col("status").alias("_s")), "event_id", "left")
    good = F.startswith(F.col("_s"), F.lit("VALID")) | (F.col("_s") == "EXCLUDED_NON_REGULATION")
    stage = F.when(F.col("stage") != "PENDING", F.col("stage")).when(F.col("_s").isNull(), "BLOCKED_NO_OUTCOME").when(good, "COMPLETE").otherwise("BLOCKED_PROVIDER")
    return rows.withColumn("stage", stage).drop("_s")


def run_status(items: DataFrame) -> DataFrame:
    """One row: counts by stage and the status of the whole run."""
    counted = items.agg(*[count_if(F.startswith("stage", F.lit(s))).alias(s.lower()) for s in ("COMPLETE", "BLOCKED", "PENDING")])
    status = F.when(F.col("pending") > 0, "RUNNING").when(F.col("blocked") > 0, "COMPLETE_WITH_BLOCKED").otherwise("COMPLETE")
    return counted.withColumn("status", status)


def h2_target(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column, ambiguous: Column) -> Column:
    """Struct of target class, quality and eligibility from half-time and regular-time scores; each side is checked by itself."""
    missing = ht_home.isNull() | ht_away.isNull() | ft_home.isNull() | ft_away.isNull()
    home, away = ft_home - ht_home, ft_away - ht_away
    quality = F.when(ambiguous, "INVALID_EXTRA_TIME_AMBIGUOUS").when(missing, "MISSING_HT_OR_REGULATION_FT").when((home < 0) | (away < 0), "INVALID_SCORE_TOTAL_LT_HALFTIME").otherwise("VALID_REGULATION")
    good = quality == "VALID_REGULATION"
    total = home + away
    known = ~(ambiguous | missing)
    label = F.when(total == 0, TARGETS[0]).when(total == 1, TARGETS[1]).otherwise(TARGETS[2])
    return F.struct(
        F.when(known, home).alias("h2_home"), F.when(known, away).alias("h2_away"), F.when(known, total).alias("h2_total"), F.when(good, label).alias("target"), F.when(good, total == 1).alias("middle_loss"), quality.alias("quality"), good.alias("eligible")
    )


def extra_time_text(*texts: Column) -> Column:
    return F.coalesce(F.lower(F.concat_ws(" ", *texts)).rlike(EXTRA_TIME_TEXT), F.lit(False))


def dataset_audit(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: rows, rows whose stored target differs from the recomputed one, and features that may not be used (by name,
    by cut-off, or without an entry in ``catalog``: feature, origin, cutoff). ``rows``: the scores, ambiguous, target, quality,
    eligible."""
    name = F.lower(F.concat_ws(" ", "feature", F.coalesce("origin", F.lit(""))))
    bad = catalog.where(F.regexp_replace(name, "-", "_").rlike(FORBIDDEN_FEATURE) | ~F.coalesce(F.col("cutoff").isin(*CUTOFFS), F.lit(False))).agg(F.count("*").alias("forbidden_features"))
    again = h2_target(F.col("ht_home"), F.col("ht_away"), F.col("ft_home"), F.col("ft_away"), F.col("ambiguous"))
    differs = ~(again["target"].eqNullSafe(F.col("target")) & again["quality"].eqNullSafe(F.col("quality")) & again["eligible"].eqNullSafe(F.col("eligible")))
    found = rows.agg(F.count("*").alias("n"), count_if("eligible").alias("eligible_rows"), count_if(differs).alias("target_mismatches"))
    status = F.when((F.col("target_mismatches") == 0) & (F.col("forbidden_features") == 0), "PASS").otherwise("FAIL")
    return found.crossJoin(F.broadcast(bad)).withColumn("status", status)  # one row each


def eligible_rows(rows: DataFrame, needs: list[str], kickoff: str, years: int | None = None, league: tuple[str, str] | None = None) -> DataFrame:
    """Rows for training: eligible, with all needed availability flags, of a league if given, and within ``years`` of the
    latest kickoff of what is left then."""
    for flag in ["eligible", *needs]:
        rows = rows.where(F.coalesce(F.col(flag), F.lit(False)))
    if league:
        rows = rows.where(F.col(league[0]).cast("string") == league[1])
    if years is None:
        return rows
    last = rows.agg(F.max(kickoff).alias("_last"))  # one row
    seconds = int(years * 365.25 * 86400)
    return rows.crossJoin(F.broadcast(last)).where(F.unix_timestamp(kickoff) >= F.unix_timestamp("_last") - seconds).drop("_last")


def match_quality(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column, has_stats: Column, has_half_stats: Column) -> Column:
    """INVALID (fewer goals in all than at half time), PARTIAL, SCORE_ONLY or COMPLETE."""
    missing = ht_home.isNull() | ht_away.isNull() | ft_home.isNull() | ft_away.isNull()
    return (
        F.when(~missing & (ft_home + ft_away < ht_home + ht_away), "INVALID").when(missing, "PARTIAL").when(~(has_stats | has_half_stats), "SCORE_ONLY").when(~has_half_stats, "PARTIAL").otherwise("COMPLETE")
    )


def snapshot_quality(markets: Column, outcomes: Column, opened: Column, paused: Column) -> Column:
    return F.when((markets == 0) | (outcomes == 0), "PARTIAL").when((opened == 0) & (paused > 0), "MOSTLY_PAUSED").when(opened < outcomes / 2, "PARTIAL").otherwise("COMPLETE")


def accepted_states(observations: DataFrame, grace_hours: float, now: Column) -> DataFrame:
    """The observations (event_id, at, kind, kickoff) that a keyed state takes in order: a finished event takes only finished
    ones, one that went away takes live ones and coming ones whose kickoff is within the grace, a live one no coming ones.

    ``kind`` is FINISHED, GONE, LIVE, PREMATCH or OTHER. What was accepted decides on what follows, so this is a fold over
    each event's few observations in time order."""
    cutoff = F.unix_micros(now.cast("timestamp")) - F.lit(int(max(0.0, grace_hours) * 3_600_000_000))
    rows = observations.withColumn("_soon", F.coalesce(F.unix_micros(F.col("kickoff").cast("timestamp")) > cutoff, F.lit(False)))
    items = F.array_sort(F.collect_list(F.struct("at", "kind", "_soon")))

    def step(s: Column, x: Column) -> Column:
        was, kind = s["state"], x["kind"]
        fine = (
            F.when(was == "FINISHED", kind == "FINISHED").when(was == "GONE", (kind == "LIVE") | ((kind == "PREMATCH") & x["_soon"])).when(was == "LIVE", kind != "PREMATCH").otherwise(True)
        )
        return F.struct(F.when(fine, kind).otherwise(was).alias("state"), F.concat(s["taken"], F.array(fine)).alias("taken"))

    start = F.struct(F.lit("").alias("state"), F.array().cast("array<boolean>").alias("taken"))
    folded = rows.groupBy("event_id").agg(items.alias("_i")).withColumn("_t", F.aggregate("_i", start, step)["taken"])
    return folded.select("event_id", F.posexplode("_i").alias("_p", "x"), "_t").select("event_id", "x.at", "x.kind", F.element_at("_t", F.col("_p") + 1).alias("accepted"))


def halftime_from_goals(goals: Column, ft_home: Column, ft_away: Column, use_later: bool = False) -> Column:
    """Struct of the half-time score out of an array of goals (minute, home, away: the score after it).

    The last goal up to minute 45 gives it, a goalless match gives 0-0; with ``use_later`` the first goal after the break
    gives its recorded score before that, which some feeds have as the score before the goal. Unknown otherwise."""
    ordered = F.array_sort(F.filter(goals, lambda g: g["minute"].isNotNull()))
    first = F.filter(ordered, lambda g: g["minute"] <= 45)
    late = F.filter(ordered, lambda g: g["minute"] > 45)
    cell = lambda g: F.struct(g["home"].alias("home"), g["away"].alias("away"))
    known = lambda g: g["home"].isNotNull() & g["away"].isNotNull()
    last, after = F.try_element_at(first, F.lit(-1)), F.try_element_at(late, F.lit(1))
    out = F.when(last.isNotNull() & known(last), cell(last))
    if use_later:
        out = out.when(after.isNotNull() & known(after), cell(after))
    zero = F.struct(F.lit(0).cast("int").alias("home"), F.lit(0).cast("int").alias("away"))
    return out.when((ft_home == 0) & (ft_away == 0), zero)


def consistency(own: tuple[Column, Column], other: tuple[Column, Column], missing: tuple[str, str], same: str, differ: str) -> Column:
    """Whether two sources have one score; a missing one is said, the own first."""
    return F.when(own[0].isNull() | own[1].isNull(), missing[0]).when(other[0].isNull() | other[1].isNull(), missing[1]).when((own[0] == other[0]) & (own[1] == other[1]), same).otherwise(differ)


def readiness(link_status: Column, observed: Column, half_stats: Column) -> Column:
    """NO_LINK, NOT_OBSERVED, AVAILABLE or NO_HALFTIME."""
    linked = F.coalesce(F.upper(link_status).isin("EXACT", "HIGH_CONFIDENCE", "LINKED", "CONFIRMED"), F.lit(False))
    return F.when(~linked, "NO_LINK").when(~observed, "NOT_OBSERVED").when(half_stats, "AVAILABLE").otherwise("NO_HALFTIME")


def quality_flags(half_stats: Column, some_stats: Column, all_stats: Column, result: Column, half: Column) -> Column:
    cases = [(~half_stats, F.lit("HT_STATS_UNAVAILABLE")), (~some_stats, F.lit("STATS_UNAVAILABLE")), (some_stats & ~all_stats, F.lit("STATS_PARTIAL")), (result != "RESULT_MATCH", result), (half != "HT_MATCH", half)]
    return F.filter(F.array(*[F.when(cond, name) for cond, name in cases]), lambda x: x.isNotNull())


def crossed_slots(status: Column, period: Column, minute: Column, since_half: Column, finished: Column, delay: float = 45.0) -> Column:
    """The slots that one observation crosses, in order. ``since_half``: seconds since the half-time snapshot, null without."""
    s, p = F.lower(F.coalesce(status, F.lit(""))), F.replace(F.lower(F.coalesce(period, F.lit(""))), F.lit("_"), F.lit(""))
    second = p.isin("2h", "second half", "secondhalf") & minute.isNotNull()
    cases = [
        (s.isin("scheduled", "upcoming", "not started", "notstarted", "pre match"), "PRE_KICKOFF"), (p.isin("ht", "halftime", "half time", "1h"), "HALFTIME"), (second & F.coalesce(since_half >= delay, F.lit(False)), "HT_STABLE"),
        *[(F.coalesce(minute >= m, F.lit(False)), f"MINUTE_{m}") for m in (60, 70, 80)], (finished, "FINAL"),
    ]
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in cases]), lambda x: x.isNotNull())


def half_time_anchor(snapshots: DataFrame, current: DataFrame, states: DataFrame) -> DataFrame:
    """When each event was first seen at half time: its half-time snapshot, else the current state, else the first such state."""
    first = lambda df, name: df.groupBy("event_id").agg(F.min("at").alias(name))
    rows = first(snapshots, "_a").join(first(current, "_b"), "event_id", "full").join(first(states, "_c"), "event_id", "full")
    return rows.select("event_id", F.coalesce("_a", "_b", "_c").alias("anchor"))


def daily_metrics(events: DataFrame, snapshots: DataFrame, results: DataFrame, day: str) -> DataFrame:
    """One row of counts of a UTC day: events seen, snapshots by type, events with good ones, finished matches, standard
    snapshots per finished match. Half-open day ranges; one conditional pass per table."""
    begin = F.lit(day).cast("timestamp")
    within = lambda c: (F.col(c) >= begin) & (F.col(c) < begin + F.expr("INTERVAL 1 DAY"))
    good = F.coalesce(F.col("quality"), F.lit("")) != "FAILED"
    kind = F.col("snapshot_type")
    distinct = lambda cond: F.count_distinct(F.when(cond, F.col("event_id")))
    seen = events.where(within("first_seen") | within("last_seen")).agg(F.count_distinct("event_id").alias("events_seen"))
    today = within("observed_at")
    late = ("MINUTE_60", "MINUTE_70", "MINUTE_80", "MINUTE_85", "MINUTE_90")
    shots = snapshots.where(today).agg(
        *[count_if(kind == s).alias(f"n_{s.lower()}") for s in STANDARD], distinct(kind.isin("PREMATCH", "PRE_KICKOFF") & good).alias("events_with_prematch"), distinct((kind == "HALFTIME") & good).alias("events_with_halftime"),
        distinct(kind.isin(*late) & good).alias("events_with_core"), count_if(kind.isin(*STANDARD)).alias("standard"), count_if(~good).alias("failed"),
    )
    done = results.where(within("finished_at"))
    finished = done.agg(F.count("*").alias("finished"))
    theirs = snapshots.where(kind.isin(*STANDARD)).join(done.select("event_id"), "event_id").agg(F.count("*").alias("_standard"))
    row = seen.crossJoin(shots).crossJoin(finished).crossJoin(theirs)  # one row each
    return row.withColumn("standard_per_match", F.when(F.col("finished") > 0, F.col("_standard") / F.col("finished")).otherwise(0.0)).drop("_standard")


def last_minutes(shots: DataFrame, minute: str = "minute", now: str = "now", span: int = 15) -> DataFrame:
    """Per match and side: shots, shots on target and expected goals of the last ``span`` minutes, both ends included."""
    inside = shots.where((F.col(minute) >= F.greatest(F.lit(0), F.col(now) - span)) & (F.col(minute) <= F.col(now)))
    return inside.groupBy("match_id", "side").agg(F.count("*").alias("shots"), count_if("on_target").alias("on_target"), F.sum("xg").alias("xg"))


def strategy_candidates(experiments: DataFrame, least_rows: int = 30, least_folds: int = 2, most_error: float = 0.15) -> DataFrame:
    """Thresholds of completed experiments that have enough rows and folds and a small calibration error (unknown passes).

    ``experiments``: experiment_id, status, calibration_error, folds (array of P1 Brier scores), thresholds (array of struct
    max_p1, n, actual). Stability is the folds' standard deviation, of the population."""
    mean = F.aggregate("folds", F.lit(0.0), lambda a, x: a + x) / F.size("folds")
    spread = F.sqrt(F.aggregate("folds", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("folds"))
    rows = experiments.where("status = 'COMPLETED'").withColumn("folds", F.filter("folds", lambda x: x.isNotNull())).withColumn("_mean", mean)
    rows = rows.where((F.size("folds") >= least_folds) & (F.col("calibration_error").isNull() | (F.col("calibration_error") <= most_error)))
    rows = rows.withColumn("stability", spread).withColumn("t", F.explode("thresholds")).where(F.col("t.n") >= least_rows)
    candidate = F.concat(F.col("experiment_id").cast("string"), F.lit("_P1_LT_"), F.round(F.col("t.max_p1") * 1000).cast("int").cast("string"))
    return rows.select(candidate.alias("candidate_id"), "experiment_id", "t.max_p1", "t.n", "t.actual", "stability", F.size("folds").alias("fold_count"), "calibration_error")
