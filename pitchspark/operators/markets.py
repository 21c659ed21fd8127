"""Betting markets: canonical outcomes, equivalent quotes, the implied distribution, stakes and entry checks.

An *outcome* row has event_id, market_id, outcome_id, market_type, fixed_param, choice_param, caption, market_status,
outcome_status, is_available, odds and observed_at. An *event* row has event_id, period, clock, home_team, away_team,
score_home, score_away, ht_home, ht_away, extra_time and penalties. Flags that are null are unknown, which never counts as
"no". ``now`` is always an argument.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.functions.numbers import two_way_probability
from pitchspark.functions.text import fold_umlauts
from pitchspark.functions.times import seconds_between

# The provider's market types and choices, and what they mean.
FAMILIES = {
    "points-more-less-rest": "REMAINING_TOTAL",
    "points-more-less-rest-halftime": "REMAINING_TOTAL",
    "section-points-more-less": "REMAINING_TOTAL",
    "points-more-less": "MATCH_TOTAL",
    "points-more-less-than": "MATCH_TOTAL",
    "team-points-more-less": "TEAM_REMAINING",
    "team-points-more-less-halftime": "TEAM_REMAINING",
    "next-point": "NEXT_GOAL",
    "next-point-halftime": "NEXT_GOAL",
    "score-both": "BTTS",
    "standard-rest": "REST_1X2",
}
SCOPES = {"REMAINING_TOTAL": "REMAINING", "MATCH_TOTAL": "MATCH", "TEAM_REMAINING": "TEAM_REMAINING", "NEXT_GOAL": "REMAINING", "BTTS": "MATCH", "REST_1X2": "REMAINING"}
CHOICES = {
    "TOTAL": {"OVER": "+ over more greater o ueber above", "UNDER": "- under less lower u below unter"},
    "NEXT_GOAL": {"HOME": "1 home team1 heim 1st", "AWAY": "2 away team2 gast 2nd", "NONE": "x 0 none no-goal keines"},
    "BTTS": {"YES": "j ja yes y true 1", "NO": "n nein no false 0"},
    "REST_1X2": {"HOME": "1 home heim", "DRAW": "x draw unentschieden", "AWAY": "2 away gast"},
}
MORE_CHOICES = {"NEXT_GOAL": {"no goal": "NONE", "no next goal": "NONE", "kein tor": "NONE", "kein weiteres tor": "NONE"}}
SECOND_HALF = ("2", "second", "second half", "2nd")
BLOCKED = ("paused", "suspended", "stopped", "closed", "inactive")
HALF_TIME = ("HALF_TIME", "HALFTIME", "HT")
OVER_AGAIN = ("FINISHED", "FINAL", "ENDED", "NO_LONGER_LIVE", "CANCELLED", "ABORTED")
REGULATION = "REGULATION_NO_EXTRA_TIME"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _sides(kind: str) -> dict[str, str]:
    return {word: side for side, words in CHOICES[kind].items() for word in words.split()} | MORE_CHOICES.get(kind, {})


def _token(x: Column | str) -> Column:
    return F.coalesce(fold_umlauts(F.trim(F.col(x) if isinstance(x, str) else x)), F.lit(""))


def fixed_parts(x: Column | str) -> tuple[Column, Column]:
    """Selector before the first colon (null without one) and the last number after it, with a decimal comma or point."""
    text = F.trim(F.replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), F.lit(","), F.lit(".")))
    selector = F.trim(F.regexp_extract(text, r"^([^:]*):", 1))
    numbers = F.regexp_extract_all(F.regexp_replace(text, r"^[^:]*:", ""), F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?)"), 1)
    return F.when(selector != "", selector), F.try_element_at(numbers, F.lit(-1)).cast("double")


def is_half_time(period: Column, clock: Column) -> Column:
    return F.coalesce(F.upper(F.trim(period)).isin(*HALF_TIME), F.lit(False)) | F.coalesce(F.upper(F.trim(clock)) == "HZ", F.lit(False))


def canonical_outcomes(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """Outcomes with canonical_type (UNKNOWN where no rule fits), scope, market_period, side, line, team, settlement_scope,
    status, available and odds (null unless open and above one); one equality join with the events, all else columns."""
    kind = _token("market_type")
    choice = _token(F.when(F.coalesce("choice_param", F.lit("")) != "", F.col("choice_param")).otherwise(F.col("caption")))
    selector, number = fixed_parts("fixed_param")
    half = F.contains(kind, F.lit("halftime"))
    section = kind == "section-points-more-less"
    family = F.when(~section | _token(selector).isin(*SECOND_HALF), _lookup(FAMILIES, kind))
    totals = family.isin("REMAINING_TOTAL", "MATCH_TOTAL", "TEAM_REMAINING")
    side = F.when(totals, _lookup(_sides("TOTAL"), choice))
    for name in ("NEXT_GOAL", "BTTS", "REST_1X2"):
        side = side.when(family == name, _lookup(_sides(name), choice))
    known = side.isNotNull()
    remaining = F.when(half, "HALF_SPECIFIC").when((family == "REMAINING_TOTAL") & (section | is_half_time(F.col("period"), F.col("clock"))), "SECOND_HALF").otherwise("REGULATION_REMAINING")
    period = F.when(family.isin("MATCH_TOTAL", "BTTS"), "REGULATION").otherwise(remaining)
    own, caption = _token(selector), _token("market_caption")
    named = lambda team: (_token(team) != "") & F.contains(caption, _token(team))
    team = (
        F.when(own.isin("1", "home", "heim"), F.col("home_team")).when(own.isin("2", "away", "gast"), F.col("away_team"))
        .when(named("home_team"), F.col("home_team")).when(named("away_team"), F.col("away_team")).otherwise(selector)
    )
    states = [_token("outcome_status"), _token("market_status")]
    first_state = F.coalesce(*[F.when(s != "", s) for s in states], F.when(F.col("is_available"), "open").otherwise("unavailable"))
    usable = F.coalesce(F.col("is_available"), F.lit(False)) & ~states[1].isin(*BLOCKED) & F.coalesce(F.col("odds") > 1, F.lit(False))
    unknown = F.lit("UNKNOWN")
    return (
        outcomes.join(events, "event_id")
        .withColumns(
            {
                "canonical_type": F.when(known, F.concat_ws("_", family, side)).otherwise(unknown),
                "scope": F.when(known, _lookup(SCOPES, family)).otherwise(unknown),
                "market_period": F.when(known, period).otherwise(unknown),
                "side": side,
                "line": F.when(known & totals, number),
                "team": F.when(known & (family == "TEAM_REMAINING"), team),
                "settlement_scope": F.when(known & half, "FIRST_HALF_ONLY").when(known, REGULATION).otherwise(unknown),
                "status": first_state,
                "available": usable,
                "odds": F.when(usable, F.col("odds")),
            }
        )
    )


def scope_verified() -> Column:
    """Settled on regular time, with extra time and penalties both known to be excluded."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    return (F.col("settlement_scope") == REGULATION) & no("extra_time") & no("penalties")


def _near(line: float | Column, tolerance: float = 1e-9) -> Column:
    return F.coalesce(F.abs(F.col("line") - line) < tolerance, F.lit(False))


def _goals() -> Column:
    return F.col("score_home") + F.col("score_away")


def _targets() -> dict[str, Column]:
    """Whether an outcome stands for no further goal, or for two and more."""
    kind = F.col("canonical_type")
    return {
        "zero": ((kind == "REMAINING_TOTAL_UNDER") & _near(0.5)) | (kind == "NEXT_GOAL_NONE") | ((kind == "MATCH_TOTAL_UNDER") & _near(_goals() + 0.5)),
        "two": ((kind == "REMAINING_TOTAL_OVER") & _near(1.5)) | ((kind == "MATCH_TOTAL_OVER") & _near(_goals() + 1.5)),
    }


def _quote_state(now: Column, max_age: int) -> tuple[Column, Column]:
    """(open, fresh) of a canonical outcome."""
    fresh = F.greatest(F.lit(0.0), seconds_between(now, "observed_at")) <= max(1, max_age)
    is_open = F.col("available") & F.coalesce(F.col("odds") > 1, F.lit(False)) & ~F.lower("status").isin(*BLOCKED)
    return is_open, F.coalesce(fresh, F.lit(False))


def equivalents(canonical: DataFrame, now: Column, max_age: int = 10) -> DataFrame:
    """Per event and target (zero, two): status of the equivalence, status of its quotes, the best fresh open quote (odds,
    market_id, outcome_id), and how many other fresh open ones there are. One partly aggregated pass."""
    is_open, fresh = _quote_state(now, max_age)
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    cells = []
    for name, like in _targets().items():
        candidate = like & scope_verified()
        good = candidate & is_open & fresh
        quote = F.struct("odds", "market_id", "outcome_id")
        cells += [
            some(like).alias(f"{name}_like"), some(candidate).alias(f"{name}_candidate"), some(candidate & is_open & ~fresh).alias(f"{name}_stale"),
            F.max(F.when(good, quote)).alias(f"{name}_best"), F.count_if(good).alias(f"{name}_open"),
        ]
    out = canonical.groupBy("event_id").agg(*cells)
    for name in _targets():
        best = F.col(f"{name}_best")
        out = out.withColumns(
            {
                f"{name}_status": F.when(F.col(f"{name}_candidate"), "EQUIVALENT").when(F.col(f"{name}_like"), "EQUIVALENCE_UNVERIFIED").otherwise("MISSING_EQUIVALENT_MARKET"),
                f"{name}_quotes": F.when(~F.col(f"{name}_candidate"), F.lit(None)).when(best.isNotNull(), "OK").when(F.col(f"{name}_stale"), "STALE_QUOTES").otherwise("UNAVAILABLE_QUOTES"),
                f"q_{name}": best["odds"],
                f"{name}_market_id": best["market_id"],
                f"{name}_outcome_id": best["outcome_id"],
                f"{name}_alternatives": F.greatest(F.col(f"{name}_open") - 1, F.lit(0)),
            }
        )
    return out.select("event_id", *[c for n in _targets() for c in (f"{n}_status", f"{n}_quotes", f"q_{n}", f"{n}_market_id", f"{n}_outcome_id", f"{n}_alternatives")])


def distribution(canonical: DataFrame, now: Column, max_age: int = 10, match_fallback: bool = True) -> DataFrame:
    """Per event p0, p1, p2, p01 and ``distribution_status`` from under/over pairs of one market at the lines 0.5 and 1.5.

    Pairs of what remains come first, totals of the match second. A market counts with both sides; of several the highest
    sum of quotes wins, then the highest market id. Nothing is clamped. Aggregated by market, then by event: the second
    grouping needs no shuffle of its own beyond the first one's keys.
    """
    is_open, fresh = _quote_state(now, max_age)
    good = is_open & fresh & (F.col("settlement_scope") == REGULATION)
    lines = {"r05": ("REMAINING_TOTAL", F.lit(0.5)), "r15": ("REMAINING_TOTAL", F.lit(1.5)), "m05": ("MATCH_TOTAL", _goals() + 0.5), "m15": ("MATCH_TOTAL", _goals() + 1.5)}
    best = lambda kind, line: F.max(F.when(good & (F.col("canonical_type") == kind) & _near(line), F.col("odds")))
    sides = [best(f"{kind}_{side}", line).alias(f"{name}_{side}") for name, (kind, line) in lines.items() for side in ("UNDER", "OVER")]
    seen = F.col("canonical_type").isin("REMAINING_TOTAL_UNDER", "REMAINING_TOTAL_OVER") & (F.col("settlement_scope") == REGULATION) & (_near(0.5) | _near(1.5))
    facts = ["extra_time", "penalties", "score_home", "score_away"]
    markets = canonical.groupBy("event_id", "market_id").agg(*sides, F.max(seen).alias("_seen"), *[F.any_value(c).alias(c) for c in facts])
    pair = lambda n: F.max(F.when(F.col(f"{n}_UNDER").isNotNull() & F.col(f"{n}_OVER").isNotNull(), F.struct((F.col(f"{n}_UNDER") + F.col(f"{n}_OVER")).alias("sum"), "market_id", F.col(f"{n}_UNDER").alias("under"), F.col(f"{n}_OVER").alias("over"))))  # noqa: E731, E501
    out = markets.groupBy("event_id").agg(*[pair(n).alias(n) for n in lines], F.max("_seen").alias("_seen"), *[F.any_value(c).alias(c) for c in facts])
    zero = F.coalesce("r05", "m05") if match_fallback else F.col("r05")
    one = F.coalesce("r15", "m15") if match_fallback else F.col("r15")
    out = out.withColumn("_zero", zero).withColumn("_one", one)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    blocked = (
        F.when(~(no("extra_time") & no("penalties")), "UNVERIFIED_SETTLEMENT_SCOPE")
        .when(F.col("score_home").isNull() | F.col("score_away").isNull(), "MISSING_SCORE")
        .when(F.col("_zero").isNull() | F.col("_one").isNull(), F.when(F.col("_seen"), "STALE_OR_MISSING_MARKETS").otherwise("MISSING_MARKETS"))
    )
    p = lambda c: F.when(blocked.isNull(), two_way_probability(F.col(f"{c}.under"), F.col(f"{c}.over")))
    out = out.withColumn("p0", p("_zero")).withColumn("p01", p("_one"))
    out = out.withColumn("p1", F.col("p01") - F.col("p0")).withColumn("p2", 1 - F.col("p01"))
    outside = F.lit(False)
    for c in ("p0", "p1", "p2"):
        outside = outside | (F.col(c) < 0) | (F.col(c) > 1)
    status = F.coalesce(blocked, F.when(F.col("p0").isNull() | F.col("p01").isNull(), "INVALID_ODDS").when(outside, "INCONSISTENT_MARKETS").otherwise("OK"))
    return out.select("event_id", status.alias("distribution_status"), "p0", "p1", "p2", "p01", F.col("r05").isNull().alias("zero_fallback"), F.col("r15").isNull().alias("one_fallback"))


def covered_stakes(q_zero: Column, q_two: Column, stake: float, p1: Column) -> Column:
    """Struct of the split of ``stake`` over two quotes that makes the payouts most equal in cents: status, label, stakes,
    payouts, payout before rounding, profit, return, break-even and buffer. Cents round half up.

    Of the nearest cent and its two neighbours the one with the smallest difference of payouts wins, then the nearest to
    the exact stake, then the smallest. All in whole cents.
    """
    cents = int((Decimal(str(stake)) * 100).quantize(Decimal(1), ROUND_HALF_UP))
    kind, quote = ("long", "long") if abs(cents) <= 900_000_000 else ("decimal(13,0)", "decimal(11,0)")  # 64 bits hold a product
    total = F.lit(cents).cast(kind)
    money = lambda x, to="decimal(14,2)": (x.cast("decimal(16,0)") * F.lit(0.01).cast("decimal(4,2)")).cast(to)
    paid = lambda x, q: F.call_function("div", x * q + 5000, F.lit(10_000).cast(quote))

    def choose(v: Column) -> Column:
        options = []
        for k in (-1, 0, 1):
            own = (v["base"] + k).cast(kind)
            zero, two = paid(own, v["a"]), paid(total - own, v["b"])
            cells = F.struct(F.abs(zero - two).alias("gap"), F.abs(own.cast("double") / 100 - v["exact"]).alias("far"), F.lit(k).alias("k"), own.alias("zero"), (total - own).alias("two"), zero.alias("payout_zero"), two.alias("payout_two"))
            options.append(F.when(v["known"] & own.between(0, total), cells))
        return F.struct(F.least(*options).alias("best"), v.alias("v"))  # of those that aren't null

    def shown(found: Column) -> Column:
        best, v = found["best"], found["v"]
        known, back, before = v["known"], v["back"], v["before"]
        most = 1 - back
        status = F.when(~known, "MISSING_QUOTES").when(back < 1, "OK").otherwise("NO_POSITIVE_COVERED_PAYOUT")
        label = (
            F.when(~known, "INCOMPLETE").when(back >= 1, "UNATTRACTIVE").when(p1.isNull(), "NEUTRAL")
            .when(p1 > most, "UNATTRACTIVE").when(most - p1 < 0.03, "NEUTRAL").otherwise("INTERESTING")
        )
        return F.struct(
            status.alias("status"),
            label.alias("label"),
            *[money(best[c]).alias(n) for c, n in (("zero", "stake_zero"), ("two", "stake_two"), ("payout_zero", "payout_zero"), ("payout_two", "payout_two"))],
            money(best["gap"], "decimal(15,2)").alias("payout_difference"),
            F.when(known, before).alias("payout_before_rounding"),
            F.when(known, before - stake).alias("covered_profit"),
            F.when(known, (before - stake) / stake).alias("win_roi"),
            F.when(known, most).alias("p1_max"),
            F.when(known, most - p1).alias("p1_buffer"),
        )

    def with_base(v: Column) -> Column:
        whole = lambda q: (q * 10_000).cast(quote)  # noqa: E731  ten-thousandths
        exact = v["before"] / v["a"].cast("double")
        return F.struct(
            v["known"].alias("known"), v["back"].alias("back"), v["before"].alias("before"), exact.alias("exact"), (F.round(exact.cast("decimal(20,8)"), 2) * 100).cast(kind).alias("base"), whole(v["a"]).alias("a"), whole(v["b"]).alias("b")
        )

    def with_back(v: Column) -> Column:
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), v["known"].alias("known"), v["back"].alias("back"), (F.lit(float(stake)) / v["back"]).alias("before"))

    def with_known(v: Column) -> Column:
        known = F.coalesce((v["a"] > 1) & (v["b"] > 1), F.lit(False))
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), known.alias("known"), (1 / v["a"].cast("double") + 1 / v["b"].cast("double")).alias("back"))

    quotes = F.struct(q_zero.cast("decimal(10,4)").alias("a"), q_two.cast("decimal(10,4)").alias("b"))
    return bound(quotes, with_known, with_back, with_base, choose, shown)


def bound(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """``value`` through steps that may use what they get many times: it is evaluated once and stands in the plan once."""
    for step in steps:
        value = F.get(F.transform(F.array(value), step), F.lit(0))
    return value


def analysis(outcomes: DataFrame, events: DataFrame, now: Column, max_age: int = 10, stake: float = 30.0) -> DataFrame:
    """The whole chain per event: canonical outcomes, equivalent quotes, distribution, stakes, counts of known and unknown
    outcomes. Events without outcomes have none."""
    canonical = canonical_outcomes(outcomes, events)
    counts = canonical.groupBy("event_id").agg(F.count_if(F.col("canonical_type") != "UNKNOWN").alias("known"), F.count_if(F.col("canonical_type") == "UNKNOWN").alias("unknown"))
    both = equivalents(canonical, now, max_age).join(distribution(canonical, now, max_age), "event_id").join(counts, "event_id")
    p1 = F.when(F.col("distribution_status") == "OK", F.col("p1"))
    split = covered_stakes(F.col("q_zero"), F.col("q_two"), stake, p1)
    out = both.withColumn("_split", split)
    state = F.when(F.col("distribution_status") == "OK", F.col("_split.status")).otherwise(F.concat(F.lit("BLOCKED_"), F.col("distribution_status")))
    return out.select(*both.columns, F.col("_split.*"), state.alias("evaluation_status"))


def expected_value(p0: Column, p2: Column, payout_zero: Column, payout_two: Column, stake: float) -> Column:
    return p0 * payout_zero + p2 * payout_two - stake


def display_verdict(row_scope: Column, quotes_ok: Column, stale: Column, status: Column, probability_ok: Column, buffer: Column) -> Column:
    """The first that holds: what a reader of an analysis should know before its numbers."""
    return (
        F.when(~row_scope, "SCOPE_UNCLEAR").when(~quotes_ok, "QUOTES_MISSING").when(stale, "QUOTES_STALE").when(status != "OK", "NO_POSITIVE_CASE")
        .when(~probability_ok, "STRUCTURE_ONLY").when(buffer > 0, "POSITIVE_BUFFER").otherwise("NO_ADVANTAGE")
    )


def entry_check(now: Column, max_age: int) -> Column:
    """First reason against an entry, or OK. Columns: those of an event, observed_at (null if it has no offset), and for
    each of zero and two a struct quote with event_id, observed_at, market_id, outcome_id, odds, settlement_scope,
    available, status, canonical_type and line."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    scores = [F.col(c) for c in ("score_home", "score_away", "ht_home", "ht_away")]
    missing = F.lit(False)
    for s in scores:
        missing = missing | s.isNull() | (s < 0)
    half = is_half_time(F.col("period"), F.col("clock")) & ~F.coalesce(F.upper("status").isin(*OVER_AGAIN), F.lit(False))
    age = seconds_between(now, "observed_at")
    ladder = (
        F.when(~half, "NOT_HALFTIME").when(~(no("extra_time") & no("penalties")), "SETTLEMENT_SCOPE_UNKNOWN").when(missing, "HALFTIME_SCORE_MISSING")
        .when((scores[0] != scores[2]) | (scores[1] != scores[3]), "HALFTIME_SCORE_CONFLICT").when(age.isNull(), "QUOTE_AGE_UNKNOWN")
        .when(age < 0, "OBSERVATION_FROM_FUTURE").when(age > max_age, "QUOTE_TOO_OLD")
    )
    for name, direction, line in (("zero", "UNDER", 0.5), ("two", "OVER", 1.5)):
        q = lambda c: F.col(f"{name}.{c}")  # noqa: B023, E731
        empty = lambda c: F.coalesce(q(c).cast("string"), F.lit("")) == ""  # noqa: B023, E731
        fits = ((q("canonical_type") == f"REMAINING_TOTAL_{direction}") & (q("line") == line)) | ((q("canonical_type") == f"MATCH_TOTAL_{direction}") & (q("line") == scores[0] + scores[1] + line))
        if name == "zero":
            fits = fits | (q("canonical_type") == "NEXT_GOAL_NONE")
        ladder = (
            ladder.when(F.col(name).isNull(), "MISSING_QUOTES").when(~(q("event_id").eqNullSafe(F.col("event_id")) & q("observed_at").eqNullSafe(F.col("observed_at"))), "QUOTE_SNAPSHOT_MISMATCH")
            .when(empty("market_id") | empty("outcome_id"), "QUOTE_ID_MISSING").when(~F.coalesce(q("odds") > 1, F.lit(False)), "INVALID_ODDS")
            .when(~q("settlement_scope").eqNullSafe(F.lit(REGULATION)), "SETTLEMENT_SCOPE_UNKNOWN")
            .when(~F.coalesce(q("available"), F.lit(False)) | F.coalesce(F.lower(q("status")).isin(*BLOCKED), F.lit(False)), "MARKET_NOT_OPEN")
            .when(~F.coalesce(fits, F.lit(False)), "MARKET_SEMANTICS_MISMATCH")
        )
    return ladder.otherwise("OK")


def signals(evaluations: DataFrame, portfolios: DataFrame) -> DataFrame:
    """Every evaluation for every portfolio with the first reason against it (SIGNAL_ACCEPTED without one). Limits are strict,
    so a value at a limit passes. ``portfolios`` is a table of settings, checked to be small."""
    count = portfolios.count()
    if count > 10_000:
        raise ValueError(f"{count} portfolios: this table holds settings and is broadcast")
    c = F.col
    below = lambda value, least: value.isNull() | (value < least)
    market = c("family") == "MARKET_ONLY"
    reason = (
        F.when(c("strategy") != "ZERO_OR_2PLUS", "UNSUPPORTED_STRATEGY").when(~c("family").isin("MARKET_ONLY", "MARKET_STRUCTURE"), "UNSUPPORTED_FAMILY")
        .when(F.upper(F.coalesce("status", F.lit("UNKNOWN"))) != "OK", F.concat(F.lit("EVALUATION_"), F.upper(F.coalesce("status", F.lit("UNKNOWN")))))
        .when(below(c("q_zero"), c("min_q_zero")), "MINIMUM_Q_ZERO_NOT_MET").when(below(c("q_two"), c("min_q_two")), "MINIMUM_Q_TWO_PLUS_NOT_MET")
        .when(below(c("win_roi"), c("min_win_roi")), "MINIMUM_WIN_ROI_NOT_MET").when(c("p1_max") < c("min_break_even"), "BREAK_EVEN_BELOW_THRESHOLD")
        .when(market & (c("p1_buffer").isNull() | c("p1").isNull()), "MARKET_PROBABILITY_UNAVAILABLE").when(market & (c("p1_buffer") < c("min_buffer")), "MINIMUM_P1_BUFFER_NOT_MET")
        .when(market & (c("p1") > c("max_p1")), "MAXIMUM_P1_EXCEEDED").when(c("age_zero").isNull() | c("age_two").isNull(), "QUOTE_AGE_UNKNOWN")
        .when((c("age_zero") > c("max_age")) | (c("age_two") > c("max_age")), "QUOTE_TOO_OLD").otherwise("SIGNAL_ACCEPTED")
    )
    return evaluations.crossJoin(F.broadcast(portfolios)).withColumn("reason", reason)


def strategy_projection(snapshots: DataFrame) -> DataFrame:
    """The archive's projection of snapshots: first known of each pair of names, and what both cases pay at least (null
    unless both are known)."""
    first = {
        "event_id": ("provider_event_id", "event_id"), "q_zero": ("q0_best", "q_zero_best"), "q_two": ("q2_plus_best", "q_two_plus_best"), "p0": ("market_p0", "p0_market"),
        "p1": ("market_p1", "p1_market"), "p2": ("market_p2_plus", "p2plus_market"),
    }
    have = set(snapshots.columns)
    pick = lambda names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    both = F.when(F.col("payout_zero").isNotNull() & F.col("payout_two").isNotNull(), F.least("payout_zero", "payout_two"))
    stored = [F.col("covered_payout")] if "covered_payout" in have else []
    rest = [c for c in ("snapshot_id", "snapshot_type", "captured_at", "strategy_status", "payout_zero", "payout_two") if c in have]
    return snapshots.select(*[pick(v).alias(k) for k, v in first.items()], *rest, F.coalesce(*stored, both).alias("covered_payout"))


def feed_plausible(documents: DataFrame, parsed: DataFrame, active: DataFrame, sport: str = "soccer", allow_reconciliation: bool = False) -> DataFrame:
    """Per batch the first reason why its feed can't be trusted, or null.

    ``documents``: batch_id, has_events, has_index (the feed has its maps), indexed (array of ids of ``sport``, null if the
    index lacks it), event_ids (array of the map's keys). ``parsed``: batch_id, event_id. ``active``: batch_id, n of events
    that were active before. Sets are compared by counts after an anti join, so no list of all ids has to fit a row."""
    known = parsed.select("batch_id", "event_id").distinct()
    listed = documents.select("batch_id", F.explode("indexed").alias("event_id")).where("event_id IS NOT NULL").distinct()
    mapped = documents.select("batch_id", F.explode("event_ids").alias("event_id")).distinct()
    count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    out = documents.select("batch_id", "has_events", "has_index", F.col("indexed").isNotNull().alias("_bucket"))
    pieces = {
        "_listed": listed, "_unmapped": listed.join(mapped, ["batch_id", "event_id"], "left_anti"), "_unparsed": listed.join(known, ["batch_id", "event_id"], "left_anti"),
        "_parsed": known, "_mapped": mapped,
    }
    for name, df in pieces.items():
        out = out.join(count(df, name), "batch_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.join(active.select("batch_id", F.col("n").alias("_active")), "batch_id", "left").withColumn("_active", F.coalesce("_active", F.lit(0)))
    c, strict = F.col, F.lit(not allow_reconciliation)
    reason = (
        F.when(~c("has_events"), "EVENTS_MISSING").when(~c("has_index"), "INDEX_MISSING").when(~c("_bucket") & (c("_active") > 0) & strict, "SPORT_MISSING_WITH_ACTIVE_EVENTS")
        .when(c("_unmapped") > 0, "INDEX_WITHOUT_EVENT").when((c("_mapped") > 0) & c("_bucket") & (c("_listed") == 0) & (c("_parsed") > 0), "EVENTS_WITHOUT_INDEX")
        .when(c("_unparsed") > 0, "EVENT_NOT_PARSED").when((c("_active") > 0) & (c("_parsed") == 0) & strict, "EMPTY_WITH_ACTIVE_EVENTS")
        .when((c("_active") >= 20) & (c("_parsed") < F.greatest(F.lit(1), F.floor(c("_active") / 10))) & strict, "COUNT_COLLAPSED")
    )
    return out.select("batch_id", reason.alias("reason"), reason.isNull().alias("plausible"))


#: Fixed value: competitions of youth, reserves and friendlies.
EXCLUDED_COMPETITION = r"(^|[^a-z0-9])(u[ -]?(17|18|19|20|21|23)|youth|academy|junior(en)?|reserves?|b[ -]?team|ii[ -]?team|club friendly|club friendlies|vereins[ -]?freundschaft|freundschaftsspiele?)($|[^a-z0-9])"


def universe_priority(selected: Column, label: Column, coverage: Column, market: Column) -> Column:
    """P0 to P4 of an event: chosen by hand, strategy, discovery, minimal, ignored. ``label`` is a folded competition name;
    unknown coverage or market means discovery."""
    coverage, market = F.coalesce(coverage, F.lit("DISCOVERY")), F.coalesce(market, F.lit("DISCOVERY"))
    return (
        F.when(selected, "P0_SELECTED").when(F.coalesce(label.rlike(EXCLUDED_COMPETITION), F.lit(False)), "P4_IGNORE")
        .when((coverage == "FULL") & (market == "SUITABLE"), "P1_STRATEGY_ELIGIBLE").when((coverage == "DISCOVERY") | (market == "DISCOVERY"), "P2_DISCOVERY").otherwise("P3_MINIMAL")
    )
