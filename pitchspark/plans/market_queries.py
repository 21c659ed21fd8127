"""Market queries. Orders stand for events and order lines for markets with two outcomes each."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchspark.operators import joins, markets
from pitchspark.plans.registry import query
from pitchspark.staging import keyed

_NOW = "2024-01-01 00:00:00"

_EVENTS = """e AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'HALF_TIME' ELSE 'SECOND_HALF' END AS period, CASE WHEN o_custkey % 5 = 0 THEN 'HZ' ELSE '60' END AS clock,
'Team ' || o_custkey AS home_team, 'Side ' || o_orderkey AS away_team, CASE WHEN o_custkey % 50 <> 0 THEN o_orderkey % 3 END AS score_home, o_custkey % 2 AS score_away,
o_orderkey % 3 AS ht_home, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE o_custkey % 2 END AS ht_away, CASE WHEN o_orderstatus <> 'P' THEN false END AS extra_time, o_custkey % 20 = 0 AS penalties FROM orders)"""
_OUTCOMES = """o AS (SELECT l_orderkey AS event_id, l_linenumber || '-' || l_suppkey || '-' || l_partkey AS market_id, s AS outcome_id,
CASE l_partkey % 6 WHEN 3 THEN 'points-more-less' WHEN 4 THEN 'next-point' WHEN 5 THEN 'score-both' ELSE 'points-more-less-rest' END AS market_type,
CASE l_suppkey % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1.5' WHEN 2 THEN '2,5' ELSE 'Team:1.5' END AS fixed_param,
CASE WHEN l_partkey % 6 = 4 THEN CASE s WHEN '+' THEN '1' ELSE 'kein Tor' END WHEN l_partkey % 6 = 5 THEN CASE s WHEN '+' THEN 'Ja' END ELSE CASE s WHEN '+' THEN 'Über' ELSE '-' END END AS choice_param,
'Nein' AS caption, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'Paused' ELSE 'open' END AS market_status, l_linestatus <> 'O' OR l_quantity > 10 AS is_available,
CASE s WHEN '+' THEN round(1 + l_discount * 30 + l_tax, 4) ELSE round(1.2 + l_tax * 20 + l_discount, 4) END AS odds, TIMESTAMP '2024-01-01' - to_seconds(l_suppkey % 14) AS observed_at FROM lineitem, (VALUES ('+'), ('-')) v(s))"""
_CANONICAL = f"""{_EVENTS}, {_OUTCOMES}, k AS (SELECT o.* EXCLUDE (odds), e.* EXCLUDE (event_id),
CASE WHEN market_type LIKE 'points%' THEN CASE choice_param WHEN 'Über' THEN 'OVER' ELSE 'UNDER' END WHEN market_type = 'next-point' THEN CASE choice_param WHEN '1' THEN 'HOME' ELSE 'NONE' END ELSE CASE WHEN choice_param = 'Ja' THEN 'YES' ELSE 'NO' END END AS side,
CASE market_type WHEN 'points-more-less-rest' THEN 'REMAINING_TOTAL' WHEN 'points-more-less' THEN 'MATCH_TOTAL' WHEN 'next-point' THEN 'NEXT_GOAL' ELSE 'BTTS' END || '_' || side AS canonical_type,
CASE WHEN market_type LIKE 'points%' THEN CASE l WHEN '0.5' THEN 0.5::DOUBLE WHEN '2,5' THEN 2.5 ELSE 1.5 END END AS line,
CASE WHEN market_type IN ('points-more-less', 'score-both') THEN 'REGULATION' WHEN market_type = 'points-more-less-rest' AND (period = 'HALF_TIME' OR clock = 'HZ') THEN 'SECOND_HALF' ELSE 'REGULATION_REMAINING' END AS market_period,
is_available AND market_status = 'open' AND odds > 1 AS available, CASE WHEN available THEN odds END AS odds FROM (SELECT *, fixed_param AS l FROM o) o JOIN e USING (event_id)),
f AS (SELECT *, available AND epoch(TIMESTAMP '2024-01-01') - epoch(observed_at) <= 10 AS good, extra_time IS FALSE AND penalties IS FALSE AS safe, score_home + score_away AS goals FROM k)"""


def proxy_events(t):
    c, key = F.col, F.col("o_orderkey")
    return t.orders.select(
        key.alias("event_id"), F.when(key % 2 == 0, "HALF_TIME").otherwise("SECOND_HALF").alias("period"), F.when(c("o_custkey") % 5 == 0, "HZ").otherwise("60").alias("clock"),
        F.concat(F.lit("Team "), c("o_custkey").cast("string")).alias("home_team"), F.concat(F.lit("Side "), key.cast("string")).alias("away_team"),
        F.when(c("o_custkey") % 50 != 0, key % 3).alias("score_home"), (c("o_custkey") % 2).alias("score_away"), (key % 3).alias("ht_home"),
        F.when(key % 11 == 0, 1).otherwise(c("o_custkey") % 2).alias("ht_away"), F.when(c("o_orderstatus") != "P", False).alias("extra_time"), (c("o_custkey") % 20 == 0).alias("penalties"),
    )


def proxy_outcomes(t):
    c = F.col
    plus, part = c("outcome_id") == "+", c("l_partkey") % 6
    lines = keyed(t.lineitem, "l_orderkey").withColumn("outcome_id", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return lines.select(
        c("l_orderkey").alias("event_id"), F.concat_ws("-", "l_linenumber", "l_suppkey", "l_partkey").alias("market_id"), "outcome_id",
        F.when(part == 3, "points-more-less").when(part == 4, "next-point").when(part == 5, "score-both").otherwise("points-more-less-rest").alias("market_type"),
        F.when(c("l_suppkey") % 4 == 0, "0.5").when(c("l_suppkey") % 4 == 1, "1.5").when(c("l_suppkey") % 4 == 2, "2,5").otherwise("Team:1.5").alias("fixed_param"),
        F.when(part == 4, F.when(plus, "1").otherwise("kein Tor")).when(part == 5, F.when(plus, "Ja")).otherwise(F.when(plus, "Über").otherwise("-")).alias("choice_param"),
        F.lit("Nein").alias("caption"), F.lit("Total").alias("market_caption"), F.lit(None).cast("string").alias("outcome_status"),
        F.when((c("l_returnflag") == "A") & (c("l_linenumber") == 1), "Paused").otherwise("open").alias("market_status"),
        ((c("l_linestatus") != "O") | (c("l_quantity") > 10)).alias("is_available"),
        F.when(plus, F.round(1 + c("l_discount") * 30 + c("l_tax"), 4)).otherwise(F.round(1.2 + c("l_tax") * 20 + c("l_discount"), 4)).alias("odds"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(_NOW).cast("timestamp")) - c("l_suppkey") % 14).alias("observed_at"),
    )


def _now():
    return F.lit(_NOW).cast("timestamp")


def _canonical(t):
    return markets.canonical_outcomes(proxy_outcomes(t), proxy_events(t))


@query(
    "p02_canonical_outcomes",
    f"WITH {_CANONICAL} SELECT event_id, market_id, outcome_id, canonical_type, market_period, side, line, available, odds FROM k",
)
def p02_canonical_outcomes(t):
    return _canonical(t).select("event_id", "market_id", "outcome_id", "canonical_type", "market_period", "side", "line", "available", "odds")


@query("p03_scope_verified", f"WITH {_CANONICAL} SELECT canonical_type, count(*) AS n, sum(safe::INT)::BIGINT AS verified FROM f GROUP BY 1")
def p03_scope_verified(t):
    return _canonical(t).groupBy("canonical_type").agg(F.count("*").alias("n"), F.count_if(markets.scope_verified()).alias("verified"))


_LIKE = """CASE WHEN canonical_type = 'REMAINING_TOTAL_UNDER' AND line = 0.5 OR canonical_type = 'NEXT_GOAL_NONE' OR canonical_type = 'MATCH_TOTAL_UNDER' AND line = goals + 0.5 THEN 'zero'
WHEN canonical_type = 'REMAINING_TOTAL_OVER' AND line = 1.5 OR canonical_type = 'MATCH_TOTAL_OVER' AND line = goals + 1.5 THEN 'two' END"""
_EQUIVALENT = f"""x AS (SELECT *, {_LIKE} AS target FROM f), q AS (SELECT event_id, {', '.join(f"""bool_or(coalesce(target = '{n}', false)) AS {n}_l, bool_or(coalesce(target = '{n}' AND safe, false)) AS {n}_c, bool_or(coalesce(target = '{n}' AND safe AND available AND NOT good, false)) AS {n}_s,
max(CASE WHEN target = '{n}' AND safe AND good THEN {{'o': odds, 'm': market_id, 'i': outcome_id}} END) AS {n}_b""" for n in ('zero', 'two'))} FROM x GROUP BY 1),
d01 AS (SELECT event_id, {', '.join(f"""CASE WHEN {n}_c THEN 'EQUIVALENT' WHEN {n}_l THEN 'EQUIVALENCE_UNVERIFIED' ELSE 'MISSING_EQUIVALENT_MARKET' END AS {n}_status, CASE WHEN NOT {n}_c THEN NULL WHEN {n}_b IS NOT NULL THEN 'OK' WHEN {n}_s THEN 'STALE_QUOTES' ELSE 'UNAVAILABLE_QUOTES' END AS {n}_quotes,
{n}_b.o AS q_{n}, {n}_b.m AS {n}_market_id""" for n in ('zero', 'two'))} FROM q)"""
_D01 = ["event_id", *[f"{n}_{c}" for n in ("zero", "two") for c in ("status", "quotes", "market_id")], "q_zero", "q_two"]


@query("d01_equivalence", f"WITH {_CANONICAL}, {_EQUIVALENT} SELECT {', '.join(_D01)} FROM d01")
def d01_equivalence(t):
    return markets.equivalents(_canonical(t), _now()).select(*_D01)


_PAIRS = """r AS (SELECT event_id, market_id, CASE WHEN canonical_type LIKE 'REM%' THEN 'r' ELSE 'm' END || CASE WHEN line = CASE WHEN canonical_type LIKE 'REM%' THEN 0 ELSE goals END + 0.5 THEN '05' WHEN line = CASE WHEN canonical_type LIKE 'REM%' THEN 0 ELSE goals END + 1.5 THEN '15' END AS kind,
max(CASE WHEN side = 'UNDER' AND good THEN odds END) AS u, max(CASE WHEN side = 'OVER' AND good THEN odds END) AS v FROM f WHERE canonical_type LIKE '%TOTAL%' GROUP BY ALL),
b AS (SELECT event_id, kind, max(CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN {'s': u + v, 'm': market_id, 'u': u, 'v': v} END) AS p FROM r WHERE kind IS NOT NULL GROUP BY ALL),
w AS (SELECT g.event_id, safe, goals, seen, coalesce(max(CASE WHEN kind = 'r05' THEN p END), max(CASE WHEN kind = 'm05' THEN p END)) AS z, coalesce(max(CASE WHEN kind = 'r15' THEN p END), max(CASE WHEN kind = 'm15' THEN p END)) AS y
FROM (SELECT event_id, bool_and(safe) AS safe, min(goals) AS goals, bool_or(canonical_type LIKE 'REM%' AND line IN (0.5, 1.5)) AS seen FROM f GROUP BY 1) g LEFT JOIN b ON b.event_id = g.event_id GROUP BY ALL),
d02 AS (SELECT event_id, (1 / z.u) / (1 / z.u + 1 / z.v) AS a, (1 / y.u) / (1 / y.u + 1 / y.v) AS c, CASE WHEN NOT safe THEN 'UNVERIFIED_SETTLEMENT_SCOPE' WHEN goals IS NULL THEN 'MISSING_SCORE' WHEN a IS NULL OR c IS NULL THEN CASE WHEN seen THEN 'STALE_OR_MISSING_MARKETS' ELSE 'MISSING_MARKETS' END
WHEN c < a THEN 'INCONSISTENT_MARKETS' ELSE 'OK' END AS distribution_status, CASE WHEN distribution_status IN ('OK', 'INCONSISTENT_MARKETS') THEN a END AS p0, CASE WHEN p0 IS NOT NULL THEN c END AS p01 FROM w)"""


@query("d02_distribution", f"WITH {_CANONICAL}, {_PAIRS} SELECT event_id, distribution_status, round(p0, 8) AS p0, round(p01 - p0, 8) AS p1, round(1 - p01, 8) AS p2 FROM d02")
def d02_distribution(t):
    found = markets.distribution(_canonical(t), _now())
    return found.select("event_id", "distribution_status", *[F.round(c, 8).alias(c) for c in ("p0", "p1", "p2")])




def split_sql(source: str, stake: str, keep: str) -> str:
    """SQL of the stakes on q_zero and q_two of ``source``: the three cents, the best by payouts, then distance, then order."""
    return f"""SELECT {keep}, arg_min(s, (gap, far, k)) AS stake_zero, arg_min(t - s, (gap, far, k)) AS stake_two, arg_min(round(s * a, 2), (gap, far, k)) AS payout_zero, arg_min(round((t - s) * b, 2), (gap, far, k)) AS payout_two, any_value(back) AS back
FROM (SELECT *, abs(round(s * a, 2) - round((t - s) * b, 2)) AS gap, abs(s::DOUBLE - exact) AS far FROM (SELECT *, (round(exact::DECIMAL(20,8), 2) + k * 0.01)::DECIMAL(14,2) AS s FROM (SELECT *, {stake}::DECIMAL(12,2) AS t, q_zero::DECIMAL(10,4) AS a, q_two::DECIMAL(10,4) AS b,
1 / q_zero::DECIMAL(10,4)::DOUBLE + 1 / q_two::DECIMAL(10,4)::DOUBLE AS back, {stake} / (1 / q_zero::DECIMAL(10,4)::DOUBLE + 1 / q_two::DECIMAL(10,4)::DOUBLE) / q_zero::DECIMAL(10,4)::DOUBLE AS exact FROM {source}), (VALUES (-1), (0), (1)) v(k)) WHERE s BETWEEN 0 AND t) GROUP BY {keep}"""


@query(
    "d05_market_analysis",
    f"""WITH {_CANONICAL}, {_EQUIVALENT}, {_PAIRS}, s AS ({split_sql("(SELECT * FROM d01 WHERE q_zero > 1 AND q_two > 1)", "30.0", "event_id")}), n AS (SELECT event_id, count(*) AS known FROM k GROUP BY 1)
SELECT d01.event_id, zero_status, two_status, distribution_status, known, 0::BIGINT AS unknown, CASE WHEN back IS NULL THEN 'MISSING_QUOTES' WHEN back < 1 THEN 'OK' ELSE 'NO_POSITIVE_COVERED_PAYOUT' END AS status,
CASE WHEN back IS NULL THEN 'INCOMPLETE' WHEN back >= 1 THEN 'UNATTRACTIVE' WHEN distribution_status <> 'OK' THEN 'NEUTRAL' WHEN p01 - p0 > 1 - back THEN 'UNATTRACTIVE' WHEN 1 - back - (p01 - p0) < 0.03 THEN 'NEUTRAL' ELSE 'INTERESTING' END AS label,
stake_zero::DOUBLE AS stake_zero, stake_two::DOUBLE AS stake_two, payout_zero::DOUBLE AS payout_zero, payout_two::DOUBLE AS payout_two, round(30 / back - 30, 6) AS covered_profit, round(1 - back, 8) AS p1_max,
CASE WHEN distribution_status <> 'OK' THEN 'BLOCKED_' || distribution_status WHEN back IS NULL THEN 'MISSING_QUOTES' WHEN back < 1 THEN 'OK' ELSE 'NO_POSITIVE_COVERED_PAYOUT' END AS evaluation_status
FROM d01 JOIN d02 USING (event_id) JOIN n USING (event_id) LEFT JOIN s USING (event_id)""",
)
def d05_market_analysis(t):
    found = markets.analysis(proxy_outcomes(t), proxy_events(t), _now())
    money = [F.col(c).cast("double").alias(c) for c in ("stake_zero", "stake_two", "payout_zero", "payout_two")]
    return found.select(
        "event_id", "zero_status", "two_status", "distribution_status", "known", "unknown", "status", "label", *money, F.round("covered_profit", 6).alias("covered_profit"), F.round("p1_max", 8).alias("p1_max"), "evaluation_status"
    )


@query(
    "d18_display_summary",
    f"""WITH {_CANONICAL}, {_EQUIVALENT}, {_PAIRS}, s AS ({split_sql("(SELECT * FROM d01 WHERE q_zero > 1 AND q_two > 1)", "20.0", "event_id")}), a AS (SELECT *, 1 - back - (p01 - p0) AS buffer, distribution_status = 'OK' AS ok FROM d01 JOIN d02 USING (event_id) JOIN e USING (event_id) LEFT JOIN s USING (event_id))
SELECT event_id, round(CASE WHEN ok THEN p0 * payout_zero::DOUBLE + (1 - p01) * payout_two::DOUBLE - 20 END, 6) AS ev, CASE WHEN NOT (extra_time IS FALSE AND penalties IS FALSE) THEN 'SCOPE_UNCLEAR' WHEN back IS NULL THEN 'QUOTES_MISSING' WHEN back >= 1 THEN 'NO_POSITIVE_CASE' WHEN NOT ok THEN 'STRUCTURE_ONLY' WHEN buffer > 0 THEN 'POSITIVE_BUFFER' ELSE 'NO_ADVANTAGE' END AS verdict FROM a""",
)
def d18_display_summary(t):
    """Quotes here are fresh by selection, so none of the rows is stale."""
    a = markets.analysis(proxy_outcomes(t), proxy_events(t), _now(), stake=20.0).join(proxy_events(t).select("event_id", "extra_time", "penalties"), "event_id")
    ok = F.col("distribution_status") == "OK"
    scope = ~F.coalesce("extra_time", F.lit(True)) & ~F.coalesce("penalties", F.lit(True))
    quotes = F.col("q_zero").isNotNull() & F.col("q_two").isNotNull()
    ev = F.when(ok, markets.expected_value(F.col("p0"), F.col("p2"), F.col("payout_zero").cast("double"), F.col("payout_two").cast("double"), 20.0))
    verdict = markets.display_verdict(scope, quotes, F.lit(False), F.col("status"), ok, F.col("p1_buffer"))
    return a.select("event_id", F.round(ev, 6).alias("ev"), verdict.alias("verdict"))


@query(
    "p05_entry_check",
    f"""WITH {_CANONICAL}, q AS (SELECT event_id, outcome_id, arg_max({{'t': canonical_type, 'l': line, 'o': odds, 'a': available, 's': observed_at}}, (market_id)) AS q, max(observed_at) AS moment FROM f GROUP BY ALL),
c AS (SELECT e.*, greatest(z.moment, w.moment) AS moment, z.q AS z, w.q AS w FROM e LEFT JOIN q z ON z.event_id = e.event_id AND z.outcome_id = '-' LEFT JOIN q w ON w.event_id = e.event_id AND w.outcome_id = '+')
SELECT event_id, CASE WHEN NOT (period = 'HALF_TIME' OR clock = 'HZ') THEN 'NOT_HALFTIME' WHEN NOT (extra_time IS FALSE AND penalties IS FALSE) THEN 'SETTLEMENT_SCOPE_UNKNOWN' WHEN score_home IS NULL THEN 'HALFTIME_SCORE_MISSING' WHEN score_home <> ht_home OR score_away <> ht_away THEN 'HALFTIME_SCORE_CONFLICT'
WHEN moment IS NULL THEN 'QUOTE_AGE_UNKNOWN' WHEN epoch(TIMESTAMP '2024-01-01') - epoch(moment) > 10 THEN 'QUOTE_TOO_OLD' WHEN z IS NULL THEN 'MISSING_QUOTES' WHEN z.s <> moment THEN 'QUOTE_SNAPSHOT_MISMATCH' WHEN NOT coalesce(z.o > 1, false) THEN 'INVALID_ODDS' WHEN NOT z.a THEN 'MARKET_NOT_OPEN'
WHEN NOT coalesce(z.t = 'NEXT_GOAL_NONE' OR z.t = 'REMAINING_TOTAL_UNDER' AND z.l = 0.5 OR z.t = 'MATCH_TOTAL_UNDER' AND z.l = score_home + score_away + 0.5, false) THEN 'MARKET_SEMANTICS_MISMATCH' WHEN w.s <> moment THEN 'QUOTE_SNAPSHOT_MISMATCH' WHEN NOT coalesce(w.o > 1, false) THEN 'INVALID_ODDS' WHEN NOT w.a THEN 'MARKET_NOT_OPEN'
WHEN NOT coalesce(w.t = 'REMAINING_TOTAL_OVER' AND w.l = 1.5 OR w.t = 'MATCH_TOTAL_OVER' AND w.l = score_home + score_away + 1.5, false) THEN 'MARKET_SEMANTICS_MISMATCH' ELSE 'OK' END AS reason FROM c""",
)
def p05_entry_check(t):
    """Each event's quotes of its last market."""
    quotes = _canonical(t).groupBy("event_id").agg(
        F.max("observed_at").alias("observed_at"),
        *[
            F.max(F.when(F.col("outcome_id") == side, F.struct("market_id", "observed_at", "event_id", "outcome_id", "odds", "settlement_scope", "available", "status", "canonical_type", "line"))).alias(name)
            for name, side in (("zero", "-"), ("two", "+"))
        ],
    )
    rows = proxy_events(t).withColumn("status", F.lit("LIVE")).join(quotes, "event_id", "left")
    return rows.select("event_id", markets.entry_check(_now(), 10).alias("reason"))


@query(
    "p06_signals",
    """WITH v AS (SELECT * FROM (VALUES ('A', 'MARKET_ONLY', 1.5::DOUBLE, 1.2::DOUBLE, 0.02::DOUBLE, 0.1::DOUBLE, -0.05::DOUBLE, 0.4::DOUBLE, 8.0::DOUBLE), ('B', 'MARKET_STRUCTURE', 1.2, 1.2, 0.0, 0.0, 0.0, 0.0, 12.0), ('C', 'OTHER', 1, 1, 0, 0, 0, 0, 0)) v(portfolio, family, zq, tq, roi, be, buf, p, age)),
x AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'STALE' ELSE 'OK' END AS status, value / 40 AS q_zero, 1 + value / 200 AS q_two, value / 1000 - 0.02 AS win_roi, value / 900 AS p1_max, CASE WHEN event_type <> 'view' THEN value / 900 - 0.3 END AS p1_buffer, CASE WHEN event_type <> 'view' THEN 0.3 + value / 5000 END AS p1, event_id % 15 AS age FROM events)
SELECT event_id, portfolio, CASE WHEN family = 'OTHER' THEN 'UNSUPPORTED_FAMILY' WHEN status <> 'OK' THEN 'EVALUATION_STALE' WHEN q_zero < zq THEN 'MINIMUM_Q_ZERO_NOT_MET' WHEN q_two < tq THEN 'MINIMUM_Q_TWO_PLUS_NOT_MET' WHEN win_roi < roi THEN 'MINIMUM_WIN_ROI_NOT_MET' WHEN p1_max < be THEN 'BREAK_EVEN_BELOW_THRESHOLD'
WHEN family = 'MARKET_ONLY' AND p1 IS NULL THEN 'MARKET_PROBABILITY_UNAVAILABLE' WHEN family = 'MARKET_ONLY' AND p1_buffer < buf THEN 'MINIMUM_P1_BUFFER_NOT_MET' WHEN family = 'MARKET_ONLY' AND p1 > p THEN 'MAXIMUM_P1_EXCEEDED' WHEN x.age > v.age THEN 'QUOTE_TOO_OLD' ELSE 'SIGNAL_ACCEPTED' END AS reason FROM x, v""",
)
def p06_signals(t):
    c, view = F.col, F.col("event_type") != "view"
    rows = t.events.select(
        "event_id", F.when(c("event_type") == "error", "STALE").otherwise("OK").alias("status"), (c("value") / 40).alias("q_zero"), (1 + c("value") / 200).alias("q_two"), (c("value") / 1000 - 0.02).alias("win_roi"),
        (c("value") / 900).alias("p1_max"), F.when(view, c("value") / 900 - 0.3).alias("p1_buffer"), F.when(view, 0.3 + c("value") / 5000).alias("p1"), (c("event_id") % 15).alias("age_zero"), (c("event_id") % 15).alias("age_two"),
    )
    kinds = "portfolio string, strategy string, family string, min_q_zero double, min_q_two double, min_win_roi double, min_break_even double, min_buffer double, max_p1 double, max_age double"
    book = t.spark.createDataFrame([("A", "ZERO_OR_2PLUS", "MARKET_ONLY", 1.5, 1.2, 0.02, 0.1, -0.05, 0.4, 8.0), ("B", "ZERO_OR_2PLUS", "MARKET_STRUCTURE", 1.2, 1.2, 0.0, 0.0, 0.0, 0.0, 12.0), ("C", "ZERO_OR_2PLUS", "OTHER", 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], kinds)
    return markets.signals(rows, book).select("event_id", "portfolio", "reason")


@query(
    "p07_feed_plausible",
    """WITH b AS (SELECT CAST(day(ts) AS INT) AS batch_id, event_id, event_type, value FROM events), d AS (SELECT batch_id, sum((event_type = 'click')::INT) AS listed, sum((event_type = 'click' AND value < 1)::INT) AS unmapped, sum((event_type = 'click' AND value > 450)::INT) AS unparsed, sum((event_type IN ('click', 'view') AND value <= 450)::INT) AS parsed FROM b GROUP BY 1)
SELECT batch_id, CASE WHEN batch_id % 13 = 0 THEN 'EVENTS_MISSING' WHEN batch_id % 7 = 0 THEN 'SPORT_MISSING_WITH_ACTIVE_EVENTS' WHEN unmapped > 0 THEN 'INDEX_WITHOUT_EVENT' WHEN unparsed > 0 THEN 'EVENT_NOT_PARSED' WHEN batch_id * 400 >= 20 AND parsed < greatest(1, batch_id * 400 // 10) THEN 'COUNT_COLLAPSED' END AS reason FROM d""",
)
def p07_feed_plausible(t):
    """A day is a batch: clicks are listed, clicks and views of some value are parsed."""
    rows = t.events.select(F.dayofmonth("ts").alias("batch_id"), "event_id", "event_type", "value")
    listed = F.when(F.col("event_type") == "click", F.col("event_id"))
    mapped = F.when((F.col("event_type") != "click") | (F.col("value") >= 1), F.col("event_id"))
    documents = rows.groupBy("batch_id").agg(F.collect_list(listed).alias("indexed"), F.collect_list(mapped).alias("event_ids"))
    documents = documents.select("batch_id", (F.col("batch_id") % 13 != 0).alias("has_events"), F.lit(True).alias("has_index"), F.when(F.col("batch_id") % 7 != 0, F.col("indexed")).alias("indexed"), "event_ids")
    parsed = rows.where("event_type IN ('click', 'view') AND value <= 450")
    active = rows.select("batch_id").distinct().withColumn("n", F.col("batch_id") * 400)
    return markets.feed_plausible(documents, parsed, active).select("batch_id", "reason")


@query(
    "p11_universe_priority",
    r"""WITH c AS (SELECT s_suppkey, s_name || CASE s_suppkey % 9 WHEN 0 THEN ' U-19' WHEN 1 THEN ' Youth' WHEN 2 THEN ' Juniors' ELSE '' END AS label, CASE s_nationkey % 4 WHEN 0 THEN 'FULL' WHEN 1 THEN 'NO_DATA' WHEN 2 THEN 'DISCOVERY' END AS coverage, CASE s_suppkey % 3 WHEN 0 THEN 'SUITABLE' WHEN 1 THEN 'UNSUITABLE' END AS market FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey = 9 THEN 'P0_SELECTED' WHEN s_suppkey % 9 IN (0, 1) THEN 'P4_IGNORE' WHEN coverage = 'FULL' AND market = 'SUITABLE' THEN 'P1_STRATEGY_ELIGIBLE' WHEN coalesce(coverage, 'DISCOVERY') = 'DISCOVERY' OR market IS NULL THEN 'P2_DISCOVERY' ELSE 'P3_MINIMAL' END AS priority FROM c""",
)
def p11_universe_priority(t):
    c, key = F.col, F.col("s_suppkey")
    label = F.lower(F.concat("s_name", F.when(key % 9 == 0, " U-19").when(key % 9 == 1, " Youth").when(key % 9 == 2, " Juniors").otherwise("")))
    coverage = F.when(c("s_nationkey") % 4 == 0, "FULL").when(c("s_nationkey") % 4 == 1, "NO_DATA").when(c("s_nationkey") % 4 == 2, "DISCOVERY")
    market = F.when(key % 3 == 0, "SUITABLE").when(key % 3 == 1, "UNSUITABLE")
    return t.supplier.select("s_suppkey", markets.universe_priority(key == 9, label, coverage, market).alias("priority"))


@query(
    "k02_strategy_projection",
    """SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS q_zero, o_custkey AS snapshot_id, CASE WHEN o_orderstatus <> 'P' THEN least(o_totalprice, 150000.0) END AS covered_payout FROM orders""",
)
def k02_strategy_projection(t):
    c = F.col
    rows = t.orders.select(
        c("o_orderkey").alias("event_id"), F.when(c("o_custkey") % 3 == 0, c("o_totalprice")).alias("q0_best"), (c("o_totalprice") + 1).alias("q_zero_best"), c("o_custkey").alias("snapshot_id"),
        c("o_totalprice").alias("payout_zero"), F.when(c("o_orderstatus") != "P", 150000.0).alias("payout_two"),
    )
    return markets.strategy_projection(rows).select("event_id", "q_zero", "snapshot_id", "covered_payout")


@query(
    "m04_insert_or_ignore",
    "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND o.ts < TIMESTAMP '2024-01-03') GROUP BY 1, 2",
)
def m04_insert_or_ignore(t):
    """What the rest of the stream adds to a table of its first days."""
    from pitchspark.operators import ledger

    rows = t.events.select("user_id", "event_type", "ts", "event_id")
    return ledger.insert_or_ignore(rows.where("ts < '2024-01-03'"), rows, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "m08_close_quotes",
    "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'stopped' WHEN event_type = 'click' THEN 'open' ELSE 'paused' END AS status, CASE WHEN NOT (event_type = 'click' AND user_id % 3 = 0) THEN value END AS odds FROM events",
)
def m08_close_quotes(t):
    from pitchspark.operators import ledger

    quotes = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "click", "open").otherwise("paused").alias("status"), F.col("value").alias("odds"))
    return ledger.close_open_quotes(quotes, quotes.where("user_id % 3 = 0"), "user_id").select("event_id", "status", "odds")


@query("u05_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY ts) AS kinds FROM (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY 1")
def u05_ordered_distinct(t):
    """Kinds of a user by first appearance; kinds are few, so what is gathered is bounded by them and not by the rows."""
    first = joins.first_by(t.events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts"])
    kinds = F.array_sort(F.collect_list(F.struct("ts", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["event_type"]), ",").alias("kinds"))
