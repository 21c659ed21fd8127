"""Result queries. Orders stand for events, order lines for what was seen of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchspark.operators import results
from pitchspark.plans.registry import query

c = F.col
_FT = "l_linenumber AS ft_home, l_quantity::INT % 3 AS ft_away, l_partkey % 3 AS ht_home, l_suppkey % 2 AS ht_away"
_RID = "l_orderkey, l_linenumber, l_suppkey, l_partkey"


def _lines(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", c("l_linenumber").alias("ft_home"), (c("l_quantity").cast("int") % 3).alias("ft_away"), (c("l_partkey") % 3).alias("ht_home"), (c("l_suppkey") % 2).alias("ht_away"),
        F.when(c("l_partkey") % 13 == 0, "Void").when(c("l_linestatus") == "F", " finished").otherwise("LIVE").alias("status"),
        F.when(c("l_suppkey") % 7 == 0, None).otherwise(c("l_suppkey") % 11 == 0).alias("extra_time"), F.when(c("l_suppkey") % 9 == 0, None).otherwise(F.lit(False)).alias("penalties"),
        F.when(c("l_suppkey") % 5 == 0, c("l_linenumber") + 1).alias("reg_home"), F.when(c("l_suppkey") % 5 == 0, 1).alias("reg_away"), "l_shipdate", "l_returnflag",
    )


_LINES = f"""li AS (SELECT {_RID}, l_shipdate, l_returnflag, {_FT}, CASE WHEN l_partkey % 13 = 0 THEN 'VOID' WHEN l_linestatus = 'F' THEN 'FINISHED' ELSE 'LIVE' END AS status, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 11 = 0 END AS extra_time, CASE WHEN l_suppkey % 9 <> 0 THEN false END AS penalties,
l_suppkey % 5 = 0 AS regular, CASE WHEN regular THEN l_linenumber + 1 ELSE l_linenumber END AS h, CASE WHEN regular THEN 1 ELSE l_quantity::INT % 3 END AS a FROM lineitem)"""


@query(
    "d08_settlement",
    f"""WITH {_LINES}, r AS (SELECT *, h + a - ht_home - ht_away AS goals, CASE WHEN status = 'VOID' THEN 'EVENT_VOID' WHEN NOT regular AND coalesce(extra_time, false) THEN 'REGULATION_SCORE_REQUIRED' WHEN NOT regular AND (extra_time IS NULL OR penalties IS NULL) THEN 'EXTRA_TIME_SCOPE_UNKNOWN' WHEN status = 'LIVE' THEN 'FINAL_RESULT_NOT_CONFIRMED'
WHEN h < ht_home OR a < ht_away THEN 'FINAL_SCORE_BELOW_HALF_TIME_SCORE' ELSE 'SECOND_HALF_GOALS_' || (h + a - ht_home - ht_away) END AS reason FROM li)
SELECT {_RID}, reason, CASE WHEN reason = 'EVENT_VOID' THEN 'VOID' WHEN reason NOT LIKE 'SECOND%' THEN 'UNRESOLVED' WHEN goals = 0 THEN 'WIN_ZERO' WHEN goals = 1 THEN 'LOSS_MIDDLE' ELSE 'WIN_TWO_PLUS' END AS verdict FROM r""",
)
def d08_settlement(t):
    s = results.settlement(*[c(x) for x in ("ht_home", "ht_away", "ft_home", "ft_away", "status", "extra_time", "penalties", "reg_home", "reg_away")])
    return _lines(t).withColumn("s", s).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "s.reason", "s.verdict")


_FINAL = f"""{_LINES}, ev AS (SELECT o_orderkey AS event_id, CASE o_custkey % 7 WHEN 0 THEN 'postponed' WHEN 1 THEN 'no_longer_live' WHEN 2 THEN 'Finished' ELSE 'live' END AS status, CASE WHEN o_orderstatus <> 'P' THEN false END AS et, o_custkey % 19 = 0 AS pe FROM orders),
pr AS (SELECT l_orderkey AS event_id, ft_home, CASE WHEN l_partkey % 5 <> 0 THEN ft_away END AS ft_away, ht_home, ht_away, l_shipdate AS moment, 'S' || l_suppkey % 3 AS source, l_linenumber <= 2 AND l_returnflag <> 'A' AS terminal FROM li),
pf AS (SELECT event_id, max(CASE WHEN ft_away IS NOT NULL THEN {{'t': moment, 's': source, 'h': ft_home, 'a': ft_away}} END) AS f, max({{'t': moment, 's': source, 'h': ft_home, 'a': ft_away}}) AS y, count(DISTINCT CASE WHEN ft_away IS NOT NULL THEN {{'h': ft_home, 'a': ft_away}} END) AS n FROM pr WHERE terminal GROUP BY 1),
ht AS (SELECT event_id, ht_home, ht_away FROM pr WHERE terminal UNION ALL SELECT l_orderkey, ht_home, ht_away FROM li WHERE l_linenumber = 3), hm AS (SELECT event_id, count(DISTINCT {{'h': ht_home, 'a': ht_away}}) AS n, min({{'h': ht_home, 'a': ht_away}}) AS p FROM ht GROUP BY 1),
fz AS (SELECT o_orderkey AS event_id, {{'h': o_custkey % 3, 'a': 1}} AS z FROM orders WHERE o_custkey % 4 = 0), kn AS (SELECT DISTINCT fz.event_id FROM fz JOIN ht ON ht.event_id = fz.event_id AND ht.ht_home = z.h AND ht.ht_away = z.a),
al AS (SELECT ev.*, coalesce(f, y) AS e, pf.n > 1 AS many, hm.n AS nh, z, kn.event_id IS NOT NULL AS known, CASE WHEN hm.n IS NOT NULL THEN CASE WHEN kn.event_id IS NOT NULL THEN z ELSE p END END AS k FROM ev LEFT JOIN pf USING (event_id) LEFT JOIN hm USING (event_id) LEFT JOIN fz USING (event_id) LEFT JOIN kn ON kn.event_id = ev.event_id),
fc AS (SELECT *, CASE WHEN pe THEN 'PENALTIES' WHEN et IS NULL THEN 'UNKNOWN' ELSE 'REGULATION' END AS scope, e.h IS NOT NULL AND e.a IS NOT NULL AS ft, coalesce(nh > 1, false) OR (z IS NOT NULL AND NOT coalesce(known, false)) AS conf, coalesce(e.h < k.h OR e.a < k.a, false) AS below FROM al),
de AS (SELECT event_id, e.h AS ft_home, e.a AS ft_away, k.h AS ht_home, k.a AS ht_away, CASE WHEN coalesce(many, false) THEN 'RESULT_CONFLICT' WHEN NOT ft AND status = 'no_longer_live' THEN 'NO_LONGER_LIVE_WITHOUT_FINAL_EVIDENCE' WHEN NOT ft AND status = 'postponed' THEN 'EVENT_CALLED_OFF' WHEN NOT ft THEN 'FINAL_SCORE_MISSING'
WHEN scope = 'PENALTIES' THEN 'NON_REGULATION_SCOPE' WHEN scope <> 'REGULATION' THEN 'SCOPE_UNKNOWN' WHEN conf THEN 'HALFTIME_EVIDENCE_CONFLICT' WHEN below THEN 'INVALID_FT_BELOW_HT' WHEN k IS NULL THEN 'HT_MISSING' ELSE 'VERIFIED_REGULATION' END AS reason FROM fc)"""


@query(
    "d09_finalisation",
    f"""WITH {_FINAL} SELECT event_id, ft_home, ft_away, ht_home, ht_away, reason, CASE reason WHEN 'RESULT_CONFLICT' THEN 'CONFLICT' WHEN 'EVENT_CALLED_OFF' THEN 'UNAVAILABLE' WHEN 'HT_MISSING' THEN 'VERIFIED' WHEN 'VERIFIED_REGULATION' THEN 'VERIFIED' WHEN 'FINAL_SCORE_MISSING' THEN 'PENDING' WHEN 'NO_LONGER_LIVE_WITHOUT_FINAL_EVIDENCE' THEN 'PENDING' ELSE 'PARTIAL' END AS result_status,
reason IN ('HALFTIME_EVIDENCE_CONFLICT', 'HT_MISSING', 'VERIFIED_REGULATION') AS use_ft, CASE WHEN reason = 'VERIFIED_REGULATION' THEN ft_home + ft_away - ht_home - ht_away END AS h2_goals FROM de""",
)
def d09_finalisation(t):
    return results.finalised(*_evidence(t)).select("event_id", "ft_home", "ft_away", "ht_home", "ht_away", "reason", "result_status", "use_ft", "h2_goals")


def _evidence(t):
    key = c("o_custkey") % 7
    events = t.orders.select(
        c("o_orderkey").alias("event_id"), F.when(key == 0, "postponed").when(key == 1, "no_longer_live").when(key == 2, "Finished").otherwise("live").alias("status"), F.lit(None).cast("string").alias("period"),
        F.when(c("o_orderstatus") != "P", False).alias("extra_time"), (c("o_custkey") % 19 == 0).alias("penalties"),
    )
    lines = _lines(t)
    proof = lines.select(
        c("l_orderkey").alias("event_id"), F.concat(F.lit("S"), (c("l_suppkey") % 3).cast("string")).alias("source"), c("l_shipdate").alias("observed_at"), ((c("l_linenumber") <= 2) & (c("l_returnflag") != "A")).alias("terminal"),
        "ft_home", F.when(c("l_partkey") % 5 != 0, c("ft_away")).alias("ft_away"), c("ht_home").cast("long").alias("ht_home"), c("ht_away").cast("long").alias("ht_away"), F.lit(None).cast("boolean").alias("extra_time"), F.lit(None).cast("boolean").alias("penalties"),
    )
    halves = lines.where("l_linenumber = 3").select(c("l_orderkey").alias("event_id"), c("l_shipdate").alias("observed_at"), c("ht_home").cast("long").alias("ht_home"), c("ht_away").cast("long").alias("ht_away"))
    frozen = t.orders.where("o_custkey % 4 = 0").select(c("o_orderkey").alias("event_id"), (c("o_custkey") % 3).cast("long").alias("ht_home"), F.lit(1).cast("long").alias("ht_away"))
    return events, proof, halves, frozen


_CHECK = f"""{_LINES}, ck AS (SELECT {_RID}, CASE WHEN l_returnflag = 'A' THEN 'IDENTITY_CONFLICT' WHEN status <> 'FINISHED' THEN 'NOT_FINISHED' WHEN l_partkey % 6 = 0 THEN 'INCOMPLETE_SCORE' WHEN l_suppkey % 7 = 0 THEN 'SCOPE_UNKNOWN' WHEN coalesce(extra_time, false) THEN 'EXCLUDED_NON_REGULATION' WHEN l_partkey % 8 = 1 THEN 'VALID_FT_ONLY'
WHEN ft_home < ht_home OR ft_away < ht_away THEN 'INVALID_SCORE' WHEN ht_home <> 1 AND l_suppkey % 4 = 0 THEN 'HT_CONFLICT' ELSE 'VALID_REGULATION' END AS status, l_linenumber AS attempts, l_shipdate AS seen FROM li)"""


def _checked(t):
    scope = F.when(c("extra_time").isNull(), "UNKNOWN").when(c("extra_time"), "EXTRA_TIME").otherwise("REGULATION")
    ht = tuple(F.when(c("l_partkey") % 8 != 1, c(x)) for x in ("ht_home", "ht_away"))
    ft = (F.when(c("l_partkey") % 6 != 0, c("ft_home")), c("ft_away"))
    own = (F.when(c("l_suppkey") % 4 == 0, F.lit(1)), c("ht_away"))
    status = results.backfill_check(c("l_returnflag") != "A", c("status") == " finished", scope, ht, ft, own)
    return _lines(t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", status.alias("status"), c("l_linenumber").alias("attempts"), c("l_shipdate").alias("seen"))


@query("d10_backfill_check", f"WITH {_CHECK} SELECT {_RID}, status FROM ck")
def d10_backfill_check(t):
    return _checked(t).drop("attempts", "seen")


@query(
    "d10_backfill_plans",
    """WITH m AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNMATCHED' END AS verdict, s_suppkey % 10 / 10 AS score FROM supplier)
SELECT s_suppkey AS event_id, CASE WHEN s_suppkey % 6 = 0 THEN 'LINKED' ELSE coalesce(verdict, 'NO_CANDIDATE') END AS identity_status, CASE WHEN s_suppkey % 6 = 0 THEN 'L' || s_suppkey WHEN verdict = 'EXACT' THEN 'M' || s_suppkey END AS provider_match_id FROM m""",
)
def d10_backfill_plans(t):
    key = c("s_suppkey")
    name = lambda k: F.concat(F.lit(k), key.cast("string")).alias("provider_match_id")
    events, links = t.supplier.select(key.alias("event_id")), t.supplier.where("s_suppkey % 6 = 0").select(key.alias("event_id"), name("L"))
    verdict = F.when(key % 4 == 0, "EXACT").when(key % 4 == 1, "AMBIGUOUS").otherwise("UNMATCHED")
    matches = t.supplier.where("s_suppkey % 4 < 3").select(key.alias("event_id"), name("M"), verdict.alias("verdict"), (key % 10 / 10).alias("score"))
    return results.backfill_plans(events, links, matches).select("event_id", "identity_status", "provider_match_id")


@query(
    "d19_retry_at",
    f"""WITH {_CHECK} SELECT {_RID}, CASE WHEN status LIKE 'VALID%' OR status = 'EXCLUDED_NON_REGULATION' THEN NULL WHEN status = 'NOT_FINISHED' THEN seen + INTERVAL 5 HOUR ELSE seen + INTERVAL 168 HOUR END AS retry_at FROM ck""",
)
def d19_retry_at(t):
    rows = _checked(t)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", results.retry_at(c("status"), c("attempts"), c("seen")).alias("retry_at"))


@query(
    "m10_stage_items",
    """WITH o AS (SELECT o_orderkey AS event_id, CASE WHEN o_custkey % 5 = 0 THEN 'DONE_LOCAL' ELSE 'PENDING' END AS stage, CASE o_custkey % 3 WHEN 0 THEN 'VALID_REGULATION' WHEN 1 THEN 'NO_DATA' END AS status FROM orders)
SELECT event_id, CASE WHEN stage <> 'PENDING' THEN stage WHEN status IS NULL THEN 'BLOCKED_NO_OUTCOME' WHEN status LIKE 'VALID%' THEN 'COMPLETE' ELSE 'BLOCKED_PROVIDER' END AS stage FROM o""",
)
def m10_stage_items(t):
    key = c("o_custkey") % 3
    items = t.orders.select(c("o_orderkey").alias("event_id"), F.when(c("o_custkey") % 5 == 0, "DONE_LOCAL").otherwise("PENDING").alias("stage"))
    outcomes = t.orders.where(key < 2).select(c("o_orderkey").alias("event_id"), F.when(key == 0, "VALID_REGULATION").otherwise("NO_DATA").alias("status"))
    return results.stage_items(items, outcomes)


_TARGET = f"""{_LINES}, tg AS (SELECT *, CASE WHEN l_partkey % 13 = 0 THEN 'INVALID_EXTRA_TIME_AMBIGUOUS' WHEN l_partkey % 6 = 0 THEN 'MISSING_HT_OR_REGULATION_FT' WHEN ft_home < ht_home OR ft_away < ht_away THEN 'INVALID_SCORE_TOTAL_LT_HALFTIME' ELSE 'VALID_REGULATION' END AS quality, quality = 'VALID_REGULATION' AS eligible, ft_home + ft_away - ht_home - ht_away AS n,
CASE WHEN eligible THEN CASE n WHEN 0 THEN 'H2_GOALS_0' WHEN 1 THEN 'H2_GOALS_1' ELSE 'H2_GOALS_2_PLUS' END END AS target FROM li)"""


def _targets(t):
    full = F.when(c("l_partkey") % 6 != 0, c("ft_home"))
    rows = _lines(t).withColumn("ambiguous", c("l_partkey") % 13 == 0).withColumn("ft_home", full)
    return rows.withColumn("t", results.h2_target(c("ht_home"), c("ht_away"), c("ft_home"), c("ft_away"), c("ambiguous"))).select("*", "t.*").drop("t")


@query("d12_h2_target", f"WITH {_TARGET} SELECT {_RID}, quality, target, target = 'H2_GOALS_1' AS middle_loss, eligible FROM tg")
def d12_h2_target(t):
    return _targets(t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "quality", "target", "middle_loss", "eligible")


@query("d12_extra_time_text", r"SELECT doc_id, regexp_matches(lower(text || ' ' || source), 'extra\s*time|after\s+extra|a\.e\.t\.|\baet\b|penalty\s+shoot|shootout|verl[äa]ngerung|\bn\.?\s*v\.?\b') AS extra FROM documents")
def d12_extra_time_text(t):
    return t.documents.select("doc_id", results.extra_time_text(c("text"), c("source")).alias("extra"))


@query(
    "d13_dataset_audit",
    f"""WITH {_TARGET} SELECT count(*) AS n, sum(eligible::INT)::BIGINT AS eligible_rows, sum((eligible AND l_suppkey % 10 = 0 AND target IS DISTINCT FROM 'H2_GOALS_1')::INT)::BIGINT AS target_mismatches, 3::BIGINT AS forbidden_features, 'FAIL' AS status FROM tg""",
)
def d13_dataset_audit(t):
    """Some stored targets were overwritten; of five features one tells the final score, one the second half, one has no cut-off."""
    rows = _targets(t).withColumn("target", F.when(c("eligible") & (c("l_suppkey") % 10 == 0), "H2_GOALS_1").otherwise(c("target")))
    catalog = t.spark.createDataFrame([("ht_shots", "FIRST_HALF", "HALFTIME"), ("ft_goals", "", "HALFTIME"), ("x", "second half", "HALFTIME"), ("y", "", "LATER"), ("prior_5_mean", "ROLLING", "ROLLING_HISTORY")], "feature string, origin string, cutoff string")
    return results.dataset_audit(rows, catalog)


@query(
    "p14_eligible_rows",
    f"""WITH {_TARGET}, f AS (SELECT * FROM tg WHERE eligible AND l_suppkey % 3 = 0) SELECT {_RID}, l_shipdate FROM f WHERE epoch(l_shipdate) >= (SELECT max(epoch(l_shipdate)) FROM f) - (2 * 365.25 * 86400)::BIGINT""",
)
def p14_eligible_rows(t):
    rows = _targets(t).withColumn("has_xg", c("l_suppkey") % 3 == 0)
    return results.eligible_rows(rows, ["has_xg"], "l_shipdate", 2).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")


@query(
    "p13_match_quality",
    f"""WITH {_LINES} SELECT {_RID}, CASE WHEN l_partkey % 6 = 0 THEN 'PARTIAL' WHEN ft_home + ft_away < ht_home + ht_away THEN 'INVALID' WHEN l_suppkey % 3 = 0 THEN 'SCORE_ONLY' WHEN l_suppkey % 3 = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality,
CASE WHEN ft_away = 0 THEN 'PARTIAL' WHEN l_suppkey % 4 = 0 AND l_partkey % 2 = 1 THEN 'MOSTLY_PAUSED' WHEN l_suppkey % 4 < ft_away / 2 THEN 'PARTIAL' ELSE 'COMPLETE' END AS snapshot FROM li""",
)
def p13_match_quality(t):
    full = F.when(c("l_partkey") % 6 != 0, c("ft_home"))
    quality = results.match_quality(c("ht_home"), c("ht_away"), full, c("ft_away"), c("l_suppkey") % 3 > 0, c("l_suppkey") % 3 == 2)
    snapshot = results.snapshot_quality(F.lit(1), c("ft_away"), c("l_suppkey") % 4, c("l_partkey") % 2)
    return _lines(t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", quality.alias("quality"), snapshot.alias("snapshot"))


_STATES = """CASE event_type WHEN 'purchase' THEN CASE WHEN value > 480 THEN 'FINISHED' ELSE 'LIVE' END WHEN 'error' THEN 'GONE' WHEN 'view' THEN 'LIVE' WHEN 'signup' THEN 'PREMATCH' ELSE 'OTHER' END"""


@query(
    "p12_accepted_states",
    f"""WITH RECURSIVE s AS (SELECT user_id, ts, {_STATES} AS kind, value > 250 AS soon, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
f AS (SELECT user_id, ts, k, kind, true AS ok, kind AS state FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.ts, s.k, s.kind, CASE f.state WHEN 'FINISHED' THEN s.kind = 'FINISHED' WHEN 'GONE' THEN s.kind = 'LIVE' OR s.kind = 'PREMATCH' AND s.soon WHEN 'LIVE' THEN s.kind <> 'PREMATCH' ELSE true END,
CASE WHEN CASE f.state WHEN 'FINISHED' THEN s.kind = 'FINISHED' WHEN 'GONE' THEN s.kind = 'LIVE' OR s.kind = 'PREMATCH' AND s.soon WHEN 'LIVE' THEN s.kind <> 'PREMATCH' ELSE true END THEN s.kind ELSE f.state END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id AS event_id, ts AS at, kind, ok AS accepted FROM f""",
)
def p12_accepted_states(t):
    kind = F.when(c("event_type") == "purchase", F.when(c("value") > 480, "FINISHED").otherwise("LIVE")).when(c("event_type") == "error", "GONE").when(c("event_type") == "view", "LIVE").when(c("event_type") == "signup", "PREMATCH").otherwise("OTHER")
    kickoff = F.when(c("value") > 250, F.lit("2024-03-01")).otherwise(F.lit("2023-01-01")).cast("timestamp")
    rows = t.events.select(c("user_id").alias("event_id"), c("ts").alias("at"), kind.alias("kind"), kickoff.alias("kickoff"))
    return results.accepted_states(rows, 6.0, F.lit("2024-01-31").cast("timestamp"))


@query(
    "f25_halftime_from_goals",
    """WITH g AS (SELECT user_id, (row_number() OVER w * 7)::INT AS minute, row_number() OVER w AS k FROM events WHERE event_type = 'purchase' AND value > 300 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT u.user_id, max(CASE WHEN minute <= 45 THEN k END) AS last, count(g.user_id) AS goals FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON g.user_id = u.user_id GROUP BY 1)
SELECT user_id, CASE WHEN last IS NOT NULL THEN last WHEN goals = 0 THEN 0 END::BIGINT AS home, CASE WHEN last IS NOT NULL OR goals = 0 THEN 0 END::BIGINT AS away FROM n""",
)
def f25_halftime_from_goals(t):
    """Dear purchases of a user as goals of the home side, one each seven minutes."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("int")
    goals = t.events.where("event_type = 'purchase' AND value > 300").select("user_id", F.struct((k * 7).alias("minute"), k.alias("home"), F.lit(0).alias("away")).alias("g"))
    rows = t.events.select("user_id").distinct().join(goals.groupBy("user_id").agg(F.collect_list("g").alias("goals")), "user_id", "left")
    goals = F.coalesce("goals", F.array().cast("array<struct<minute:int,home:int,away:int>>"))
    score = results.halftime_from_goals(goals, F.size(goals), F.lit(0))
    return rows.withColumn("s", score).select("user_id", c("s.home").cast("long").alias("home"), c("s.away").cast("long").alias("away"))


@query(
    "d20_readiness",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'NO_LINK' WHEN s_suppkey % 3 = 0 THEN 'NOT_OBSERVED' WHEN s_nationkey % 2 = 0 THEN 'AVAILABLE' ELSE 'NO_HALFTIME' END AS readiness, concat_ws(',', CASE WHEN s_nationkey % 2 = 1 THEN 'HT_STATS_UNAVAILABLE' END, CASE WHEN s_nationkey % 3 = 0 THEN 'STATS_UNAVAILABLE' WHEN s_nationkey % 5 <> 0 THEN 'STATS_PARTIAL' END,
CASE WHEN s_suppkey % 7 = 0 THEN 'OWN_RESULT_MISSING' WHEN s_suppkey % 2 = 0 THEN 'RESULT_CONFLICT' END) AS flags, concat_ws(',', CASE WHEN s_suppkey % 4 = 0 THEN 'HALFTIME' END, CASE WHEN s_suppkey % 4 = 1 AND s_nationkey >= 12 THEN 'HT_STABLE' END, CASE WHEN s_suppkey % 90 >= 60 THEN 'MINUTE_60' END, CASE WHEN s_suppkey % 90 >= 70 THEN 'MINUTE_70' END, CASE WHEN s_suppkey % 90 >= 80 THEN 'MINUTE_80' END, CASE WHEN s_suppkey % 11 = 0 THEN 'FINAL' END) AS slots FROM supplier""",
)
def d20_readiness(t):
    key, nation = c("s_suppkey"), c("s_nationkey")
    ready = results.readiness(F.when(key % 5 != 0, "exact"), key % 3 != 0, nation % 2 == 0)
    result = results.consistency((F.when(key % 7 != 0, F.lit(1)), F.lit(0)), (F.lit(1), key % 2 * 0 + F.when(key % 2 == 0, 1).otherwise(0)), ("OWN_RESULT_MISSING", "OTHER_RESULT_MISSING"), "RESULT_MATCH", "RESULT_CONFLICT")
    flags = results.quality_flags(nation % 2 == 0, nation % 3 != 0, nation % 5 == 0, result, F.lit("HT_MATCH"))
    slots = results.crossed_slots(F.lit("live"), F.when(key % 4 == 0, "Half_Time").when(key % 4 == 1, "2H").otherwise("x"), key % 90, nation * 4.0, key % 11 == 0)
    return t.supplier.select("s_suppkey", ready.alias("readiness"), F.array_join(flags, ",").alias("flags"), F.array_join(slots, ",").alias("slots"))


@query(
    "w13_half_time_anchor",
    """WITH a AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'purchase' AND value > 400 GROUP BY 1), b AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'error' AND value > 450 GROUP BY 1), s AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id AS event_id, coalesce(a.ts, b.ts, s.ts) AS anchor FROM s FULL JOIN a USING (user_id) FULL JOIN b USING (user_id)""",
)
def w13_half_time_anchor(t):
    rows = lambda cond: t.events.where(cond).select(c("user_id").alias("event_id"), c("ts").alias("at"))
    return results.half_time_anchor(rows("event_type = 'purchase' AND value > 400"), rows("event_type = 'error' AND value > 450"), rows("event_type = 'view'"))


@query(
    "d16_daily_metrics",
    """WITH w AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), s AS (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'HALFTIME' WHEN 'view' THEN 'MINUTE_60' WHEN 'signup' THEN 'PREMATCH' ELSE 'FINAL' END AS kind, CASE WHEN value > 400 THEN 'FAILED' END AS q FROM events), d AS (SELECT * FROM s WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'),
r AS (SELECT user_id FROM w WHERE b - INTERVAL 15 DAY >= TIMESTAMP '2024-01-10' AND b - INTERVAL 15 DAY < TIMESTAMP '2024-01-11')
SELECT (SELECT count(*) FROM w WHERE a >= TIMESTAMP '2024-01-10' AND a < TIMESTAMP '2024-01-11' OR b >= TIMESTAMP '2024-01-10' AND b < TIMESTAMP '2024-01-11') AS events_seen, sum((kind = 'HALFTIME')::INT)::BIGINT AS n_halftime, sum((kind = 'FINAL')::INT)::BIGINT AS n_final, count(DISTINCT CASE WHEN kind = 'PREMATCH' AND q IS NULL THEN user_id END) AS events_with_prematch,
count(DISTINCT CASE WHEN kind = 'MINUTE_60' AND q IS NULL THEN user_id END) AS events_with_core, sum((kind <> 'PREMATCH')::INT)::BIGINT AS standard, coalesce(sum((q = 'FAILED')::INT), 0)::BIGINT AS failed, (SELECT count(*) FROM r) AS finished, round(coalesce((SELECT count(*) FROM s JOIN r USING (user_id) WHERE kind <> 'PREMATCH') / nullif((SELECT count(*) FROM r), 0), 0), 6) AS standard_per_match FROM d""",
)
def d16_daily_metrics(t):
    """A day of users: seen first or last on it, with their events as snapshots; a user's match ends 15 days before the last event."""
    kind = F.when(c("event_type") == "click", "HALFTIME").when(c("event_type") == "view", "MINUTE_60").when(c("event_type") == "signup", "PREMATCH").otherwise("FINAL")
    seen = t.events.groupBy(c("user_id").alias("event_id")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    shots = t.events.select(c("user_id").alias("event_id"), c("ts").alias("observed_at"), kind.alias("snapshot_type"), F.when(c("value") > 400, "FAILED").alias("quality"))
    ended = seen.select("event_id", (c("last_seen") - F.expr("INTERVAL 15 DAY")).alias("finished_at"))
    found = results.daily_metrics(seen, shots, ended, "2024-01-10")
    return found.select("events_seen", "n_halftime", "n_final", "events_with_prematch", "events_with_core", "standard", "failed", "finished", F.round("standard_per_match", 6).alias("standard_per_match"))


@query(
    "t09_last_minutes",
    f"""SELECT l_orderkey AS match_id, l_returnflag AS side, count(*) AS shots, sum((l_linestatus = 'F')::INT)::BIGINT AS on_target, round(sum(l_tax), 6) AS xg FROM lineitem WHERE l_quantity::INT BETWEEN greatest(0, 20 + l_orderkey % 30 - 15) AND 20 + l_orderkey % 30 GROUP BY ALL""",
)
def t09_last_minutes(t):
    rows = t.lineitem.select(c("l_orderkey").alias("match_id"), c("l_returnflag").alias("side"), c("l_quantity").cast("int").alias("minute"), (20 + c("l_orderkey") % 30).alias("now"), (c("l_linestatus") == "F").alias("on_target"), c("l_tax").alias("xg"))
    return results.last_minutes(rows).withColumn("xg", F.round("xg", 6))


@query(
    "d15_live_match",
    """WITH p AS (SELECT l_orderkey AS match_id, CASE WHEN l_linenumber <= 2 THEN 'FIRST_HALF' ELSE 'SECOND_HALF' END AS period, l_returnflag AS side, l_quantity FROM lineitem), s AS (SELECT match_id, round(sum(CASE WHEN side = 'A' THEN l_quantity END), 4) AS home_all, round(sum(CASE WHEN side = 'R' THEN l_quantity END), 4) AS away_all,
round(sum(CASE WHEN side = 'A' AND period = 'FIRST_HALF' THEN l_quantity END), 4) AS home_first, round(sum(CASE WHEN side = 'R' AND period = 'SECOND_HALF' THEN l_quantity END), 4) AS away_second FROM p GROUP BY 1)
SELECT s.*, CASE WHEN o_orderstatus = 'P' THEN 'OWN_MISSING' WHEN home_all IS NULL OR away_all IS NULL THEN 'OTHER_MISSING' WHEN home_all > away_all THEN 'MATCH' ELSE 'CONFLICT' END AS consistency FROM s JOIN orders ON o_orderkey = match_id""",
)
def d15_live_match(t):
    """Stats of a match by period and side, and whether another source has the same winner."""
    from pitchspark.operators import reshape

    side, first = c("l_returnflag"), c("l_linenumber") <= 2
    wide = reshape.windowed_wide(t.lineitem, ["l_orderkey"], {"all": F.lit(True), "first": first, "second": ~first}, {"home": side == "A", "away": side == "R"}, {"quantity": c("l_quantity")})
    rows = wide.join(t.orders.select(c("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    home, away = c("home_all_quantity"), c("away_all_quantity")
    known = F.round(home, 4).isNotNull() & away.isNotNull()
    label = results.consistency((F.when(c("o_orderstatus") != "P", F.lit(1)), F.lit(0)), (F.when(known, (F.round(home, 4) > F.round(away, 4)).cast("int")), F.when(known, F.lit(0))), ("OWN_MISSING", "OTHER_MISSING"), "MATCH", "CONFLICT")
    shown = {"home_all": "home_all_quantity", "away_all": "away_all_quantity", "home_first": "home_first_quantity", "away_second": "away_second_quantity"}
    return rows.select(c("l_orderkey").alias("match_id"), *[F.round(v, 4).alias(k) for k, v in shown.items()], label.alias("consistency"))


@query(
    "d17_strategy_candidates",
    """WITH e AS (SELECT s_nationkey AS x, s_nationkey % 10 / 50.0 AS err, list(s_acctbal ORDER BY s_suppkey) AS folds, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT *, unnest([0.3, 0.275, 0.2]) AS p FROM e WHERE x % 4 <> 3 AND n >= 2 AND err <= 0.15)
SELECT x || '_P1_LT_' || round(p * 1000)::INT AS candidate_id, round(list_aggregate(folds, 'stddev_pop'), 6) AS stability, n::INT AS fold_count FROM t WHERE round(p * 1000)::INT - x * 20 >= 30""",
)
def d17_strategy_candidates(t):
    rows = t.supplier.groupBy(c("s_nationkey").alias("experiment_id")).agg(F.collect_list("s_acctbal").alias("folds"))
    cells = F.transform(F.array(*[F.lit(x) for x in (0.3, 0.275, 0.2)]), lambda p: F.struct(p.alias("max_p1"), (F.round(p * 1000).cast("int") - c("experiment_id") * 20).alias("n"), F.lit(0.2).alias("actual")))
    rows = rows.select("experiment_id", F.when(c("experiment_id") % 4 != 3, "COMPLETED").otherwise("FAILED").alias("status"), (c("experiment_id") % 10 / 50.0).alias("calibration_error"), "folds", cells.alias("thresholds"))
    return results.strategy_candidates(rows).select("candidate_id", F.round("stability", 6).alias("stability"), "fold_count")
