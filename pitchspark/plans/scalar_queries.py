"""Scalar functions, reshaping and feed scans over the driver tables. JSON documents are made from rows and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchspark.functions import numbers, text, times
from pitchspark.operators import ledger, reshape
from pitchspark.plans.registry import query
from pitchspark.staging import keyed
from pitchspark.sources import documents, feeds

c = F.col
_TAILS = ("", " II", " U19 ", " (Women)", " Reserves B")


@query(
    "f03_marker_sets",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ii' WHEN 2 THEN 'u19' WHEN 3 THEN 'women' ELSE 'b+reserves' END AS markers FROM customer",
)
def f03_marker_sets(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (c("c_custkey") % 5 + 1).cast("int"))
    return t.customer.select("c_custkey", F.array_join(text.marker_set(F.concat(F.lit("FC "), F.initcap(F.lower("c_mktsegment")), tail)), "+").alias("markers"))


@query(
    "f04_sequence_ratio",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(2 * least(l_quantity, l_linenumber) / (l_quantity + l_linenumber), 8) AS ratio FROM lineitem",
)
def f04_sequence_ratio(t):
    """Of two texts of one letter the shorter is common to both."""
    of = lambda n: F.repeat(F.lit("a"), c(n).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.sequence_ratio(of("l_quantity"), of("l_linenumber")), 8).alias("ratio"))


@query(
    "f05_label_key",
    "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'label:even:0' WHEN c_nationkey % 2 = 0 AND c_mktsegment = 'FURNITURE' THEN 'label:even:1' ELSE lower(c_mktsegment) END AS label FROM customer",
)
def f05_label_key(t):
    place = F.when(c("c_nationkey") % 2 == 0, "even").otherwise("odd")
    return t.customer.select("c_custkey", text.label_key(place, F.lower("c_mktsegment"), {"even": [("building", "machinery"), ("furniture",)]}).alias("label"))


@query("f07_tolerant_casts", "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS known, NULL::DOUBLE AS nothing FROM orders")
def f07_tolerant_casts(t):
    written = F.concat(F.replace(c("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" EUR %"))
    odd = F.when(c("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(c("o_totalprice"))
    return t.orders.select("o_orderkey", numbers.number_or_null(written).alias("price"), numbers.finite(odd).alias("known"), numbers.number_or_null(F.lit("n/a")).alias("nothing"))


@query(
    "f08_utc_parse",
    "SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR AS east, date_trunc('second', ts) AS zulu, date_trunc('second', ts) AS naive, NULL::TIMESTAMP AS refused FROM events",
)
def f08_utc_parse(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select(
        "event_id", times.utc(F.concat(F.lit(" "), iso, F.lit("+02:00"))).alias("east"), times.utc(F.concat(iso, F.lit("Z"))).alias("zulu"), times.utc(iso).alias("naive"), times.utc(iso, naive_is_utc=False).alias("refused")
    )


_SUNDAY = "make_date(year(ts)::BIGINT, {m}, 31) - dayofweek(make_date(year(ts)::BIGINT, {m}, 31))::INT"


@query(
    "f10_display_zone",
    f"""SELECT event_id, strftime(ts + CASE WHEN ts >= ({_SUNDAY.format(m=3)})::TIMESTAMP + INTERVAL 1 HOUR AND ts < ({_SUNDAY.format(m=10)})::TIMESTAMP + INTERVAL 1 HOUR THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%d.%m.%Y %H:%M:%S') AS shown FROM events""",
)
def f10_display_zone(t):
    """Summer time from the last Sunday of March, one o'clock UTC, to that of October."""
    return t.events.select("event_id", times.display("ts").alias("shown"))


@query("f14_cents_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice * l_discount / 8 AS DECIMAL(20, 6)), 2) AS DOUBLE) AS cents FROM lineitem")
def f14_cents_half_up(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.money(c("l_extendedprice") * c("l_discount") / 8).cast("double").alias("cents"))


@query(
    "f21_flag_truth",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' WHEN o_orderkey % 6 IN (1, 2) OR o_orderkey % 6 = 5 AND o_orderstatus = 'O' THEN 'false' ELSE 'true' END AS flag FROM orders",
)
def f21_flag_truth(t):
    k = c("o_orderkey") % 6
    word = F.when(k == 1, " No").when(k == 2, "0").when(k == 3, "1").when(k == 4, c("o_orderstatus")).when(k == 5, F.when(c("o_orderstatus") == "O", "OFF").otherwise("yes"))
    return t.orders.select("o_orderkey", F.coalesce(text.truth(word).cast("string"), F.lit("unknown")).alias("flag"))


@query("f22_slugs", r"SELECT DISTINCT o_orderpriority, regexp_replace(regexp_replace(upper(trim(o_orderpriority)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_X' AS slug FROM orders")
def f22_slugs(t):
    return t.orders.select("o_orderpriority", text.slug(F.concat(F.lit("  ("), "o_orderpriority", F.lit(") x!"))).alias("slug")).distinct()


@query("f23_repaired", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '1. FC Köln ' WHEN 1 THEN 'Bor. Mönchengladbach ' ELSE 'München ' END || s_name AS name FROM supplier")
def f23_repaired(t):
    broken = F.element_at(F.array(F.lit("1. FC K\ufffdln "), F.lit("Bor. M\ufffdnchengladbach "), F.lit("M\ufffdnchen ")), (c("s_suppkey") % 3 + 1).cast("int"))
    return t.supplier.select("s_suppkey", text.repaired(F.concat(broken, "s_name")).alias("name"))


_ITEM = "struct(l_linenumber AS line, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey AS STRING) END AS id, l_partkey AS part, l_quantity AS quantity)"


@query(
    "x02_exploded_items",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey::VARCHAR END NULLS FIRST, l_partkey, l_quantity) - 1 AS position FROM lineitem)
SELECT l_orderkey, position::INT AS position, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey::VARCHAR ELSE l_orderkey || '-' || position END AS id, l_partkey AS part, l_quantity AS quantity FROM r""",
)
def x02_exploded_items(t):
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(_ITEM))).alias("items"))
    return reshape.explode_items(orders, ["l_orderkey"], "items", "id", "l_orderkey")


@query(
    "x03_flattened",
    "SELECT c_custkey AS key, c_name AS who_name, c_mktsegment AS who_segment, c_acctbal AS who_money_balance, c_nationkey AS place_nation FROM customer",
)
def x03_flattened(t):
    nested = t.customer.select(
        c("c_custkey").alias("key"), F.struct(c("c_name").alias("name"), c("c_mktsegment").alias("segment"), F.struct(c("c_acctbal").alias("balance")).alias("money")).alias("who"), F.struct(c("c_nationkey").alias("nation")).alias("place")
    )
    return documents.flattened(nested)


@query(
    "x04_wide_features",
    """SELECT l_suppkey, """
    + ", ".join(f"sum(CASE WHEN l_returnflag {s} 'R' AND {w} THEN {m} END) AS {side}_{window}_{name}" for side, s in (("back", "="), ("kept", "<>")) for window, w in (("early", "l_linenumber <= 2"), ("late", "l_linenumber > 2")) for name, m in (("lines", "1"), ("units", "l_quantity::BIGINT")))
    + " FROM lineitem GROUP BY 1",
)
def x04_wide_features(t):
    windows = {"early": c("l_linenumber") <= 2, "late": c("l_linenumber") > 2}
    sides = {"back": c("l_returnflag") == "R", "kept": c("l_returnflag") != "R"}
    return reshape.windowed_wide(t.lineitem, ["l_suppkey"], windows, sides, {"lines": F.lit(1), "units": c("l_quantity").cast("long")})


@query(
    "m09_fill_missing",
    """WITH e AS (SELECT l_orderkey, arg_max(l_shipdate, (l_linenumber, l_partkey, l_quantity)) AS d, arg_max(l_linestatus, (l_linenumber, l_partkey, l_quantity)) AS s FROM lineitem GROUP BY 1),
k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)
SELECT k.o_orderkey, coalesce(status, s) AS status, coalesce(status <> s, false) AS conflict, status IS NULL AND s IS NOT NULL AS filled FROM k LEFT JOIN e ON l_orderkey = o_orderkey""",
)
def m09_fill_missing(t):
    known = t.orders.select("o_orderkey", F.when(c("o_orderkey") % 2 != 0, c("o_orderstatus")).alias("status"))
    evidence = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("at"), c("l_linestatus").alias("status"))
    return ledger.fill_missing(known, evidence, "o_orderkey", ["status"], "at")


# --- feeds: documents made of rows, scanned back -----------------------------------------------------------------


def _feed(t, root: str):
    """A document for each customer's orders: events with their sport, scores (none for every fifth), competitions."""
    key = c("o_orderkey").cast("string")
    soccer = c("o_orderkey") % 4 != 0
    event = F.struct(
        key.alias("id"), F.when(c("o_orderkey") % 7 == 0, 1).otherwise(0).cast("long").alias("competitionId"), F.concat(F.lit("H"), key).alias("team1"), F.concat(F.lit("A"), key).alias("team2"), c("o_orderstatus").alias("status"),
        F.unix_millis(c("o_orderdate").cast("timestamp")).alias("eventStartTime"), F.when(c("o_orderkey") % 3 == 0, "HZ").otherwise("45").alias("date"), F.when(c("o_orderkey") % 2 == 0, F.lit(True)).alias("extraTime"), (c("o_orderkey") % 50).cast("int").alias("betMarketsCount"),
    )
    score = F.struct(F.array((c("o_orderkey") % 5).cast("string"), (c("o_orderkey") % 3).cast("string")).alias("currentScore"))
    entry = F.struct(key.alias("k"), event.alias("e"), F.when(c("o_orderkey") % 5 != 0, score).alias("s"), F.when(soccer, key).alias("sport"))
    grouped = t.orders.groupBy("o_custkey").agg(F.collect_list(entry).alias("x"))  # of one customer
    at = lambda v: F.map_from_arrays(F.transform("x", lambda e: e["k"]), F.transform("x", lambda e: e[v]))
    sports = F.create_map(F.lit("soccer"), F.array_compact(F.transform("x", lambda e: e["sport"])))
    groups = F.create_map(F.lit("soccer"), F.array(F.struct(F.lit(0).cast("long").alias("groupId"), F.lit("League").alias("name"), F.lit("Land").alias("parentName"))))
    document = F.to_json(F.create_map(F.lit(root), F.struct(at("e").alias("events"), sports.alias("eventsBySport"), at("s").alias("scores"), groups.alias("sportCompetitionMap"))))
    return grouped.select("o_custkey", document.alias("payload"))


_FEED_SQL = """SELECT o_custkey, '{feed}' AS feed, o_orderkey::VARCHAR AS event_id, 'H' || o_orderkey AS home, 'A' || o_orderkey AS away, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'HZ' ELSE '45' END AS clock, o_orderdate::TIMESTAMP AS kickoff,
CASE WHEN o_orderkey % 7 <> 0 THEN 'League' END AS competition, CASE WHEN o_orderkey % 7 <> 0 THEN 'Land' END AS country, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 5)::INT END AS home_score, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 3)::INT END AS away_score,
CASE WHEN o_orderkey % 15 IN (3, 6, 9, 12) THEN (o_orderkey % 5)::INT END AS home_ht, CASE WHEN o_orderkey % 15 IN (3, 6, 9, 12) THEN (o_orderkey % 3)::INT END AS away_ht, CASE WHEN o_orderkey % 2 = 0 THEN true END AS extra_time, NULL::BOOLEAN AS penalties, (o_orderkey % 50)::INT AS markets
FROM orders WHERE o_orderkey % 4 <> 0"""


@query("s01_live_feed", _FEED_SQL.format(feed="live"))
def s01_live_feed(t):
    return feeds.events_of_feed(_feed(t, "LIVE"))


@query("s02_upcoming_feed", _FEED_SQL.format(feed="upcoming"))
def s02_upcoming_feed(t):
    return feeds.events_of_feed(_feed(t, "UPCOMING"), "upcoming", "UPCOMING")


@query("p01_event_rows", f"SELECT event_id, home || ' - ' || away AS title, coalesce(home_score + away_score, -1) AS goals, kickoff FROM ({_FEED_SQL.format(feed='live')})")
def p01_event_rows(t):
    rows = feeds.events_of_feed(_feed(t, "LIVE"))
    return rows.select("event_id", F.concat_ws(" - ", "home", "away").alias("title"), F.coalesce(c("home_score") + c("away_score"), F.lit(-1)).alias("goals"), "kickoff")


@query(
    "s03_event_detail",
    """WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity), o AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'paused' ELSE 'open' END AS status, l_linenumber % 3 <> 0 AND 0.5 + l_linenumber > 1 AS can FROM l),
m AS (SELECT l_orderkey, l_returnflag, CASE WHEN bool_or(can) THEN 'open' ELSE 'paused' END AS market_status FROM o GROUP BY ALL)
SELECT o.l_orderkey::VARCHAR AS event_id, o.l_returnflag AS market_id, 'type-' || o.l_returnflag AS market_type, o.l_linenumber::VARCHAR AS outcome_id, 0.5 + l_linenumber AS odds, o.status, market_status, can AND market_status = 'open' AS available FROM o JOIN m USING (l_orderkey, l_returnflag)""",
)
def s03_event_detail(t):
    once = keyed(t.lineitem, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_returnflag", F.struct("l_partkey", "l_quantity")).alias("l_returnflag"))
    outcome = F.struct(c("l_linenumber").cast("string").alias("id"), (c("l_linenumber") + 0.5).alias("quoteFloatValue"), F.when(c("l_linenumber") % 3 == 0, "PAUSED").alias("status"))
    entry = F.struct(c("l_linenumber").cast("long").alias("n"), c("l_returnflag").alias("m"), outcome.alias("o"))
    orders = once.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("x"))  # of one order
    markets = F.array_distinct(F.transform("x", lambda e: e["m"]))
    groups = F.map_from_arrays(markets, F.transform(markets, lambda m: F.struct(m.alias("id"), F.concat(F.lit("type-"), m).alias("type"))))
    listed = F.map_from_arrays(markets, F.transform(markets, lambda m: F.transform(F.filter("x", lambda e: e["m"] == m), lambda e: e["n"])))
    results = F.map_from_arrays(F.transform("x", lambda e: e["n"].cast("string")), F.transform("x", lambda e: e["o"]))
    document = F.to_json(F.struct(F.struct(c("l_orderkey").cast("string").alias("id")).alias("event"), groups.alias("oddGroups"), listed.alias("oddGroupResultsMap"), results.alias("results")))
    return feeds.outcomes_of_detail(orders.select(document.alias("payload"))).select("event_id", "market_id", "market_type", "outcome_id", "odds", "status", "market_status", "available")


@query(
    "s08_daily_feed",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 2 ORDER BY c_mktsegment, c_custkey) = 1 AS first FROM customer)
SELECT c_nationkey, c_mktsegment AS league_id, 'L ' || c_mktsegment AS league, (c_custkey // 2)::VARCHAR AS match_id, c_name AS home, TIMESTAMP '2026-01-01' + to_seconds(c_custkey) AS kickoff, c_custkey % 2 = 0 AS finished, first FROM r""",
)
def s08_daily_feed(t):
    match = F.struct(
        c("c_custkey").alias("_o"), F.floor(c("c_custkey") / 2).cast("string").alias("id"), F.struct(c("c_name").alias("name")).alias("home"),
        F.struct(F.date_format(F.timestamp_seconds(F.lit(1767225600) + c("c_custkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcTime"), (c("c_custkey") % 2 == 0).alias("finished")).alias("status"),
    )
    leagues = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list(match)).alias("m"))
    league = F.struct(c("c_mktsegment").alias("id"), F.concat(F.lit("L "), "c_mktsegment").alias("name"), c("m").alias("matches"))
    days = leagues.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(league)).alias("leagues"))  # of one nation: the document
    rows = feeds.matches_of_daily(days.select("c_nationkey", F.to_json(F.struct("leagues")).alias("payload")))
    return rows.select("c_nationkey", "league_id", "league", "match_id", "home", "kickoff", "finished", "first")


@query(
    "s10_match_stats",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 7 AS h, o_orderkey % 5 AS a FROM orders), p AS (SELECT *, unnest(['ALL', 'FIRST_HALF']) AS period FROM s), m AS (SELECT *, unnest(['corners', 'possession']) AS metric FROM p)
SELECT o_orderkey AS match_id, period, metric, (CASE WHEN metric = 'corners' THEN h ELSE h + 0.5 END)::DOUBLE AS home, CASE WHEN metric = 'corners' THEN a ELSE a + 0.5 END::DOUBLE AS away FROM m WHERE period = 'ALL' OR o_orderkey % 2 = 0""",
)
def s10_match_stats(t):
    h, a = c("o_orderkey") % 7, c("o_orderkey") % 5
    stat = lambda title, left, right: F.struct(F.lit(title).alias("title"), F.array(left, right).alias("stats"))
    share = lambda n: F.concat(n.cast("string"), F.lit(",5 %"))
    group = F.struct(F.array(F.struct(F.array(stat("Corner kicks", h.cast("string"), a.cast("string")), stat("Ball possession", share(h), share(a))).alias("stats"))).alias("stats"))
    both = F.create_map(F.lit("All"), group, F.lit("FirstHalf"), group)
    periods = F.when(c("o_orderkey") % 2 == 0, both).otherwise(F.create_map(F.lit("All"), group))
    payload = F.to_json(F.struct(F.struct(F.struct(periods.alias("Periods")).alias("stats")).alias("content")))
    return documents.period_stats(t.orders.select(c("o_orderkey").alias("match_id"), payload.alias("payload")))
