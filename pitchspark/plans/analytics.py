"""Windows, statistics, expressions, ledgers and composites over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchspark.functions import numbers, text, times
from pitchspark.operators import aggregates as agg
from pitchspark.operators import joins, ledger, matching, reshape, selection, windows
from pitchspark.plans.registry import query

_TRADES = """trades AS (SELECT l_returnflag AS variant, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS stake, CASE WHEN l_discount >= 0.05 THEN round(l_quantity * l_discount, 4) ELSE -l_quantity * 0.04 END AS pnl,
CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS outcome, CAST(l_shipdate AS DATE) AS day, l_linestatus = 'F' AS resolved, l_shipdate, l_extendedprice FROM lineitem)"""


def trades(t):
    """Lines as trades: quantity staked, a gain for a discount of 5 % or more and else a small loss, F is resolved."""
    gain = F.when(F.col("l_discount") >= 0.05, F.round(F.col("l_quantity") * F.col("l_discount"), 4)).otherwise(-F.col("l_quantity") * 0.04)
    outcome = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select(
        F.col("l_returnflag").alias("variant"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").alias("stake"), gain.alias("pnl"),
        outcome.alias("outcome"), F.to_date("l_shipdate").alias("day"), (F.col("l_linestatus") == "F").alias("resolved"), "l_shipdate", "l_extendedprice",
    )


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "stake", "pnl", "l_extendedprice"]


@query(
    "w01_change_only",
    """SELECT event_id, user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR b IS DISTINCT FROM event_type""",
)
def w01_change_only(t):
    return windows.change_only(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "ts", "event_type")


@query(
    "w02_transitions",
    """WITH e AS (SELECT event_id, user_id, ts, value > 100 AS eligible, event_type AS source FROM events),
x AS (SELECT *, lag(eligible) OVER w AS was, lag(source) OVER w AS had, coalesce(max(eligible::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ever
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN eligible AND ever = 0 THEN 'FIRST_ELIGIBLE' WHEN eligible AND NOT was THEN 'ELIGIBLE' WHEN NOT eligible AND was THEN 'INELIGIBLE' WHEN eligible AND was AND source IS DISTINCT FROM had THEN 'BEST_ODDS_SOURCE_CHANGED' END AS transition FROM x""",
)
def w02_transitions(t):
    rows = t.events.select("event_id", "user_id", "ts", (F.col("value") > 100).alias("eligible"), F.col("event_type").alias("source"))
    return windows.transitions(rows, ["user_id"], ["ts", "event_id"], "eligible", "source").select("event_id", "transition")


@query("w03_first_row", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min(ts) AS ts FROM events GROUP BY 1")
def w03_first_row(t):
    return joins.first_by(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query(
    "w04_drawdown",
    f"""WITH {_TRADES}, s AS (SELECT variant, l_suppkey, sum(pnl) OVER w AS b FROM trades WHERE resolved WINDOW w AS (PARTITION BY variant, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, stake, pnl, l_extendedprice ROWS UNBOUNDED PRECEDING)),
r AS (SELECT variant, l_suppkey, row_number() OVER w AS k, sum(pnl) OVER w AS b FROM trades WHERE resolved WINDOW w AS (PARTITION BY variant, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, stake, pnl, l_extendedprice ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(b) OVER (PARTITION BY variant, l_suppkey ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak FROM r)
SELECT variant, l_suppkey, round(arg_max(b, k), 4) AS balance, round(max(peak), 4) AS peak, round(max(peak - b), 4) AS max_drawdown FROM p GROUP BY ALL""",
)
def w04_drawdown(t):
    order = [c for c in _ORDER if c != "l_suppkey"]
    found = windows.drawdown(trades(t).where("resolved"), ["variant", "l_suppkey"], order, "pnl")
    return found.select("variant", "l_suppkey", *[F.round(c, 4).alias(c) for c in ("balance", "peak", "max_drawdown")])


@query(
    "w05_loss_streaks",
    f"""WITH {_TRADES}, r AS (SELECT l_suppkey, pnl < 0 AS lost, row_number() OVER w AS k, sum((pnl < 0)::INT) OVER w AS s FROM trades WHERE resolved
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, stake, pnl, l_extendedprice, variant ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, max(n)::BIGINT AS losses FROM (SELECT l_suppkey, k - s, sum(lost::INT) AS n FROM r GROUP BY 1, 2) GROUP BY 1""",
)
def w05_loss_streaks(t):
    order = [*[c for c in _ORDER if c != "l_suppkey"], "variant"]
    return windows.longest_streaks(trades(t).where("resolved"), ["l_suppkey"], order, {"losses": F.col("pnl") < 0})


def _cents(t):
    """Orders with whole cents, whose sums don't depend on their order."""
    return t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


@query(
    "w06_prior_mean",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS b FROM orders)
SELECT a.o_orderkey, round(avg(round(p.o_totalprice * 100)::BIGINT), 4) AS prior_mean FROM r a LEFT JOIN r p ON p.o_custkey = a.o_custkey AND p.k <= a.b AND p.k > a.b - 5 GROUP BY 1""",
)
def w06_prior_mean(t):
    found = windows.prior_mean(_cents(t), ["o_custkey"], "o_orderdate", "cents", 5, ["o_orderkey"], "prior_mean")
    return found.select("o_orderkey", F.round("prior_mean", 4).alias("prior_mean"))


@query(
    "w07_season_mean_strict",
    """SELECT o_orderkey, round(avg(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY epoch_us(o_orderdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS mean FROM orders""",
)
def w07_season_mean_strict(t):
    rows = _cents(t).withColumn("year", F.year("o_orderdate"))
    return windows.expanding_mean(rows, ["o_custkey", "year"], "o_orderdate", "cents", "mean").select("o_orderkey", F.round("mean", 4).alias("mean"))


@query(
    "w08_expanding_mean_rows",
    """SELECT o_orderkey, round(avg(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS mean FROM orders""",
)
def w08_expanding_mean_rows(t):
    found = windows.expanding_mean(_cents(t), ["o_custkey"], "o_orderdate", "cents", "mean", strict=False, tie=("o_orderkey",))
    return found.select("o_orderkey", F.round("mean", 4).alias("mean"))


@query(
    "w09_first_crossing",
    """SELECT user_id, threshold, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events, (VALUES (60.0::DOUBLE), (120.0), (240.0), (480.0)) v(threshold) WHERE value >= threshold GROUP BY 1, 2""",
)
def w09_first_crossing(t):
    return windows.first_crossings(t.events, ["user_id"], "ts", "value", [60, 120, 240, 480], ["event_id"])


@query(
    "w10_momentum",
    """SELECT o_custkey, sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 1 END)::BIGINT - sum(CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 1 END)::BIGINT AS momentum FROM orders GROUP BY 1""",
)
def w10_momentum(t):
    year = lambda y: F.sum(F.when(F.year("o_orderdate") == y, 1))
    return reshape.momentum(t.orders.groupBy("o_custkey").agg(year(1997).alias("now"), year(1996).alias("before")), "now", "before", "momentum").select("o_custkey", "momentum")


@query(
    "w11_decay_weights",
    """SELECT o_orderkey, round(exp(-ln(2) * ((SELECT max(epoch_us(o_orderdate)) FROM orders) - epoch_us(o_orderdate)) / 1e6 / 86400 / 365.25), 8) AS weight FROM orders""",
)
def w11_decay_weights(t):
    last = t.orders.agg(F.max("o_orderdate").alias("last"))  # one row
    age = times.seconds_between("last", "o_orderdate")
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", F.round(numbers.decay_weight(age, 365.25), 8).alias("weight"))


@query(
    "w12_walk_forward",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders), c AS (SELECT *, n - round_even(0.2 * n, 0)::BIGINT AS cut FROM r)
SELECT o_orderkey, CASE WHEN k > cut THEN 'LOCKED' ELSE 'FOLD' || least(3, (k - 1) // greatest(1, cut // 4)) END AS part FROM c""",
)
def w12_walk_forward(t):
    return windows.walk_forward(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


@query(
    "a12_trade_summary",
    f"""WITH {_TRADES}, g AS (SELECT variant, count(*) AS trades, sum(resolved::INT)::BIGINT AS settled, sum((resolved AND pnl > 0)::INT)::BIGINT AS won, sum((resolved AND pnl < 0)::INT)::BIGINT AS lost,
count(DISTINCT CASE WHEN resolved THEN day END) AS days, round(sum(CASE WHEN resolved THEN stake ELSE 0 END), 2) AS stake, round(sum(CASE WHEN resolved THEN pnl ELSE 0 END), 2) AS pnl, quantile_cont(CASE WHEN resolved THEN pnl END, 0.5) AS median_pnl FROM trades GROUP BY 1)
SELECT variant, trades, settled, won, lost, days, stake, pnl, round(median_pnl, 6) AS median_pnl, round(CASE WHEN stake > 0 THEN pnl / stake END, 6) AS roi, round(CASE WHEN settled > 0 THEN won / settled END, 6) AS hit_rate,
CASE WHEN settled < 30 THEN 'SMALL_SAMPLE' ELSE 'OK' END AS sample_status FROM g""",
)
def a12_trade_summary(t):
    found = agg.trade_summary(trades(t), ["variant"], "stake", "pnl", "outcome", "day", F.col("resolved"))
    rounded = [F.round(c, 6).alias(c) for c in ("median_pnl", "roi", "hit_rate")]
    return found.select("variant", "trades", "settled", "won", "lost", "days", "stake", "pnl", *rounded, "sample_status")


_WILSON = """round({c}((k/n + 3.841458820694124 / (2*n) {s} 1.959963984540054 * sqrt(k/n * (1 - k/n) / n + 3.841458820694124 / (4*n*n))) / (1 + 3.841458820694124 / n), {l}), 6)"""


@query(
    "a13_wilson",
    f"""SELECT c_nationkey, n::BIGINT AS n, k::BIGINT AS k, {_WILSON.format(c='greatest', s='-', l='0')} AS low, {_WILSON.format(c='least', s='+', l='1')} AS high
FROM (SELECT c_nationkey, count(*)::DOUBLE AS n, sum((c_acctbal > 0)::INT)::DOUBLE AS k FROM customer GROUP BY 1)""",
)
def a13_wilson(t):
    low, high = numbers.wilson("k", "n")
    rows = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), agg.count_if(F.col("c_acctbal") > 0).alias("k"))
    return rows.withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


@query(
    "a14_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1""",
)
def a14_percentiles(t):
    value = numbers.finite("value")
    found = selection.exact_quantiles(t.events, ["event_type"], {"median": (value, 0.5), "low": (value, 0.025), "high": (value, 0.975)})
    return found.select("event_type", *[F.round(x, 6).alias(x) for x in ("median", "low", "high")])


@query("a15_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def a15_nearest_rank(t):
    return selection.exact_quantiles(t.events, ["event_type"], {"p95": (F.col("value"), 0.95)}, "nearest")


@query(
    "a17_calibration",
    """WITH p AS (SELECT l_discount * 10 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), c AS (SELECT least(19, floor(p * 20))::INT AS bin, count(*) AS n, avg(p) AS m, avg(y) AS o FROM p WHERE p >= 0 AND p < 1 GROUP BY 1)
SELECT i::INT AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_predicted, round(o, 6) AS observed FROM range(20) r(i) LEFT JOIN c ON c.bin = i""",
)
def a17_calibration(t):
    rows = t.lineitem.select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return agg.calibration(rows, "p", "y").select("bin", "n", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("observed", 6).alias("observed"))


@query(
    "a19_legacy_buckets",
    """SELECT round(coalesce(trunc(l_discount / 0.05), 0) * 0.05, 2) AS bucket, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""",
)
def a19_legacy_buckets(t):
    bucket = F.round(agg.legacy_bucket(F.col("l_discount")), 2)
    return t.lineitem.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "a20_ledger_balance",
    """SELECT c_custkey, round(1000 + coalesce(m, 0), 2) AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def a20_ledger_balance(t):
    accounts = t.customer.select("c_custkey", F.lit(1000.0).alias("start"))
    moves = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return ledger.balances(accounts, moves, "c_custkey", "start", "o_totalprice").select("c_custkey", F.round("balance", 2).alias("balance"))


@query(
    "a21_windowed_wide",
    """SELECT l_suppkey, """
    + ", ".join(
        f"round(sum(CASE WHEN month(l_shipdate) {w} AND l_linestatus = '{s}' THEN l_quantity END), 4) AS {n}_{wn}_quantity"
        for wn, w in (("h1", "<= 6"), ("h2", "> 6"))
        for n, s in (("home", "F"), ("away", "O"))
    )
    + " FROM lineitem GROUP BY 1",
)
def a21_windowed_wide(t):
    month, side = F.month("l_shipdate"), F.col("l_linestatus")
    found = reshape.windowed_wide(t.lineitem, ["l_suppkey"], {"h1": month <= 6, "h2": month > 6}, {"home": side == "F", "away": side == "O"}, {"quantity": F.col("l_quantity")})
    return found.select("l_suppkey", *[F.round(c, 4).alias(c) for c in found.columns if c != "l_suppkey"])


@query(
    "a22_timeline",
    """SELECT user_id, sum(CASE WHEN event_type = 'purchase' AND day(ts) <= 15 THEN 1 ELSE 0 END)::BIGINT AS first_half, min(CASE WHEN event_type = 'purchase' THEN ts END) AS first_goal, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_goal FROM events GROUP BY 1""",
)
def a22_timeline(t):
    goal = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(
        agg.count_if(goal & (F.dayofmonth("ts") <= 15)).alias("first_half"), F.min(F.when(goal, F.col("ts"))).alias("first_goal"), F.max(F.when(goal, F.col("ts"))).alias("last_goal")
    )


@query(
    "a23_classification_metrics",
    """WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_discount + 0.1 AS p0, l_tax + 0.2 AS p1, 1 - (l_discount + 0.1) - (l_tax + 0.2) AS p2 FROM lineitem)
SELECT count(*) AS n, round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss, round(avg(pow(p0 - (y = 0)::INT, 2) + pow(p1 - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2)), 6) AS brier,
round(avg(pow(p1 - (y = 1)::INT, 2)), 6) AS p1_brier, round(abs(avg(p1) - avg((y = 1)::INT)), 6) AS p1_bias FROM p""",
)
def a23_classification_metrics(t):
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    rows = t.lineitem.select(y.alias("y"), (F.col("l_discount") + 0.1).alias("p0"), (F.col("l_tax") + 0.2).alias("p1")).withColumn("p2", 1 - F.col("p0") - F.col("p1"))
    found = agg.classification_metrics(rows, "y", ["p0", "p1", "p2"])
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "p1_brier", "p1_bias")])


@query("a24_json_keys", "SELECT 'k' AS key, count(*) AS n, 1.0::DOUBLE AS share, 'HIGH' AS label FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def a24_json_keys(t):
    return agg.json_key_coverage(t.events, "props")


@query(
    "a25_category_counts",
    """SELECT 'big' AS category, count(*) AS n FROM events WHERE value > 100 UNION ALL SELECT 'buy', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'big_buy', count(*) FROM events WHERE event_type = 'purchase' AND value > 100""",
)
def a25_category_counts(t):
    big, buy = F.col("value") > 100, F.col("event_type") == "purchase"
    return reshape.category_counts(t.events, {"big": big, "buy": buy, "big_buy": big & buy})


@query(
    "a27_sliding_counts",
    """WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, sum((ts >= now - INTERVAL 60 MINUTE)::INT)::BIGINT AS last_60, sum((ts >= now - INTERVAL 1440 MINUTE)::INT)::BIGINT AS last_1440 FROM events, n GROUP BY 1""",
)
def a27_sliding_counts(t):
    now = t.events.agg(F.max("ts").alias("now"))  # one row
    return windows.sliding_counts(t.events.crossJoin(F.broadcast(now)), F.col("now"), "ts", (60, 1440), "event_type")


@query("a28_slow_counts", "SELECT event_type, count(*) AS n FROM events WHERE value >= 300 GROUP BY 1")
def a28_slow_counts(t):
    return t.events.where("value >= 300").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "a29_latency",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS top, list_sort(list(value))[greatest(1, floor(count(*) * 0.95)::INT)] AS p95, round(avg((value >= 400)::INT), 8) AS error_rate FROM events GROUP BY 1""",
)
def a29_latency(t):
    """p95 by the truncating rule; values of 400 and more stand for errors."""
    found = t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("top"), F.round(F.avg((F.col("value") >= 400).cast("int")), 8).alias("error_rate")
    )
    return found.join(selection.exact_quantiles(t.events, ["event_type"], {"p95": (F.col("value"), 0.95)}, "truncated"), "event_type")


@query(
    "a31_worker_choice",
    """WITH g AS (SELECT l_linenumber AS workers, count(*) AS throughput FROM lineitem GROUP BY 1) SELECT min(workers) AS workers FROM g WHERE throughput >= 0.95 * (SELECT max(throughput) FROM g)""",
)
def a31_worker_choice(t):
    from pyspark.sql.window import Window

    each = t.lineitem.groupBy(F.col("l_linenumber").alias("workers")).agg(F.count("*").alias("n"))
    best = each.withColumn("best", F.max("n").over(Window.partitionBy()))  # one row per worker count
    return best.where("n >= 0.95 * best").agg(F.min("workers").alias("workers"))


@query("f02_fold_umlauts", "SELECT doc_id, replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS folded FROM documents WHERE lang = 'de'")
def f02_fold_umlauts(t):
    return t.documents.where("lang = 'de'").select("doc_id", text.fold_umlauts("text").alias("folded"))


@query("f06_numbers", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS DOUBLE) AS number FROM customer")
def f06_numbers(t):
    return t.customer.select("c_custkey", text.last_number("c_name").alias("number"))


@query("f11_age_bucket", "SELECT event_id, CASE WHEN h < 24 THEN 'LT_24H' WHEN h < 168 THEN 'LT_7D' ELSE 'GE_7D' END AS age FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 AS h FROM events)")
def f11_age_bucket(t):
    return t.events.select("event_id", times.age_bucket(times.seconds_between(F.lit("2024-01-31"), "ts") / 3600).alias("age"))


@query("f12_season", "SELECT o_orderkey, CASE WHEN month(d) >= 7 THEN year(d) || '/' || lpad(((year(d) + 1) % 100)::VARCHAR, 2, '0') ELSE (year(d) - 1) || '/' || lpad((year(d) % 100)::VARCHAR, 2, '0') END AS season FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")
def f12_season(t):
    return t.orders.select("o_orderkey", times.season_label("o_orderdate").alias("season"))


@query("f13_stable_id", "SELECT user_id, 'match_' || left(sha256('FEED:' || user_id), 24) AS id FROM (SELECT DISTINCT user_id FROM events)")
def f13_stable_id(t):
    return t.events.select("user_id").distinct().select("user_id", text.stable_id("user_id", "FEED").alias("id"))


@query(
    "f17_power",
    """WITH RECURSIVE b AS (SELECT event_id, 1 / value AS p, 1 / 1.2::DOUBLE AS q, 0::DOUBLE AS lo, 100::DOUBLE AS hi, 0 AS k FROM events WHERE value > 1 UNION ALL
SELECT event_id, p, q, CASE WHEN pow(p, (lo + hi) / 2) + pow(q, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(p, (lo + hi) / 2) + pow(q, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM b WHERE k < 80)
SELECT event_id, round(pow(p, (lo + hi) / 2), 8) AS p FROM b WHERE k = 80""",
)
def f17_power(t):
    return t.events.where("value > 1").select("event_id", F.round(numbers.power_probability("value", F.lit(1.2)), 8).alias("p"))


@query(
    "f18_pair_features",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount + l_tax AS x_total, l_discount - l_tax AS x_diff, round(CASE WHEN l_discount + l_tax <> 0 THEN l_discount / (l_discount + l_tax) END, 8) AS x_share, round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 8) AS x_ratio FROM lineitem""",
)
def f18_pair_features(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *numbers.pair_features("l_discount", "l_tax", "x"))
    return rows.drop("x_home", "x_away").withColumn("x_share", F.round("x_share", 8)).withColumn("x_ratio", F.round("x_ratio", 8))


@query("f24_haircut", "SELECT event_id, round(1 + (value - 1) * 0.95, 8) AS stressed FROM events WHERE value > 1")
def f24_haircut(t):
    return t.events.where("value > 1").select("event_id", F.round(numbers.haircut("value", 0.05), 8).alias("stressed"))


@query("p04_freshness", "SELECT event_id, ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-30'")
def p04_freshness(t):
    now = F.lit("2024-01-30").cast("timestamp")
    return t.events.where("ts <= '2024-01-30'").select("event_id", times.is_fresh("ts", now, 2 * 86400).alias("fresh"))


@query(
    "x01_unpivot",
    """SELECT o_orderkey, 'price' AS metric, o_totalprice AS home, o_custkey::DOUBLE AS away FROM orders UNION ALL SELECT o_orderkey, 'key', o_orderkey::DOUBLE, NULL FROM orders""",
)
def x01_unpivot(t):
    rows = t.orders.withColumn("none", F.lit(None).cast("double"))
    return reshape.unpivot_pairs(rows, ["o_orderkey"], {"price": ("o_totalprice", "o_custkey"), "key": ("o_orderkey", "none")})


@query(
    "m01_merge",
    """SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1""",
)
def m01_merge(t):
    """The first half of the stream as the table, the rest as changes."""
    rows = t.events.select("user_id", "ts", "event_type", F.col("value").alias("low"), F.col("value").alias("high"))
    return ledger.merge(rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-15'"), ["user_id"], "ts", {"event_type": "last", "low": "min", "high": "max"})


@query(
    "m02_revision",
    """WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.v, a.v) AS event_type, CASE WHEN a.user_id IS NULL THEN 1 WHEN a.v IS DISTINCT FROM b.v THEN 2 ELSE 1 END AS revision FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
def m02_revision(t):
    last = lambda rows: joins.latest_by(rows.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")
    old = last(t.events.where("ts < '2024-01-15'")).withColumn("revision", F.lit(1))
    return ledger.revise(old, last(t.events), ["user_id"], ["event_type"])[0]


@query("m03_replace_by_key", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def m03_replace_by_key(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return ledger.replace_by_key(rows, rows.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query(
    "m05_reserve",
    """WITH RECURSIVE s AS (SELECT o_custkey AS portfolio, o_orderkey AS entry_id, CASE WHEN o_orderstatus = 'F' THEN 0.4 ELSE -1.0 END::DECIMAL(4,1) AS pnl, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
f AS (SELECT portfolio, 0::BIGINT AS entry_id, 0::BIGINT AS k, 0::DECIMAL(18,2) AS stake, 100::DECIMAL(18,2) AS balance, 'OK' AS reason FROM (SELECT DISTINCT portfolio FROM s)
UNION ALL SELECT portfolio, entry_id, k, CASE WHEN w <= b THEN w ELSE 0 END::DECIMAL(18,2), (b + round(CASE WHEN w <= b THEN w ELSE 0 END * pnl, 2))::DECIMAL(18,2), CASE WHEN w > b THEN 'INSUFFICIENT_BANKROLL' ELSE 'OK' END
FROM (SELECT s.portfolio, s.entry_id, s.k, s.pnl, f.balance AS b, least(40::DECIMAL(18,2), greatest(6::DECIMAL(18,2), round(f.balance * 0.35, 2)))::DECIMAL(18,2) AS w FROM f JOIN s ON s.portfolio = f.portfolio AND s.k = f.k + 1))
SELECT portfolio, entry_id, stake::DOUBLE AS stake, balance::DOUBLE AS balance, reason FROM f WHERE k > 0""",
)
def m05_reserve(t):
    """A third of the running balance and a bit on each order, 6 at least and 40 at most; a customer is a portfolio."""
    share = F.when(F.col("o_orderstatus") == "F", 0.4).otherwise(-1.0)
    rows = t.orders.select(F.col("o_custkey").alias("portfolio"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("entry_id"), share.alias("pnl_share"))
    found = ledger.reserve(rows, 100.0, 0.35, 6.0, 40.0)
    return found.select("portfolio", "entry_id", F.col("stake").cast("double").alias("stake"), F.col("balance").cast("double").alias("balance"), "reason")


@query(
    "m06_settle",
    """SELECT 'settle:' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS idempotency_key, CASE l_returnflag WHEN 'A' THEN round(l_quantity * 1.5, 2) WHEN 'N' THEN l_quantity ELSE 0 END AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND o_orderstatus <> 'P'""",
)
def m06_settle(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    verdict = F.when(F.col("l_returnflag") == "A", "WON").when(F.col("l_returnflag") == "N", "VOID").otherwise("LOST")
    lines = t.lineitem.select(key.alias("trade_id"), F.col("l_orderkey").alias("order"), F.col("l_quantity").alias("stake"), F.round(F.col("l_quantity") * 1.5, 2).alias("payout"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("DONE").alias("status"), verdict.alias("own"))
    lines = lines.withColumn("event_id", F.concat_ws("/", "order", "own"))
    kinds = t.spark.createDataFrame([("WON",), ("VOID",), ("LOST",)], "own string")
    results = t.orders.where("o_orderstatus <> 'P'").crossJoin(F.broadcast(kinds)).select(F.concat_ws("/", "o_orderkey", "own").alias("event_id"), F.col("own").alias("verdict"))
    none = t.spark.createDataFrame([], "idempotency_key string")
    return ledger.settle(lines.drop("order", "own"), results, none).select("idempotency_key", "amount")


@query(
    "m07_fingerprint",
    """WITH h AS (SELECT sha256(o_orderkey || chr(31) || o_orderstatus) AS h FROM orders), b AS (SELECT CAST('0x' || substr(h, 1, 3) AS INT) AS b, sum(CAST('0x' || substr(h, 4, 12) AS BIGINT))::HUGEINT AS s, count(*) AS n FROM h GROUP BY 1), k AS (SELECT lpad(b::VARCHAR, 4, '0') || ':' || s AS k, n FROM b)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS fingerprint FROM k""",
)
def m07_fingerprint(t):
    return ledger.fingerprint(t.orders, ["o_orderkey", "o_orderstatus"])


@query(
    "d03_stake_split",
    """WITH q AS (SELECT event_id, value AS a, 2.5::DOUBLE AS b, round(10000 * 2.5 / (value + 2.5))::BIGINT AS base FROM events WHERE value > 1)
SELECT event_id, list_min([{'gap': abs(s * a - (10000 - s) * b), 'first': s} FOR s IN [base - 1, base, base + 1]]).first AS first FROM q""",
)
def d03_stake_split(t):
    split = numbers.stake_split(F.lit(100.0), "value", F.lit(2.5))
    return t.events.where("value > 1").select("event_id", split["first"].alias("first"))


@query("d04_hedge", "SELECT event_id, round(10 * value / 2.5, 2)::DOUBLE AS hedge FROM events WHERE value > 1")
def d04_hedge(t):
    return t.events.where("value > 1").select("event_id", numbers.hedge_profile(F.lit(10.0), "value", F.lit(2.5))["hedge"].cast("double").alias("hedge"))


@query(
    "d07_variant_study",
    f"""WITH {_TRADES}, v AS (SELECT * FROM (VALUES ('R00', -1e9::DOUBLE, NULL), ('R01', 10.0, 25.0), ('R02', 25.0, NULL)) v(rule, low, high))
SELECT rule, variant, count(*) AS trades, round(sum(pnl), 2) AS pnl, round(sum(pnl) / sum(stake), 6) AS roi FROM trades JOIN v ON stake >= low AND (high IS NULL OR stake < high) WHERE resolved GROUP BY ALL""",
)
def d07_variant_study(t):
    rules = t.spark.createDataFrame([("R00", -1e9, None), ("R01", 10.0, 25.0), ("R02", 25.0, None)], "rule string, low double, high double")
    rows = joins.range_join(trades(t).where("resolved"), rules, F.col("stake"))
    return rows.groupBy("rule", "variant").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 2).alias("pnl"), F.round(F.sum("pnl") / F.sum("stake"), 6).alias("roi"))


def _fixtures(t):
    """Suppliers and customers as fixtures of two sources, with kickoffs by number; names differ by a letter of some."""
    at = lambda key: F.timestamp_seconds(F.col(key) * 3600)
    a = t.supplier.select(F.col("s_suppkey").alias("fixture_id"), F.col("s_name").alias("home"), F.concat(F.lit("Away "), "s_name").alias("away"), at("s_suppkey").alias("kickoff"), F.col("s_nationkey").cast("string").alias("country"), F.lit("League").alias("competition"))
    name = lambda word: F.replace("c_name", F.lit("Customer"), F.lit(word))
    home = F.when(F.col("c_custkey") % 2 == 0, name("Suppliar")).otherwise(name("Supplier"))
    b = t.customer.select(F.col("c_custkey").alias("fixture_id"), home.alias("home"), F.concat(F.lit("Away "), name("Supplier")).alias("away"), at("c_custkey").alias("kickoff"), F.lit(None).cast("string").alias("country"), F.when(F.col("c_custkey") % 3 == 0, "League").otherwise("Leagues").alias("competition"))
    return a, b


@query("j11_fuzzy_match")
def j11_fuzzy_match(t):
    return matching.match(*_fixtures(t))


@query("j12_alias_variants")
def j12_alias_variants(t):
    """With a second spelling of some names."""
    a, b = _fixtures(t)
    aliases = b.where("fixture_id % 4 = 0").select(F.col("home").alias("name"), F.replace("home", F.lit("Suppliar"), F.lit("Supplier")).alias("alias"))
    return matching.match(a, b, aliases)


_RATE = "CASE state WHEN 'STABLE' THEN least(60, rate + 2) WHEN 'UNSTABLE' THEN greatest(1, rate / 2) ELSE greatest(1, rate * 0.75) END"


@query(
    "t06_rate_decisions",
    f"""WITH RECURSIVE r AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 20 AS k FROM events), w AS (SELECT event_type, k, CASE WHEN bool_or(value > 488) THEN 'UNSTABLE' WHEN avg((value > 470)::INT) > 0.1 OR quantile_disc(value * 4.3, 0.95) > 2000 THEN 'DEGRADED' ELSE 'STABLE' END AS state FROM r GROUP BY ALL HAVING count(*) = 20),
f AS (SELECT event_type, -1::BIGINT AS k, '' AS state, 10::DOUBLE AS rate FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT event_type, k, state, {_RATE} FROM (SELECT w.event_type, w.k, w.state, f.rate FROM f JOIN w ON w.event_type = f.event_type AND w.k = f.k + 1))
SELECT event_type, k AS window, state, round(rate, 6) AS rate FROM f WHERE k >= 0""",
)
def t06_rate_decisions(t):
    c = F.col("value")
    rows = t.events.select("event_type", "ts", "event_id", F.when(c > 488, 429).otherwise(200).alias("status"), (c <= 470).alias("ok"), F.lit(False).alias("parse_failure"), (c * 4.3).alias("elapsed_ms"))
    return windows.rate_decisions(rows, ["event_type"], ["ts", "event_id"]).select("event_type", "window", "state", F.round("rate", 6).alias("rate"))


@query("f01_names", "SELECT c_custkey, 'customer and sohne ' || c_custkey AS name FROM customer")
def f01_names(t):
    return t.customer.select("c_custkey", text.normal_name(F.concat(F.lit("  Customer & SÖHNE-"), F.col("c_custkey").cast("string"))).alias("name"))


@query("f15_binary_round", "SELECT event_id, value FROM events")
def f15_binary_round(t):
    """Values have two digits already, so rounding by their binary value changes none."""
    return t.events.select("event_id", numbers.python_round("value").alias("value"))


@query("f19_json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f19_json_paths(t):
    return t.events.select("event_id", numbers.first_path("props", ("$.missing.deep", "$.k")).alias("k"))


@query("f09_partition_keys", "SELECT year, month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders) GROUP BY ALL")
def f09_partition_keys(t):
    return t.orders.select(*times.partition_keys("o_orderdate")).groupBy("year", "month").agg(F.count("*").alias("n"))


@query("f20_array_ops", "SELECT user_id, list_sort(list(DISTINCT event_type)) IS NOT NULL AS known, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def f20_array_ops(t):
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    both = numbers.appended(F.col("k"), F.col("k"))
    return kinds.select("user_id", numbers.same_ids(F.col("k"), both).alias("known"), F.size(both).cast("long").alias("kinds"))
