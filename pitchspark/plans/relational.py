"""Joins, aggregates, ordering and set operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchspark.functions.numbers import break_even, missing_to_ninety, ratio, two_way_probability
from pitchspark.operators import aggregates as agg
from pitchspark.operators import joins, ordering, scans, sets
from pitchspark.plans.registry import query

#: (bin, low, high): half-open ranges of the order value; the last is open.
PRICE_BINS = [("A", 0.0, 50000.0), ("B", 50000.0, 150000.0), ("C", 150000.0, 300000.0), ("D", 300000.0, None)]
_BINS_SQL = "(VALUES ('A', 0.0::DOUBLE, 50000.0::DOUBLE), ('B', 50000.0, 150000.0), ('C', 150000.0, 300000.0), ('D', 300000.0, NULL)) b(bin, low, high)"


@query(
    "d00_best_pair",
    """WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE value > 1 GROUP BY ALL),
p AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS a, max(CASE WHEN event_type = 'click' THEN value END) AS b FROM l GROUP BY 1)
SELECT user_id, a, b, round((1/a) / (1/a + 1/b), 8) AS p, round(1 - (1/a + 1/b), 8) AS break_even FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def d00_best_pair(t):
    """Latest valid quote of each kind per user, paired: probability without margin and break-even."""
    quotes = joins.latest_by(t.events.where("value > 1").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    pairs = joins.two_sided_pairs(quotes, ["user_id"], "event_type", ("view", "click"), "value")
    return pairs.select("user_id", "a", "b", F.round("p", 8).alias("p"), F.round(break_even("a", "b"), 8).alias("break_even"))


@query("j01_inner", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query(
    "j02_using_then_left",
    """SELECT d.doc_id, d.lang, l.quality, b.item_id FROM documents d JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def j02_using_then_left(t):
    return (
        t.documents.select("doc_id", "lang")
        .join(t.labels, "doc_id")
        .join(t.benchmark, F.col("item_id") == F.col("doc_id"), "left")
        .select("doc_id", "lang", "quality", "item_id")
    )


@query(
    "j03_multi_left",
    """SELECT c_custkey, n_name, r_name, s.suppliers FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.s_nationkey = c_nationkey""",
)
def j03_multi_left(t):
    suppliers = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return (
        t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .join(suppliers, F.col("s_nationkey") == F.col("c_nationkey"), "left")
        .select("c_custkey", "n_name", "r_name", "suppliers")
    )


@query(
    "j04_same_table_twice",
    """SELECT k.o_custkey, coalesce(n.top, l.top) AS top FROM (SELECT DISTINCT o_custkey FROM orders) k
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) n USING (o_custkey)
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) l USING (o_custkey)""",
)
def j04_same_table_twice(t):
    """Two filtered reads of a table by one key, the first preferred; one conditional aggregate instead of two joins."""
    top = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return t.orders.groupBy("o_custkey").agg(F.coalesce(top("F"), top("O")).alias("top"))


@query(
    "j05_composite_key_left",
    """SELECT l_orderkey, l_linenumber, l_suppkey, g.n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R') k
LEFT JOIN (SELECT l_orderkey, l_linenumber, l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) g USING (l_orderkey, l_linenumber, l_suppkey)""",
)
def j05_composite_key_left(t):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey"]
    left = t.lineitem.where("l_returnflag = 'R'").select(*keys).distinct()
    right = t.lineitem.where("l_linestatus = 'F'").groupBy(*keys).agg(F.count("*").alias("n"))
    return left.join(right, keys, "left")


@query("j06_anti_left_null", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000 WHERE o_orderkey IS NULL")
def j06_anti_left_null(t):
    """Customers without a large order that is partly done."""
    large = t.orders.where("o_orderstatus = 'P' AND o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.anti_join(t.customer, large, ["c_custkey"]).select("c_custkey", "c_name")


@query("j07_anti_not_exists", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def j07_anti_not_exists(t):
    return joins.anti_join(t.documents, t.labels.where("quality = 1"), ["doc_id"]).select("doc_id", "source")


@query("j08_semi_exists", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j08_semi_exists(t):
    return joins.semi_join(t.documents, t.labels.where("toxic = 1"), ["doc_id"]).select("doc_id", "lang")


@query(
    "j09_tiered_lookup",
    """SELECT s_suppkey, coalesce(a.v, b.v) AS segment, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 END AS tier FROM supplier
LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS v FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a ON a.c_custkey = s_suppkey
LEFT JOIN (SELECT c_nationkey, min(c_mktsegment) AS v FROM customer GROUP BY 1) b ON b.c_nationkey = s_nationkey""",
)
def j09_tiered_lookup(t):
    by_id = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_mktsegment").alias("segment"))
    by_nation = t.customer.select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_mktsegment").alias("segment"))
    return joins.tiered_lookup(t.supplier, [(by_id, ["s_suppkey"]), (by_nation, ["s_nationkey"])], "segment").select("s_suppkey", "segment", "tier")


@query(
    "j10_interval",
    """SELECT o_orderkey, l_linenumber, l_suppkey, l_partkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE abs(epoch_us(o_orderdate) - epoch_us(l_shipdate)) <= 86400000000::BIGINT * 400""",
)
def j10_interval(t):
    """Lines shipped at most 400 days from their order's date, either way."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    found = joins.interval_join(t.orders, lines, "o_orderdate", "l_shipdate", 400 * 86400, ["o_orderkey"])
    return found.select("o_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "o_orderdate", "l_shipdate")


@query("j13_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def j13_latest_state(t):
    return joins.latest_by(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query(
    "j13_latest_with_fallback",
    """WITH p AS (SELECT user_id, 0 AS tier, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' AND value > 200 GROUP BY 1),
e AS (SELECT user_id, 1 AS tier, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT e.user_id, coalesce(p.tier, e.tier) AS tier, coalesce(p.value, e.value) AS value FROM e LEFT JOIN p USING (user_id)""",
)
def j13_latest_with_fallback(t):
    rows = t.events.select("user_id", "ts", "event_id", "value", "event_type")
    tiers = [rows.where("event_type = 'purchase' AND value > 200").drop("event_type"), rows.drop("event_type")]
    return joins.latest_with_fallback(tiers, ["user_id"], ["ts", "event_id"]).select("user_id", "tier", "value")


@query(
    "j13_as_of",
    """SELECT e.event_id, e.user_id, (SELECT arg_max(v.value, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts <= e.ts) AS last_view
FROM events e WHERE e.event_type = 'purchase'""",
)
def j13_as_of(t):
    """The latest view's value at every purchase."""
    buys = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_view"))
    return joins.as_of_join(buys, views, ["user_id"], "ts", "seen", ["last_view"]).select("event_id", "user_id", "last_view")


@query(
    "j14_two_sided_pair",
    """WITH m AS (SELECT user_id, json_extract_string(props, '$.k') AS k, max(CASE WHEN event_type = 'view' AND value > 1 THEN value END) AS a,
max(CASE WHEN event_type = 'click' AND value > 1 THEN value END) AS b FROM events GROUP BY 1, 2)
SELECT user_id, k, a, b, round((1/a) / (1/a + 1/b), 8) AS p FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def j14_two_sided_pair(t):
    quotes = t.events.where("value > 1").withColumn("k", F.get_json_object("props", "$.k"))
    return joins.two_sided_pairs(quotes, ["user_id", "k"], "event_type", ("view", "click"), "value").withColumn("p", F.round("p", 8))


@query(
    "j15_left_with_aggregates",
    """SELECT o_orderkey, coalesce(l.n, 0) AS lines, round(l.q, 4) AS quantity, coalesce(r.n, 0) AS returned FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = o_orderkey""",
)
def j15_left_with_aggregates(t):
    """Both aggregates of the right side in one pass."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), agg.count_if(F.col("l_returnflag") == "R").alias("returned"))
    found = t.orders.select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return found.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.round("quantity", 4).alias("quantity"), F.coalesce("returned", F.lit(0)).alias("returned"))


@query(
    "j16_in_all",
    """SELECT user_id, round(avg(v), 6) AS v FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id, event_type)
GROUP BY 1 HAVING count(*) = 2""",
)
def j16_in_all(t):
    mean = lambda k: t.events.where(F.col("event_type") == k).groupBy("user_id").agg(F.avg("value").alias("v"))
    return joins.in_all([mean("view"), mean("click")], "user_id", ["v"]).withColumn("v", F.round("v", 6))


@query(
    "j17_candidate_queue",
    """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS done FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
WHERE n IS NULL OR done < n ORDER BY rank, o_orderdate, o_orderkey LIMIT 100""",
)
def j17_candidate_queue(t):
    """Orders without lines or with open ones, by status and age; the hundred next are the report."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), agg.count_if(F.col("l_linestatus") == "F").alias("done"))
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    due = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").where("n IS NULL OR done < n")
    return due.withColumn("rank", rank).orderBy("rank", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "rank")


@query("a01_group_count", "SELECT coalesce(event_type, 'UNKNOWN') AS event_type, count(*) AS n FROM events GROUP BY 1")
def a01_group_count(t):
    return t.events.groupBy(F.coalesce("event_type", F.lit("UNKNOWN")).alias("event_type")).agg(F.count("*").alias("n"))


@query("a02_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def a02_count_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query(
    "a03_conditional_counts",
    """SELECT user_id, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 4) AS spent FROM events GROUP BY 1""",
)
def a03_conditional_counts(t):
    spent = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0))
    return t.events.groupBy("user_id").agg(
        agg.count_if(F.col("value") > 100).alias("high"), agg.count_if(F.col("event_type") == "error").alias("errors"), F.round(spent, 4).alias("spent")
    )


@query(
    "a04_distinct_filtered",
    """SELECT o_orderstatus, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS big, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS urgent
FROM orders GROUP BY 1""",
)
def a04_distinct_filtered(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.count_distinct(F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))).alias("big"),
        F.count_distinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey"))).alias("urgent"),
    )


@query(
    "a05_coverage_report",
    """SELECT n_name, count(*) AS customers, min(c_acctbal) AS low, max(c_acctbal) AS high, count(DISTINCT c_mktsegment) AS segments, round(avg(c_acctbal), 4) AS mean
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
)
def a05_coverage_report(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(
        F.count("*").alias("customers"),
        F.min("c_acctbal").alias("low"),
        F.max("c_acctbal").alias("high"),
        F.count_distinct("c_mktsegment").alias("segments"),
        F.round(F.avg("c_acctbal"), 4).alias("mean"),
    )


@query("a06_having_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a06_having_duplicates(t):
    return sets.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a07_count_of_groups", "SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def a07_count_of_groups(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


@query("a08_percent_of_total", "SELECT o_orderpriority, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM orders GROUP BY 1")
def a08_percent_of_total(t):
    return agg.percent_of_total(t.orders, ["o_orderpriority"])


@query(
    "a09_coverage_grouping_sets",
    """SELECT CASE WHEN grouping(r_name) = 1 AND grouping(n_name) = 1 AND grouping(seg) = 1 THEN 'GLOBAL' WHEN grouping(seg) = 0 THEN 'SEGMENT' WHEN grouping(n_name) = 1 THEN 'REGION' ELSE 'NATION' END AS scope,
coalesce(r_name, 'ALL') AS r_name, coalesce(n_name, 'ALL') AS n_name, coalesce(seg, 'ALL') AS seg, count(*) AS customers, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS positive, max(c_acctbal) AS top
FROM (SELECT *, coalesce(c_mktsegment, 'UNKNOWN') AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name), (seg))""",
)
def a09_coverage_grouping_sets(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).withColumnRenamed("c_mktsegment", "seg")
    scopes = [("GLOBAL", []), ("REGION", ["r_name"]), ("NATION", ["r_name", "n_name"]), ("SEGMENT", ["seg"])]
    return agg.coverage(rows, scopes, [F.count("*").alias("customers"), agg.count_if(F.col("c_acctbal") > 0).alias("positive"), F.max("c_acctbal").alias("top")])


@query(
    "a10_ratio_to_target",
    """SELECT o_custkey, count(*) AS d, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 8) AS share,
greatest(0, floor((9 * count(*) + 9) / 10)::BIGINT - sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END))::BIGINT AS missing FROM orders GROUP BY 1""",
)
def a10_ratio_to_target(t):
    rows = t.orders.groupBy("o_custkey").agg(F.count("*").alias("d"), agg.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return rows.withColumn("share", F.round(ratio("n", "d"), 8)).withColumn("missing", missing_to_ninety("n", "d"))


@query(
    "a11_derived_catalog",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS observed, max(o_orderdate) AS last_checked, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, coalesce(observed, 0) AS observed, last_checked, label,
CASE WHEN coalesce(observed, 0) >= 15 THEN 'FULL' WHEN coalesce(observed, 0) <= 5 THEN 'NO_DATA' ELSE 'DISCOVERY' END AS status FROM customer FULL JOIN a ON c_custkey = k""",
)
def a11_derived_catalog(t):
    """Seed keys and observed keys in one union and one aggregate; the label is that of the last order."""
    seed = t.customer.select(F.col("c_custkey").alias("k"))
    seen = t.orders.select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", "o_orderpriority")
    rows = seed.unionByName(seen, allowMissingColumns=True).groupBy("k").agg(
        F.count("o_orderkey").alias("observed"),
        F.max("o_orderdate").alias("last_checked"),
        F.max_by("o_orderpriority", F.when(F.col("o_orderkey").isNotNull(), F.struct("o_orderdate", "o_orderkey"))).alias("label"),
    )
    return rows.withColumn("status", F.when(F.col("observed") >= 15, "FULL").when(F.col("observed") <= 5, "NO_DATA").otherwise("DISCOVERY"))


@query(
    "a26_calendar_coverage",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM orders GROUP BY 1)
SELECT d.day::DATE AS day, coalesce(n, 0) AS n, coalesce(done, 0)::BIGINT AS done
FROM (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL 1 DAY)) AS day) d LEFT JOIN c ON c.day = d.day::DATE""",
)
def a26_calendar_coverage(t):
    return agg.calendar_coverage(t.orders, F.to_date("o_orderdate"), [F.count("*").alias("n"), agg.count_if(F.col("o_orderstatus") == "F").alias("done")])


@query(
    "a30_value_distribution",
    """SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""",
)
def a30_value_distribution(t):
    return agg.value_distribution(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "a30_breadth_guard",
    """SELECT (SELECT count(*) FROM orders) AS n, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT count(*) FROM orders GROUP BY o_orderpriority)) / (SELECT count(*) FROM orders)::DOUBLE AS dominant_share,
(SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)) / (SELECT count(*) FROM orders)::DOUBLE AS signature_share, 'PASS' AS status""",
)
def a30_breadth_guard(t):
    return agg.breadth_guard(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "o01_best_odds",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""",
)
def o01_best_odds(t):
    return ordering.best_per_group(t.orders, ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("o02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o02_top_k(t):
    return ordering.page(t.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("o03_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def o03_page(t):
    return ordering.page(t.orders, [F.col("o_orderdate"), F.col("o_orderkey")], 50, 100).select("o_orderkey", "o_orderdate")


@query(
    "o04_nulls_last",
    """SELECT c_custkey, last_order, row_number() OVER (ORDER BY last_order NULLS LAST, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def o04_nulls_last(t):
    """The whole order, with each row's place in it."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    rows = t.customer.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "last_order", F.col("last_order").isNull().alias("_unknown"))
    return scans.ranked(rows, ["_unknown", "last_order", "c_custkey"], "place").select("c_custkey", "last_order", "place")


@query(
    "o05_scanner_ranking",
    """SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal > 1000 DESC, CASE WHEN s_acctbal IS NULL OR s_acctbal = 0 THEN -1e9 ELSE s_acctbal END DESC, s_suppkey) AS place FROM supplier""",
)
def o05_scanner_ranking(t):
    rows = t.supplier.select("s_suppkey", "s_acctbal", (~(F.col("s_acctbal") > 1000)).alias("_last"), (-ordering.scanner_value("s_acctbal")).alias("_buffer"))
    return scans.ranked(rows, ["_last", "_buffer", "s_suppkey"], "place").select("s_suppkey", "s_acctbal", "place")


@query(
    "o06_quantile_sample",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT DISTINCT o_orderkey, o_totalprice FROM r, range(11) g(i) WHERE k = floor(i / 10.0::DOUBLE * (n - 1) + 0.5) + 1""",
)
def o06_quantile_sample(t):
    return ordering.quantile_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 11)


@query(
    "o07_priority_order",
    """SELECT event_id, event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, event_id) AS place FROM events""",
)
def o07_priority_order(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    rows = t.events.select("event_id", "event_type", rank.alias("_rank"))
    return scans.ranked(rows, ["_rank", "event_id"], "place").select("event_id", "event_type", "place")


@query(
    "o09_round_robin",
    """WITH once AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY o_custkey) AS round FROM once)
SELECT * FROM r ORDER BY round, day LIMIT 60""",
)
def o09_round_robin(t):
    return ordering.round_robin(t.orders.withColumn("day", F.to_date("o_orderdate")), "day", "o_custkey", 60)


@query("o10_top_ranked", "SELECT * FROM (SELECT n_nationkey, c_custkey, c_acctbal, rank() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE rank <= 2")
def o10_top_ranked(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return ordering.top_ranked(rows, ["n_nationkey"], F.col("c_acctbal").desc(), 2).select("n_nationkey", "c_custkey", "c_acctbal", "rank")


@query(
    "u01_union_fallback",
    """SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def u01_union_fallback(t):
    current = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    legacy = t.customer.select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return sets.union_with_fallback(current, legacy, ["k"])


@query("u02_distinct_domain", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND trim(source) <> ''")
def u02_distinct_domain(t):
    return sets.distinct_domain(t.documents, "source")


@query(
    "u03_key_membership",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'RIGHT_ONLY' WHEN b.k IS NULL THEN 'LEFT_ONLY' ELSE 'BOTH' END AS membership
FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000) b ON a.k = b.k""",
)
def u03_key_membership(t):
    a = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return sets.key_membership(a, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"])


@query(
    "u04_disappeared",
    "SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00')",
)
def u04_disappeared(t):
    active = t.events.where("ts < '2024-01-02'").select("user_id").distinct()
    return sets.disappeared(active, t.events.where("ts >= '2024-01-30'"), ["user_id"])


@query(
    "u07_raised_flags",
    """SELECT user_id FROM (SELECT user_id, max(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN value END) AS b, max(value) AS a FROM events GROUP BY 1) WHERE b IS NOT NULL AND a > b""",
)
def u07_raised_flags(t):
    top = lambda rows: rows.groupBy("user_id").agg(F.max("value").alias("flag"))
    return sets.raised_flags(top(t.events.where("ts < '2024-01-10'")), top(t.events), ["user_id"], "flag")


@query(
    "p10_range_bins",
    f"SELECT bin, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN {_BINS_SQL} ON o_totalprice >= low AND (high IS NULL OR o_totalprice < high) GROUP BY 1",
)
def p10_range_bins(t):
    bins = t.spark.createDataFrame(PRICE_BINS, "bin string, low double, high double")
    return joins.range_join(t.orders, bins, F.col("o_totalprice")).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("p16_case_insensitive", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def p16_case_insensitive(t):
    return t.orders.where(F.lower("o_orderpriority").isin("1-urgent", "2-high")).select("o_orderkey")


@query("p17_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#17') OR contains(lower(p_type), 'econ')")
def p17_search(t):
    hit = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return t.part.where(hit("p_name", "ring") | hit("p_brand", "#17") | hit("p_type", "econ")).select("p_partkey", "p_name")


@query(
    "f16_two_way",
    "SELECT event_id, round((1 / value) / (1 / value + 1 / 1.9::DOUBLE), 8) AS p FROM events WHERE value > 1 UNION ALL SELECT event_id, NULL FROM events WHERE value <= 1",
)
def f16_two_way(t):
    return t.events.select("event_id", F.round(two_way_probability("value", F.lit(1.9)), 8).alias("p"))


@query(
    "u06_duplicate_merge",
    "SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_quantity) AS quantity, arg_max(l_returnflag, (l_shipdate, l_suppkey, l_partkey, l_returnflag)) AS flag FROM lineitem GROUP BY 1, 2",
)
def u06_duplicate_merge(t):
    """Rows of one key as one: the largest quantity, the flag of the latest."""
    return sets.merge_duplicates(t.lineitem.withColumn("quantity", F.col("l_quantity")).withColumn("flag", F.col("l_returnflag")), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_partkey", "l_returnflag"], {"quantity": "max", "flag": "last"})


@query(
    "u08_export_check",
    "SELECT (SELECT count(*) FROM orders) AS n_left, (SELECT count(*) FROM orders WHERE o_custkey % 10 <> 0) AS n_right, (SELECT count(*) FROM orders WHERE o_custkey % 10 = 0) AS missing, 0::BIGINT AS extra, (SELECT count(*) FROM orders WHERE o_custkey % 10 = 1) AS different",
)
def u08_export_check(t):
    """An export that lost some orders and changed the price of others, against the table."""
    export = t.orders.where("o_custkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_custkey") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return sets.verify_export(t.orders, export, ["o_orderkey"], ["o_custkey", "o_totalprice"])


@query(
    "p15_filtered_count",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50)",
)
def p15_filtered_count(t):
    """The third page of 25 by price of the orders of one status (of any priority), and how many there are."""
    orders = {"price": [F.col("o_totalprice").desc(), F.col("o_orderkey")], "date": [F.col("o_orderdate"), F.col("o_orderkey")]}
    rows, count = ordering.filtered_page(t.orders, {"o_orderstatus": "F", "o_orderpriority": None}, orders, "price", 25, 50)
    return rows.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(count))  # one row


@query(
    "a31_stage_status",
    """WITH s AS (SELECT l_suppkey AS run, l_linenumber AS workers, count(*) AS requests, sum((l_discount < 0.1)::INT) AS successful, sum((l_quantity > 49.9 AND l_tax > 0.075)::INT) AS refused, sum((l_tax > 0.079)::INT) AS timeouts, max(l_quantity) * 65 AS p95 FROM lineitem GROUP BY ALL)
SELECT run, workers, CASE WHEN refused > 0 THEN 'UNSTABLE' WHEN (requests - successful) / requests > 0.1 OR p95 > 3000 OR timeouts / requests > 0.05 THEN 'DEGRADED' ELSE 'STABLE' END AS status, CASE WHEN refused > 0 OR successful / requests < 0.995 THEN 'UNSTABLE' WHEN timeouts / requests > 0.005 THEN 'DEGRADED' ELSE 'STABLE' END AS strict FROM s""",
)
def a31_stage_status(t):
    rows = _stages(t)
    return rows.select("run", "workers", agg.stage_status().alias("status"), agg.stage_status(strict=True).alias("strict"))


def _stages(t):
    """A supplier's lines of one number as a measured stage."""
    c = F.col
    n = lambda cond, name: agg.count_if(cond).alias(name)
    rows = t.lineitem.groupBy(c("l_suppkey").alias("run"), c("l_linenumber").alias("workers")).agg(
        F.count("*").alias("requests"), n(c("l_discount") < 0.1, "successful"), n((c("l_quantity") > 49.9) & (c("l_tax") > 0.075), "refused"), n(c("l_tax") > 0.079, "timeouts"), (F.max("l_quantity") * 65).alias("p95"), F.sum("l_quantity").alias("throughput")
    )
    zero = F.lit(0)
    return rows.withColumns({"unreadable": zero, "server_errors": zero, "connection_errors": zero})


@query(
    "a31_bottleneck",
    """WITH s AS (SELECT l_suppkey AS run, l_linenumber AS place, sum((l_quantity > 49.9 AND l_tax > 0.075)::INT) AS refused, sum((l_tax > 0.079)::INT) AS timeouts, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT *, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'PARSER' ELSE 'RATE_CONTROLLER' END WHEN n % 3 = 1 THEN 'NETWORK' END AS own FROM s)
SELECT run, CASE WHEN sum(refused) > 0 THEN 'PROVIDER' WHEN sum(timeouts) > 0 THEN 'NETWORK' WHEN max(q) >= 8500 THEN 'CPU' WHEN count(own) > 0 THEN arg_min(own, place) FILTER (own IS NOT NULL) WHEN count(*) >= 2 AND max(q) - min(q) <= 0.05 * max(q) THEN 'NETWORK' ELSE 'UNKNOWN' END AS bottleneck FROM x GROUP BY 1""",
)
def a31_bottleneck(t):
    c, n = F.col, F.col("requests") % 3
    rows = _stages(t).withColumns(
        {"place": c("workers"), "phase": F.lit("WORKER"), "target": F.lit(10.0), "starts": F.when(n == 0, 5.0).otherwise(10.0), "effective": F.when(n == 1, 5.0).otherwise(10.0), "slots": F.lit(5.0), "controller": F.lit(5.0)}
        | {"parse_median": F.when(c("requests") % 2 == 0, 60.0).otherwise(1.0), "parse_p95": F.lit(1.0), "cpu": c("throughput") / 100}
    )
    return agg.bottleneck(rows, ["run"])
