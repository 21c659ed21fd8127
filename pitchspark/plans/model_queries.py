"""Model queries. Orders stand for matches of a customer's team, order lines for their shots."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.operators import models
from pitchspark.plans.registry import query
from pitchspark.staging import spread, staged

c = F.col


def proxy_rows(t):
    """Orders with the number of their lines (0, 1, 2 and more beyond two) as goals, and a few features, some missing."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    rows = t.orders.join(lines, c("o_orderkey") == c("l_orderkey"), "left").withColumn("goals", F.greatest(F.coalesce("n", F.lit(0)) - 2, F.lit(0)))
    return rows.select(
        c("o_orderkey").alias("row_id"), F.least("goals", F.lit(2)).cast("int").alias("actual"), "goals", "o_orderdate", (F.coalesce("q", F.lit(0.0)) + c("o_custkey") % 40).alias("f_quantity"), F.when(c("o_custkey") % 5 != 0, c("o_totalprice")).alias("f_price"), c("d").alias("f_discount")
    )


_FEATURES, _ORDER = ["f_quantity", "f_price", "f_discount"], ["o_orderdate", "row_id"]


def _planted(t):
    """Order lines with a class that follows their quantity, discount and tax by a rule, but for one in eight by a checksum;
    one in four, by another, is held out."""
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    code = F.crc32(key.cast("binary"))
    rule = F.when((c("l_quantity") > 30) & (c("l_discount") > 0.03), 2).when((c("l_quantity") <= 12) | (c("l_tax") > 0.06), 1).otherwise(0)
    missing = F.when(code % 11 != 0, c("l_discount"))
    return t.lineitem.select(
        key.alias("row_id"), F.when(code % 8 == 0, (code / 8).cast("long") % 3).otherwise(rule).cast("int").alias("actual"), (F.floor(code / 64) % 4 == 0).alias("held_out"),
        c("l_quantity").alias("f_quantity"), missing.alias("f_discount"), c("l_tax").alias("f_tax"), (code % 97).cast("double").alias("f_noise"),
    ).withColumn("goals", c("actual"))


_PLANTED = ["f_quantity", "f_discount", "f_tax", "f_noise"]
_FAMILIES = (
    ("LOGISTIC", "MULTICLASS", {}), ("RANDOMFOREST", "MULTICLASS", {"n_estimators": 20, "max_depth": 6}), ("HISTGRADIENTBOOSTING", "MULTICLASS", {"max_iter": 12, "learning_rate": 0.3, "max_leaf_nodes": 8}),
    ("EXTRATREES", "MULTICLASS", {"n_estimators": 24, "max_depth": 8, "max_features": "all"}), ("HISTGRADIENTBOOSTING", "BINARY_P1", {"max_iter": 12, "learning_rate": 0.3, "max_leaf_nodes": 8}),
)


def _planted_parts(t):
    """The planted rows to learn from and those held out, staged: they are read once for each pass of each fit."""
    rows = staged(spread(models.with_indicators(_planted(t), _PLANTED)), "planted-rows")
    return rows.where("NOT held_out"), rows.where("held_out")


@query("l02_model_families")
def l02_model_families(t):
    """Metrics of each family on held-out rows of a planted rule that a line can't follow."""
    train, held_out = _planted_parts(t)

    def run(family, target, params):
        model, _, share = models.fit(train, _PLANTED, family, target, **params)
        return models.report(models.predict(model, held_out, target, share)).withColumns({"family": F.lit(family), "target": F.lit(target)})

    return reduce(DataFrame.unionByName, models.side_by_side([partial(run, *x) for x in _FAMILIES]))


@query("l02_blend")
def l02_blend(t):
    """The two best of three experiments on held-out rows, blended, beside its parts."""
    train, held_out = _planted_parts(t)

    def run(family, target, params):
        model, _, share = models.fit(train, _PLANTED, family, target, **params)
        return staged(models.predict(model, held_out, target, share), "blend-part")

    chosen = _FAMILIES[:4:2] + _FAMILIES[3:4]
    found = dict(zip([x[0] for x in chosen], models.side_by_side([partial(run, *x) for x in chosen]), strict=True))
    blended, names = models.blend(found)
    out = models.report(blended).withColumn("parts", F.lit("+".join(sorted(names))))
    for name, predictions in found.items():
        out = out.unionByName(models.report(predictions).withColumn("parts", F.lit(name)))
    return out


@query("l03_calibration")
def l03_calibration(t):
    """A walk-forward run with and without isotonic calibration, as metrics of either."""
    found = models.experiment(proxy_rows(t), _FEATURES, _ORDER, "LOGISTIC", calibration="ISOTONIC")
    raw = found.select("row_id", "actual", *[c(f"raw{k}").alias(f"p{k}") for k in range(3)])
    return models.report(found).withColumn("kind", F.lit("calibrated")).unionByName(models.report(raw).withColumn("kind", F.lit("raw")))


@query("l05_walk_forward")
def l05_walk_forward(t):
    return models.report(models.experiment(proxy_rows(t), _FEATURES, _ORDER, "LOGISTIC"), ["fold"])


@query(
    "l04_prediction_heads",
    """WITH x AS (SELECT event_id, value / 200 AS r FROM events), h AS (SELECT event_id, greatest(exp(-r), 1e-8) AS a, greatest(r * exp(-r), 1e-8) AS b, greatest(least(greatest(1 - exp(-r) - r * exp(-r), 0), 1), 1e-8) AS z FROM x)
SELECT event_id, round(a / (a + b + z), 8) AS p0, round(b / (a + b + z), 8) AS p1, round(z / (a + b + z), 8) AS p2 FROM h""",
)
def l04_prediction_heads(t):
    found = t.events.select("event_id", *models.heads("COUNT", c("value") / 200, F.array()))
    return found.select("event_id", *[F.round(f"p{k}", 8).alias(f"p{k}") for k in range(3)])


_PRED = """pr AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS actual, l_linenumber % 3 + 1 AS fold, l_discount + 0.1 AS p0, l_tax * 4 + 0.02 AS p1, 1 - (l_discount + 0.1) - (l_tax * 4 + 0.02) AS p2, l_suppkey % 3 AS u FROM lineitem)"""


def proxy_predictions(t):
    actual = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = t.lineitem.select(key.alias("row_id"), actual.alias("actual"), (c("l_linenumber") % 3 + 1).alias("fold"), (c("l_discount") + 0.1).alias("p0"), (c("l_tax") * 4 + 0.02).alias("p1"), (c("l_suppkey") % 3).alias("u"))
    return rows.withColumn("p2", 1 - c("p0") - c("p1"))


@query(
    "l07_threshold_report",
    f"""WITH {_PRED}, v AS (SELECT unnest([{', '.join(map(str, models.THRESHOLDS))}])::DOUBLE AS max_p1), f AS (SELECT max_p1, fold, count(*) AS n, sum((actual <> 1)::INT) AS k, sum(p1) AS p FROM pr, v WHERE p1 < max_p1 GROUP BY ALL)
SELECT max_p1, sum(n)::BIGINT AS n, round(sum(p) / sum(n), 8) AS mean_p1, round(1 - sum(k) / sum(n), 8) AS actual_p1, round(stddev_pop(k / n), 8) AS fold_stability FROM f GROUP BY 1""",
)
def l07_threshold_report(t):
    found = models.threshold_report(proxy_predictions(t))
    return found.select("max_p1", "n", *[F.round(x, 8).alias(x) for x in ("mean_p1", "actual_p1", "fold_stability")])


@query(
    "l07_universe_overlap",
    f"""WITH {_PRED} SELECT CASE u WHEN 0 THEN 'BOTH' WHEN 1 THEN 'LEFT_ONLY' ELSE 'RIGHT_ONLY' END AS part, count(*) AS n, round(avg(-ln(greatest(CASE actual WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15))), 6) AS log_loss, round(avg((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = actual)::INT), 6) AS accuracy FROM pr GROUP BY 1""",
)
def l07_universe_overlap(t):
    rows = proxy_predictions(t)
    found = models.universe_overlap(rows.select("row_id", "u").distinct(), rows, c("u") < 2, c("u") != 1)
    return found.select("part", "n", F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"))


@query("l07_extreme_warning", f"WITH {_PRED} SELECT count(*) AS n, round(avg((actual = 1)::INT), 8) AS actual_p1, coalesce(avg((actual = 1)::INT) > 0.2, false) AS warning FROM pr WHERE p1 < 0.05")
def l07_extreme_warning(t):
    return models.extreme_warning(proxy_predictions(t)).withColumn("actual_p1", F.round("actual_p1", 8))


@query(
    "d14_feature_dataset",
    """WITH s AS (SELECT l_orderkey AS match_id, CASE l_returnflag WHEN 'A' THEN 'home' ELSE 'away' END AS side, l_quantity::INT AS minute, l_tax AS xg FROM lineitem), w AS (SELECT match_id, sum(CASE WHEN minute <= 45 AND side = 'home' THEN 1 END) AS h, sum(CASE WHEN minute <= 45 AND side = 'away' THEN 1 END) AS a, count(CASE WHEN minute <= 45 AND xg > 0.04 THEN 1 END) AS goals FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS b, round(o_totalprice * 100)::BIGINT AS cents FROM orders), p AS (SELECT x.o_orderkey, avg(y.cents) AS m FROM r x LEFT JOIN r y ON y.o_custkey = x.o_custkey AND y.k <= x.b AND y.k > x.b - 5 GROUP BY 1)
SELECT r.o_orderkey AS match_id, h + a AS shots, round(h / (h + a), 8) AS share, CASE WHEN w.match_id IS NULL THEN NULL ELSE w.goals END AS goals_h1, round(m, 4) AS prior_5, CASE WHEN o_orderstatus = 'P' THEN 'INVALID_EXTRA_TIME_AMBIGUOUS' ELSE 'VALID_REGULATION' END AS quality FROM r LEFT JOIN w ON w.match_id = r.o_orderkey LEFT JOIN p ON p.o_orderkey = r.o_orderkey""",
)
def d14_feature_dataset(t):
    core = t.orders.select(
        c("o_orderkey").alias("match_id"), "o_custkey", "o_orderdate", F.round(c("o_totalprice") * 100).cast("long").alias("cents"), (c("o_orderkey") % 2).alias("ht_home"), F.lit(0).alias("ht_away"), (c("o_orderkey") % 2 + 1).alias("ft_home"), (c("o_custkey") % 3).alias("ft_away"),
        (c("o_orderstatus") == "P").alias("ambiguous"),
    )
    shots = t.lineitem.select(c("l_orderkey").alias("match_id"), F.when(c("l_returnflag") == "A", "home").otherwise("away").alias("side"), c("l_quantity").cast("int").alias("minute"), c("l_tax").alias("xg"))
    timeline = shots.select("match_id", "minute", F.when(c("xg") > 0.04, "goal").otherwise("card").alias("kind"))
    found = models.feature_dataset(core, shots, timeline, "o_custkey", "o_orderdate", "cents", ["match_id"])
    return found.select("match_id", c("h1_shots_total").alias("shots"), F.round("h1_shots_share", 8).alias("share"), c("h1_goals").alias("goals_h1"), F.round("prior_5", 4).alias("prior_5"), "quality")
