import random

import numpy as np
from pyspark.sql import functions as F

from pitchspark.operators import aggregates, markets, studies


def drawn(r, j, n, seed=6301):
    x = (seed + r * 73856093 + j * 19349663) % 2147483647
    for _ in range(3):
        x = (x * x + 12345) % 2147483647
    return x % n


def test_bootstrap_equals_a_fold(spark):
    rng = random.Random(1)
    rows = [("k", d, 10.0, round(rng.uniform(-10, 8), 2)) for d in range(9) for _ in range(4)] + [("one", 1, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, day int, stake double, pnl double")
    found = {r["key"]: r for r in aggregates.bootstrap_by_day(df, ["key"], "day", "stake", "pnl", rounds=80).collect()}
    days = [(sum(x[2] for x in rows if x[:2] == ("k", d)), sum(x[3] for x in rows if x[:2] == ("k", d))) for d in range(9)]
    rois = []
    for r in range(80):
        picked = [days[drawn(r, j, 9)] for j in range(9)]
        rois.append(sum(p for _, p in picked) / sum(s for s, _ in picked))
    rois.sort()
    at = lambda q: rois[int(79 * q)] + (rois[int(79 * q) + 1] - rois[int(79 * q)]) * (79 * q - int(79 * q))
    assert abs(found["k"]["roi_low"] - at(0.025)) < 1e-9 and abs(found["k"]["roi_high"] - at(0.975)) < 1e-9
    assert found["one"]["roi_low"] is None and found["one"]["days"] == 1


def test_draws_are_even():
    counts = [0] * 20
    for r in range(500):
        for j in range(20):
            counts[drawn(r, j, 20)] += 1
    assert max(counts) < 600 and min(counts) > 400
    spread = [len({drawn(r, j, 20) for j in range(20)}) for r in range(500)]  # with replacement: about 12.8 of 20
    assert 12.0 < sum(spread) / 500 < 13.6


def test_path_stats_equal_a_fold(spark):
    rng = random.Random(2)
    for chunks in (1, 7):
        rows = [(key, i % 97 // (97 // chunks + 1), i, round(rng.choice([-5, -3, 4, 9, 0]) + rng.random(), 2)) for key in ("a", "b") for i in range(97)]
        rows += [("c", 0, 0, -1.0), ("c", 0, 1, -2.0), ("c", 1, 2, -3.0), ("d", 0, 0, 5.0)]
        df = spark.createDataFrame(rows, "key string, day int, i int, pnl double")
        found = {r["key"]: r for r in studies.path_stats(df, ["key"], "day", ["i"], "pnl").collect()}
        for key in "abcd":
            balance = peak = fall = 0.0
            run = longest = 0
            for _, _, _, p in sorted(x for x in rows if x[0] == key):
                balance += p
                peak, fall = max(peak, balance), max(fall, max(peak, balance) - balance)
                run = run + 1 if p < 0 else 0
                longest = max(longest, run)
            r = found[key]
            assert abs(r["balance"] - balance) < 1e-6 and abs(r["peak"] - peak) < 1e-6 and abs(r["max_drawdown"] - fall) < 0.0051 and r["longest_loss_streak"] == longest


def test_empty_studies(spark):
    kind = "event_id int, observed_at timestamp, day date, competition_country string, competition_name string, q_zero double, q_two double, p1_market double, p1_break_even double, p1_buffer double, ht_goals double, entry_eligible boolean, result_valid boolean, outcome_class string, evidence_level string"
    empty = spark.createDataFrame([], kind)
    assert studies.variant_study(empty).count() == 0 and studies.pattern_buckets(empty).count() == 0


def test_covered_stakes_in_cents(spark):
    one = lambda a, b, p: spark.range(1).select(markets.covered_stakes(F.lit(a), F.lit(b), 30.0, F.lit(p)).alias("s")).first()["s"]
    s = one(4.2, 1.7, 0.1)
    assert s["stake_zero"] + s["stake_two"] == 30 and abs(s["payout_zero"] - s["payout_two"]) <= s["payout_difference"] and (s["status"], s["label"]) == ("OK", "INTERESTING")
    assert one(1.5, 1.5, 0.1)["status"] == "NO_POSITIVE_COVERED_PAYOUT" and one(1.0, 2.0, None)["status"] == "MISSING_QUOTES"
    assert one(4.2, 1.7, None)["label"] == "NEUTRAL" and one(4.2, 1.7, 0.9)["label"] == "UNATTRACTIVE"


def test_unknown_flags_never_verify(spark):
    df = spark.createDataFrame([(markets.REGULATION, False, False), (markets.REGULATION, None, False), (markets.REGULATION, False, True), ("OTHER", False, False)], "settlement_scope string, extra_time boolean, penalties boolean")
    assert [r[0] for r in df.select(markets.scope_verified()).collect()] == [True, False, False, False]


def test_registry(spark):
    kind = "run_id string, created_at int, status string, hashes array<string>"
    old = spark.createDataFrame([("a", 1, "COMPLETE", ["x"]), ("b", 2, "RUNNING", ["y"])], kind)
    new = studies.study_registry(old, spark.createDataFrame([("b", 3, "COMPLETE", ["x", "z"])], kind))
    assert sorted((r["run_id"], r["created_at"], r["total_configurations"]) for r in new.collect()) == [("a", 1, 2), ("b", 3, 2)]
    assert studies.latest_run(new).first()["run_id"] == "b" and studies.latest_run(old.where("status = 'RUNNING'")).count() == 0


def test_a_split_stands_in_the_plan_once(spark):
    """Bound values that were written out wherever they are used made plans of megabytes, and code that isn't compiled."""
    rows = spark.createDataFrame([(2.0, 3.0, 0.2, "H2_GOALS_0"), (1.5, None, None, "H2_GOALS_1")], "q_zero double, q_two double, p1_market double, outcome_class string")
    found = studies.simulate(rows, F.lit(studies.COMBINATION))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert [(r.payout, r.pnl) for r in found.orderBy("q_zero").collect()] == [(0.0, -10.0), (12.0, 2.0)]


def test_stakes_too_large_for_64_bits(spark):
    one = lambda stake: spark.range(1).select(markets.covered_stakes(F.lit(2.0), F.lit(3.0), stake, F.lit(0.1)).alias("s")).first()["s"]
    for stake in (30.0, 30_000_000.0):
        s = one(stake)
        assert (float(s.stake_zero), float(s.stake_two), float(s.payout_zero), float(s.payout_two), float(s.payout_difference)) == (stake * 0.6, stake * 0.4, stake * 1.2, stake * 1.2, 0.0)


def test_bootstrap_draws_are_those_of_the_function(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "DRAWS", 7)  # blocks of rounds and of draws
    stakes, profits = np.array([1.0, 2.0, 4.0] * 4), np.arange(12) - 5.0
    draws = spark.range(40).selectExpr("id AS r", "explode(sequence(0L, 11L)) AS j").select("r", aggregates.drawn(F.col("r"), F.col("j"), F.lit(12), 6301).alias("x")).collect()
    by_round = {}
    for d in draws:
        by_round.setdefault(d.r, []).append(d.x)
    roi = [profits[x].sum() / stakes[x].sum() for x in by_round.values()]
    assert np.allclose(aggregates._limits(stakes, profits, 40, 6301), np.quantile(roi, [0.025, 0.975]))
    assert aggregates._limits(stakes[:1], profits[:1], 40, 6301) == [None, None]


def test_equal_values_are_counted_once(spark):
    from pitchspark.operators import selection

    flat = spark.range(3000).select(F.struct((F.col("id") % 2).alias("k")).alias("g"), (F.col("id") % 5).cast("double").alias("value"))
    cells = selection.counted_cells(flat, "cells")
    assert cells.count() == 10 and cells.agg(F.sum("n")).first()[0] == 3000


def made_observations(spark, n=160):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        a, b, p = round(rng.choice([2.5, 3.0, 4.2, 6.0]), 4), round(rng.choice([1.5, 2.2, 3.4]), 4), round(rng.choice([0.1, 0.22, 0.31, 0.5]), 6)
        even = 1 - (1 / a + 1 / b)
        rows.append((i // 3, i % 3, 1000 + i // 3 % 40, f"2024-01-{i // 3 % 20 + 1:02}", rng.choice(["N", "S", None]), rng.choice("xy"), a, b, p, even, even - p, rng.choice([0.0, 1.0, 2.0, None]), even > 0, rng.random() < 0.8, rng.choice(studies.OUTCOMES), studies.LEVELS[0]))
    kind = "event_id int, rid int, observed_at int, day string, competition_country string, competition_name string, q_zero double, q_two double, p1_market double, p1_break_even double, p1_buffer double, ht_goals double, entry_eligible boolean, result_valid boolean, outcome_class string, evidence_level string"
    df = spark.createDataFrame(rows, kind).withColumn("day", F.to_date("day"))
    return df.repartition(7, "rid")


def played_alone(rows, spark, form):
    """The trades of rows in their order, by simulate."""
    found = studies.simulate(spark.createDataFrame(rows), F.lit(form)).collect()
    return sorted(found, key=lambda r: (r.day, r.observed_at, r.event_id, r.rid))


def test_studies_equal_a_fold_over_each_place(spark):
    """Rows of a place are moved once for all places and read in batches, whose chunks are joined."""
    df = made_observations(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {r.variant: r for r in studies.variant_study(df, rounds=30, order=("observed_at", "event_id", "rid")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [r for r in df.collect() if r.entry_eligible]
    played = {form: played_alone(rows, spark, form) for form in (studies.COMBINATION, studies.SINGLE_ZERO, studies.SINGLE_TWO)}
    seen = 0
    for name, form, field, low, high in studies.VARIANTS:
        own = [r for r in played[form] if field is None or r[field] is not None and (low is None or r[field] >= low) and (high is None or r[field] < high)]
        if not own:
            assert name not in found
            continue
        seen += 1
        done, r = [x for x in own if x.result_valid], found[name]
        balance = peak = fall = 0.0
        run = longest = 0
        for x in done:
            balance += x.pnl
            peak = max(peak, balance)
            fall, run = max(fall, peak - balance), run + 1 if x.pnl < 0 else 0
            longest = max(longest, run)
        assert (r.entries, r.resolved_trades, r.no_bet, r.longest_loss_streak) == (len(own), len(done), len(rows) - len(own), longest) and abs(r.max_drawdown - fall) < 0.0051
        assert (r.different_games, r.resolved_games, r.resolved_days) == (len({x.event_id for x in own}), len({x.event_id for x in done}), len({x.day for x in done}))
        assert (r.countries, r.competitions) == (len({x.competition_country for x in own} - {None}), len({(x.competition_country, x.competition_name) for x in own if x.competition_country}))
        assert abs(r.pnl - sum(x.pnl for x in done)) < 1e-6 and abs(r.total_payout - sum(x.payout for x in done)) < 1e-6
        for field in studies.MEDIANS:
            known = [x[field] for x in done if x[field] is not None]
            assert r[f"median_{field}"] is None if not known else abs(r[f"median_{field}"] - np.median(known)) < 1e-9
        days = {}
        for x in done:
            days.setdefault(x.day, []).append(x.pnl)
        if len(days) > 1:
            order = sorted(days)
            want = aggregates._limits(np.array([10.0 * len(days[d]) for d in order]), np.array([sum(days[d]) for d in order]), 30, 6301)
            assert np.allclose([r.roi_low, r.roi_high], want)
    assert seen == len(found) > 10


def test_references_and_segments_equal_plain_groups(spark):
    df = made_observations(spark)
    rows = [r for r in df.collect() if r.entry_eligible]
    inside = lambda r, v: v[2] is None or r[v[2]] is not None and (v[3] is None or r[v[2]] >= v[3]) and (v[4] is None or r[v[2]] < v[4])
    shown = {(r.variant, r.reference): r for r in studies.reference_study(df, columns=("entries", "pnl")).collect()}
    for form in (studies.COMBINATION, studies.SINGLE_ZERO, studies.SINGLE_TWO):
        played = played_alone(rows, spark, form)
        for v in studies.VARIANTS:
            own = [r for r in played if inside(r, v)]
            assert ((v[0], form) in shown) == bool(own)
            if own:
                assert shown[v[0], form].entries == len(own) and abs(shown[v[0], form].pnl - sum(r.pnl for r in own if r.result_valid)) < 1e-6
    groups = {}
    for r in rows:
        country, name = r.competition_country or "UNKNOWN", r.competition_name or "UNKNOWN"
        for v in studies.VARIANTS:
            if inside(r, v):
                for key in (("DATE", str(r.day)), ("COUNTRY", country), ("COMPETITION", f"{country} / {name}")):
                    groups.setdefault((v[0], *key), []).append(r.event_id)
    for columns in (("entries", "different_games"), None):
        found = {(r.variant, r.segment, r.segment_key): (r.entries, r.different_games) for r in studies.segment_study(df, rounds=5, columns=columns).collect()}
        assert found == {k: (len(x), len(set(x))) for k, x in groups.items()}


def jobs_of(spark, run):
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context._jsc.clearJobGroup()


def test_only_what_is_asked_for_is_found(spark):
    """Segments and references select no medians and fold no paths that nobody reads."""
    df = made_observations(spark)
    asked = jobs_of(spark, lambda: studies.segment_study(df, columns=("entries", "different_games", "pnl")).collect())
    every = jobs_of(spark, lambda: studies.segment_study(df, rounds=5).collect())
    assert 0 < asked < every / 2


def test_many_different_quotes_are_played_row_by_row(spark, monkeypatch):
    df = made_observations(spark)
    usual = sorted(map(str, studies.reference_study(df, columns=("entries", "pnl")).collect()))
    monkeypatch.setattr(studies, "shared_side", lambda table: (table, False))
    assert sorted(map(str, studies.reference_study(df, columns=("entries", "pnl")).collect())) == usual
