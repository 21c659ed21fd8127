"""Exact selection, slices and carry scans against plain windows and brute force, with bounds so small that every path runs."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchspark.operators import joins, scans, selection, windows


def test_ordered_bits_are_those_of_the_double(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, 2.0**52 - 0.5, 3.0, 1 - 2**-53, 2.0**1023]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [math.ldexp(1 + d * 2**-52, e) for e in range(-1022, 1024, 7) for d in (0, 1)] + [math.nextafter(2.0**e, 0) for e in range(-1021, 1024, 11)]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", selection.ordered_bits(F.col("x")).alias("b")).collect()
    for r in found:
        if math.isnan(r.x):
            assert r.b == 2047 * 2**52 + 1
        else:
            raw = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
            assert r.b == (-raw if r.x < 0 else raw), r.x


def values_table(spark):
    rng = random.Random(7)
    rows = [("hot" if k % 3 else f"g{k % 5}", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e-9, rng.randrange(5) * 1.0, 1e300 * rng.random(), -0.0]), float(k % 4)) for k in range(3000)]
    rows += [("empty", None, 1.0), ("one", 2.5, None), (None, 4.0, 1.0), (None, 6.0, 1.0), ("hot", None, None)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_exact_quantiles_equal_sorted_values(spark):
    df = values_table(spark)
    wanted = {"lo": (F.col("x"), 0.025), "mid": (F.col("x"), 0.5), "hi": (F.col("x"), 0.975), "y_mid": (F.col("y"), 0.5)}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r)
    for how in ("linear", "nearest", "truncated"):
        found = {r.g: r for r in selection.exact_quantiles(df, ["g"], wanted, how).collect()}
        assert set(found) == set(groups)
        for g, rows in groups.items():
            for name, field, q in (("lo", "x", 0.025), ("mid", "x", 0.5), ("hi", "x", 0.975), ("y_mid", "y", 0.5)):
                known = sorted(r[field] for r in rows if r[field] is not None)
                n = len(known)
                if not n:
                    assert found[g][name] is None
                    continue
                at = q * (n - 1)
                low, high = known[math.floor(at)], known[math.ceil(at)]
                linear = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
                expected = {"linear": linear, "nearest": known[max(0, math.ceil(q * n) - 1)], "truncated": known[max(0, int(q * n) - 1)]}[how]
                assert found[g][name] == expected, (how, g, name)
    assert selection.exact_quantiles(df, [], {"mid": (F.col("y"), 0.5)}).first().mid == 1.0
    assert selection.exact_quantiles(df.limit(0), ["g"], wanted).count() == 0
    with pytest.raises(ValueError):
        selection.exact_quantiles(df, ["g"], wanted, "other")


def test_exact_quantiles_equal_sparks_percentile_and_need_no_buffer(spark):
    df = values_table(spark)
    found = {r.g: r.q for r in selection.exact_quantiles(df, ["g"], {"q": (F.col("x"), 0.3)}).collect()}
    theirs = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.3)).alias("q")).collect()}
    assert found | {"empty": None} == theirs


def test_distinct_counts_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, None), ("b", None, None), (None, 3, "z"), (None, 3, "z")], "g string, n int, s string")
    found = {r.g: (r.n, r.both, r.some) for r in selection.distinct_counts(df, ["g"], {"n": [F.col("n")], "both": [F.col("n"), F.col("s")], "some": [F.when(F.col("n") > 1, F.col("s"))]}).collect()}
    assert found == {"a": (2, 2, 0), None: (1, 1, 1)}  # a key without known values has no row


# --- slices and carries ------------------------------------------------------------------------------------------


def timeline(spark, n=2000):
    """One key has most rows; values repeat, are null, and times tie."""
    rng = random.Random(3)
    rows = [("hot" if k % 4 else rng.choice(["a", "b", None]), rng.randrange(n // 2), k, rng.choice(["x", "y", None]), rng.random() < 0.5, rng.randrange(-5, 5)) for k in range(n)]
    return spark.createDataFrame(rows, "k string, t int, id int, v string, on boolean, pnl int").repartition(5)


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in a.collect()), key=key) == sorted((tuple(r) for r in b.collect()), key=key)


def test_slices_are_bounded_and_follow_the_order(spark):
    df = timeline(spark).unionByName(timeline(spark).limit(1).withColumn("k", F.lit("tie")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(900)))).drop("n"))
    rows = scans.slices(df, ["k", "t"], 100)
    sizes = [r.n for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 200 and len(sizes) >= len(df.columns) + df.count() // 200
    bounds = rows.groupBy("_part").agg(F.min(F.struct("k", "t", "_tie")).alias("a"), F.max(F.struct("k", "t", "_tie")).alias("b")).orderBy("_part")
    overlap = bounds.withColumn("p", F.lag("b").over(Window.orderBy("_part"))).where("p > a")
    assert overlap.count() == 0
    assert rows.where("k = 'tie'").select("_part").distinct().count() > 4  # equal rows are split


def test_ranked_numbers_every_row(spark):
    df = timeline(spark)
    for most in (70, 10**6):
        found = scans.ranked(df, ["t", "id"], "place", most).select("t", "id", "place").orderBy("place").collect()
        assert [r.place for r in found] == list(range(1, 2001)) and [(r.t, r.id) for r in found] == sorted((r.t, r.id) for r in found)
    assert scans.ranked(df.limit(0), ["t"], "place").count() == 0


@pytest.mark.parametrize("most", [60, 10**6])
def test_carries_equal_windows(spark, most):
    df = timeline(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    carry = scans.Carry(last={"l": F.col("v")}, ever={"e": F.col("pnl")}, fill={"f": F.col("v")}, total={"s": F.when(F.col("on"), F.col("pnl"))})
    found = carry.over(df, ["k"], ["t", "id"], most)
    expected = df.withColumns(
        {
            "l": F.lag("v").over(w), "e": F.max("pnl").over(w.rowsBetween(Window.unboundedPreceding, -1)), "f": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "s": F.sum(F.when(F.col("on"), F.col("pnl"))).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    assert same(found, expected.select(*found.columns))


def test_hot_keys_give_the_same_rows(spark):
    df, order = timeline(spark), ["t", "id"]
    for f in (
        lambda most: windows.change_only(df, ["k"], order, ["v"], most).select("id"),
        lambda most: windows.transitions(df, ["k"], order, "on", "v", most).select("id", "transition"),
        lambda most: windows.drawdown(df, ["k"], order, "pnl", 10, most),
        lambda most: windows.longest_streaks(df, ["k"], order, {"lost": F.col("pnl") < 0, "on": F.col("on")}, most),
        lambda most: joins.as_of_join(df.select("k", "t", "id"), df.where("on").selectExpr("k", "t + 1 AS u", "v AS x", "id AS y").groupBy("k", "u").agg(F.max("x").alias("x"), F.max("y").alias("y")), ["k"], "t", "u", ["x", "y"], most),
    ):
        assert same(f(80), f(10**9))


def test_a_key_with_a_million_rows_is_spread(spark):
    df = spark.range(1_000_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.floor(F.col("id") / 10).alias("v"))
    found = scans.Carry(last={"b": F.col("v")}).sliced(df, ["k"], ["t"], 100_000)
    sizes = [r[0] for r in found.groupBy("_part").agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) >= 4 and max(sizes) < 400_000
    assert windows.change_only(df, ["k"], ["t"], ["v"], 100_000).count() == 100_000


def test_prior_mean_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"2024-01-{1 + rng.randrange(20):02d}", i, rng.choice([None, float(rng.randrange(9))])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, d string, i int, x double")
    for r in windows.prior_mean(df, ["k"], "d", "x", 5, ["i"], "m").collect():
        before = [x for _, d, i, x in sorted((q for q in rows if q[0] == r.k and q[1] < r.d), key=lambda q: (q[1], q[2]))][-5:]
        known = [x for x in before if x is not None]
        assert (r.m is None) == (not known) and (not known or np.isclose(r.m, sum(known) / len(known)))


def test_few_values_are_ranked_at_once_and_many_by_digits(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 2 AS g", "CASE WHEN id % 7 <> 0 THEN sin(id) * 1000 END AS x")
    wanted = {"low": (F.col("x"), 0.2), "mid": (F.col("x"), 0.5)}
    find = lambda: sorted(map(tuple, selection.exact_quantiles(df, ["g"], wanted).collect()))
    at_once = find()
    monkeypatch.setattr(selection, "FEW", 10)
    assert find() == at_once and len(at_once) == 2 and None not in at_once[0]
