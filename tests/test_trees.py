"""Boosting and extremely randomised trees against plain numpy versions that know nothing of Spark."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchspark.operators import models, trees

FEATURES = ["a", "b", "c"]


def table(n=500, seed=3, classes=3):
    """Features with few, many and missing values; the class follows a rule with some noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(6), rng.gauss(0, 1), rng.random() if rng.random() < 0.8 else None
        y = (2 if a > 3 and b > 0 else 1 if b < -0.4 else 0) % classes
        rows.append((str(i), float(a), b, c, y if rng.random() < 0.9 else rng.randrange(classes), 1.0 + (i % 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id string, a double, b double, c double, label int, weight double").repartition(5)


def matrix(rows):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], dtype=float)
    medians = np.array([np.median(v[~np.isnan(v)]) for v in x.T])
    return np.where(np.isnan(x), medians, x), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])


def plain_boosting(x, y, w, classes, rounds, rate, leaves, l2, bins, least):
    """One node after another, best gain first, each from its own rows. Gives the scores of the rows."""
    unit = trees.UNIT
    edges = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        if len(v) <= bins:
            edges.append((v[:-1] + v[1:]) / 2)
        else:
            s = np.sort(x[:, f])
            at = [i / bins * (len(s) - 1) for i in range(1, bins)]
            edges.append(np.unique([s[int(np.floor(p))] if s[int(np.floor(p))] == s[int(np.ceil(p))] else (np.ceil(p) - p) * s[int(np.floor(p))] + (p - np.floor(p)) * s[int(np.ceil(p))] for p in at]))
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    share = np.array([w[y == k].sum() for k in range(classes)]) / w.sum()
    raw = np.tile(np.log(share[1] / share[0]) if classes == 2 else np.log(share), (len(x), 1)).astype(float)
    for _ in range(rounds):
        if classes == 2:
            p = 1 / (1 + np.exp(-raw))
            g, h = p - (y == 1)[:, None], p * (1 - p)
        else:
            e = np.exp(raw - raw.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(classes)), p * (1 - p)
        g, h = np.rint(g * w[:, None] * unit) / unit, np.rint(h * w[:, None] * unit) / unit
        step = np.zeros_like(raw)
        for k in range(raw.shape[1]):

            def best(rows):
                gt, ht, found = g[rows, k].sum(), h[rows, k].sum(), (0.0, -1, -1)
                for f in range(x.shape[1]):
                    for b in range(max(len(q) for q in edges)):
                        left = rows[binned[rows, f] <= b]
                        if len(left) < least or len(rows) - len(left) < least:
                            continue
                        gl, hl = g[left, k].sum(), h[left, k].sum()
                        if hl < trees.LEAST_HESSIAN or ht - hl < trees.LEAST_HESSIAN:
                            continue
                        gain = gl * gl / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt * gt / (ht + l2)
                        if gain > found[0] + 1e-12:
                            found = (gain, f, b)
                return found

            every = np.arange(len(x))
            nodes = [(every, best(every))]
            while len(nodes) < leaves:
                i = max(range(len(nodes)), key=lambda j: nodes[j][1][0])
                rows, (gain, f, b) = nodes[i]
                if f < 0:
                    break
                nodes.pop(i)
                for part in (rows[binned[rows, f] <= b], rows[binned[rows, f] > b]):
                    nodes.append((part, best(part)))
            for rows, _ in nodes:
                step[rows, k] = -rate * g[rows, k].sum() / (h[rows, k].sum() + l2)
        raw = raw + step
    return raw


@pytest.mark.parametrize("classes, bins", [(3, 255), (3, 16), (2, 255)])
def test_boosting_equals_plain_numpy(spark, monkeypatch, classes, bins):
    monkeypatch.setattr(trees, "RESTAGE", 2)
    rows = table(240, classes=classes)
    model = trees.fit_boosting(frame(spark, rows), FEATURES, "label", classes, "weight", max_iter=4, learning_rate=0.3, max_leaf_nodes=6, l2=0.7, bins=bins, min_samples_leaf=8)
    x, y, w = matrix(rows)
    expected = plain_boosting(x, y, w, classes, 4, 0.3, 6, 0.7, bins, 8)
    assert np.allclose(model.raw(x), expected, atol=1e-6)
    assert all(sum(f < 0 for f in t.feature) <= 6 for _, t in model.trees) and len(model.trees) == 4 * (1 if classes == 2 else 3)
    again = trees.Ensemble.from_json(model.to_json())
    shown = {r.row_id: r.class_probability for r in again.transform(frame(spark, rows)).collect()}
    assert all(np.allclose(shown[r[0]], p) for r, p in zip(rows, model.probabilities(x), strict=True))


def plain_extra_trees(x, y, w, classes, n_trees, depth, least, k, seed):
    weight = np.rint(w * trees.UNIT)
    out = np.zeros((len(x), classes))
    for t in range(n_trees):

        def grow(rows, path, level):
            total = np.array([weight[rows][y[rows] == c].sum() for c in range(classes)])
            best = (1e-12, None)
            if level < depth and len(rows) >= 2 * least and (total > 0).sum() > 1:
                features, thresholds = trees.candidates(seed, t, path, x[rows].min(axis=0), x[rows].max(axis=0), k)
                for f, threshold in zip(features, thresholds, strict=True):
                    left = rows[x[rows, f] <= threshold]
                    if min(len(left), len(rows) - len(left)) < least:
                        continue
                    part = np.array([weight[left][y[left] == c].sum() for c in range(classes)])
                    gini = lambda v: v.sum() * (1 - ((v / v.sum()) ** 2).sum()) / trees.UNIT
                    gain = gini(total) - gini(part) - gini(total - part)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, threshold))
            if best[1] is None:
                out[rows] += total / total.sum()
                return
            f, threshold = best[1]
            grow(rows[x[rows, f] <= threshold], path * 2, level + 1)
            grow(rows[x[rows, f] > threshold], path * 2 + 1, level + 1)

        grow(np.arange(len(x)), 1, 0)
    return out / n_trees


@pytest.mark.parametrize("k", ["sqrt", "all"])
def test_extra_trees_equal_a_plain_build(spark, k):
    rows = table(260, 5)
    model = trees.fit_extra_trees(frame(spark, rows), FEATURES, "label", 3, "weight", n_estimators=5, max_depth=6, min_samples_leaf=3, max_features=k, together=3, seed=7)
    x, y, w = matrix(rows)
    assert np.allclose(model.probabilities(x), plain_extra_trees(x, y, w, 3, 5, 6, 3, 1 if k == "sqrt" else 3, 7), atol=1e-9)
    assert len(model.trees) == 5 and len({str(t.__dict__) for _, t in model.trees}) == 5


def test_families_learn_a_rule_that_a_line_cannot(spark):
    rows = frame(spark, table(900, 11)).withColumnsRenamed({"label": "actual"}).withColumn("goals", F.col("actual"))
    rows = models.with_indicators(rows, FEATURES).withColumn("held", F.col("row_id").cast("int") % 3 == 0)
    loss = {}
    for family, params in (("LOGISTIC", {}), ("HISTGRADIENTBOOSTING", {"max_iter": 8, "learning_rate": 0.3, "max_leaf_nodes": 6}), ("EXTRATREES", {"n_estimators": 12, "max_depth": 8, "max_features": "all"})):
        model, _, share = models.fit(rows.where("NOT held"), FEATURES, family, "MULTICLASS", **params)
        found = models.predict(model, rows.where("held"), "MULTICLASS", share)
        loss[family] = models.report(found).first()
        assert found.where("abs(p0 + p1 + p2 - 1) > 1e-9").count() == 0
    assert loss["HISTGRADIENTBOOSTING"].log_loss < loss["LOGISTIC"].log_loss - 0.1 and loss["EXTRATREES"].accuracy > loss["LOGISTIC"].accuracy
    with pytest.raises(models.DependencyMissing):
        models.fit(rows, FEATURES, "EXTRATREES", "COUNT")
    with pytest.raises(ValueError):
        models.fit(rows, FEATURES, "EXTRATREES", "MULTICLASS", depth=3)


def test_odd_rows(spark):
    one = spark.createDataFrame([(1.0, None, None, 1, 1.0)] * 30, "a double, b double, c double, label int, weight double")
    model = trees.fit_boosting(one, FEATURES, "label", 3, max_iter=3)
    assert model.probabilities(np.zeros((2, 3)))[0, 1] > 0.99 and len(model.trees) == 3
    assert trees.fit_extra_trees(one, FEATURES, "label", 3, n_estimators=2).probabilities(np.zeros((1, 3)))[0].tolist() == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        trees.fit_boosting(one.limit(0), FEATURES, "label", 3)


def test_blend_means_the_two_best(spark):
    make = lambda rows: spark.createDataFrame(rows, "row_id string, actual int, p0 double, p1 double, p2 double")
    good = make([("a", 1, 0.1, 0.8, 0.1), ("b", 0, 0.8, 0.1, 0.1), ("c", 2, 0.1, 0.1, 0.8)])
    fair = make([("a", 1, 0.2, 0.6, 0.2), ("b", 0, 0.6, 0.2, 0.2)])
    bad = make([("a", 1, 0.9, 0.05, 0.05), ("b", 0, 0.0, 1.0, 0.0)])
    found, names = models.blend({"bad": bad, "fair": fair, "good": good})
    assert names == ["good", "fair"] and {r.row_id: round(r.p1, 9) for r in found.collect()} == {"a": 0.7, "b": 0.15}
    with pytest.raises(models.InsufficientData):
        models.blend({"good": good})


def test_rows_of_one_part_are_spread_over_the_cores(spark):
    rows = spark.range(4000).selectExpr("CAST(id % 7 AS DOUBLE) AS f", "CAST(id % 2 AS DOUBLE) AS label").coalesce(1)
    table, _, shares = trees._prepared(rows, ["f"], "label", 2, None)
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and shares == [2000.0, 2000.0]


def test_summed_is_exact_beyond_doubles():
    at, v = np.array([0, 1, 0, 1]), np.array([2**60, 1, 1, 2**55 + 1])
    assert trees._summed(at, v, 3).tolist() == [2**60 + 1, 2**55 + 2, 0]
    assert trees._summed(at, np.array([5, -7, 1, 2]), 3).tolist() == [6, -5, 0]


def test_equal_rows_are_one_cell_and_change_no_tree(spark):
    """Fits pass over different rows with their number: ten copies of a table are no more work than the table."""
    rows = table(200, 17)
    many = frame(spark, [(f"{r[0]}/{k}", *r[1:]) for r in rows for k in range(10)])
    cells, _, shares = trees._prepared(many, FEATURES, "label", 3, "weight")
    assert cells.count() <= 200 and cells.agg(F.sum("n")).first()[0] == 2000 and abs(sum(shares) - 10 * sum(r[5] for r in rows)) < 1e-6
    params = {"max_iter": 2, "learning_rate": 0.3, "max_leaf_nodes": 4, "bins": 16}
    x, y, w = matrix([r for r in rows for _ in range(10)])
    model = trees.fit_boosting(many, FEATURES, "label", 3, "weight", min_samples_leaf=20, l2=0.5, **params)
    assert np.allclose(model.raw(x), plain_boosting(x, y, w, 3, 2, 0.3, 4, 0.5, 16, 20), atol=1e-6)
