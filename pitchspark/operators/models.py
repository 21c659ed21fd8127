"""Outcome models on pyspark.ml: features, model families, calibration, prediction heads, walk-forward experiments, reports.

Classes are 0, 1 and 2 (no goal, one, two and more). Boosting for several classes and extremely randomised trees are built
in :mod:`pitchspark.operators.trees`. Families without a distributed implementation here are an error; no other model is
ever put in their place.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.functions.numbers import wilson
from pitchspark.operators import trees
from pitchspark.operators.aggregates import classification_metrics, count_if
from pitchspark.operators.scans import ranked
from pitchspark.staging import staged

CLASSES = 3
LEAST_CALIBRATION = 30
#: Thresholds on the probability of one goal.
THRESHOLDS = (0.30, 0.275, 0.25, 0.225, 0.20, 0.175, 0.15, 0.125, 0.10)


class DependencyMissing(RuntimeError):
    pass


class InsufficientData(RuntimeError):
    pass


def pipeline(family: str, target: str, features: list[str], weight: str | None = None, seed: int = 42, **params) -> Pipeline:
    """Medians for missing values, an indicator of each, scaling for linear models, and the model. ``target``: MULTICLASS,
    BINARY_P1 or COUNT; the label column is ``label``."""
    family, target = family.upper(), target.upper()
    w = {"weightCol": weight} if weight else {}
    if family == "POISSON" and target == "COUNT":
        model = GeneralizedLinearRegression(family="poisson", link="log", regParam=params.get("alpha", 0.5), maxIter=params.get("max_iter", 100), featuresCol="features", **w)
    elif family == "LOGISTIC" and target != "COUNT":
        kind = "multinomial" if target == "MULTICLASS" else "binomial"
        model = LogisticRegression(family=kind, regParam=params.get("reg", 0.01), maxIter=params.get("max_iter", 100), featuresCol="features", **w)
    elif family == "RANDOMFOREST" and target != "COUNT":
        model = RandomForestClassifier(numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 8), minInstancesPerNode=params.get("min_samples_leaf", 2), seed=seed, featuresCol="features", **w)
    elif family == "GRADIENTBOOSTING" and target == "BINARY_P1":
        model = GBTClassifier(maxIter=params.get("max_iter", 50), maxDepth=params.get("max_depth", 4), stepSize=params.get("learning_rate", 0.1), seed=seed, featuresCol="features", **w)
    else:
        raise DependencyMissing(f"there is no {family} for {target} here")
    filled, missing = [f"{f}__filled" for f in features], [f"{f}__missing" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=[*filled, *missing], outputCol="raw_features" if family == "LOGISTIC" else "features", handleInvalid="keep"),
    ]
    if family == "LOGISTIC":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, model])


#: Families built here, with the parameters that each takes.
TREE_FAMILIES = {
    "HISTGRADIENTBOOSTING": ("max_iter", "learning_rate", "max_leaf_nodes", "l2", "bins", "min_samples_leaf"),
    "EXTRATREES": ("n_estimators", "max_depth", "min_samples_leaf", "max_features", "seed"),
}


def fit_trees(rows: DataFrame, features: list[str], family: str, target: str, weight: str | None = None, **params) -> trees.Ensemble:
    """An ensemble on the features and the indicators of missing ones; ``label`` is the class (BINARY_P1: 1 or not)."""
    unknown = set(params) - set(TREE_FAMILIES[family])
    if unknown:
        raise ValueError(f"{family} takes no {', '.join(sorted(unknown))}")
    classes = CLASSES if target == "MULTICLASS" else 2
    fitted = trees.fit_boosting if family == "HISTGRADIENTBOOSTING" else trees.fit_extra_trees
    return fitted(rows, [*features, *[f"{f}__missing" for f in features]], "label", classes, weight, **params)


def with_indicators(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, and for each whether it is missing; a feature that is always missing becomes 0."""
    empty = rows.agg(*[F.max(F.col(f).isNotNull()).alias(f) for f in features]).first()  # one row
    value = lambda f: F.col(f).cast("double") if empty[f] else F.lit(0.0)
    return rows.withColumns({f"{f}__missing": F.col(f).isNull().cast("double") for f in features} | {f: value(f) for f in features})


def heads(target: str, prediction: Column, probability: Column, zero_share: float = 0.5) -> list[Column]:
    """p0, p1, p2 of a prediction: of a count by Poisson, of one class against the rest by sharing the rest, else as they are."""
    if target == "COUNT":
        rate = F.greatest(F.lit(0.0), prediction)
        p0 = F.exp(-rate)
        found = [p0, rate * p0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p0 - rate * p0))]
    elif target == "BINARY_P1":
        p1 = probability[1]
        found = [(1 - p1) * zero_share, p1, (1 - p1) * (1 - zero_share)]
    else:
        found = [F.coalesce(F.get(probability, F.lit(k)), F.lit(0.0)) for k in range(CLASSES)]
    clipped = [F.greatest(F.lit(1e-8), p) for p in found]
    return [(p / sum(clipped[1:], clipped[0])).alias(f"p{k}") for k, p in enumerate(clipped)]


def _logit(p: Column) -> Column:
    x = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(x / (1 - x))


def calibrators(predicted: DataFrame, method: str) -> list | None:
    """One model per class on its own probability (``p0``..``p2``, ``actual``); none for few rows or a class that is missing."""
    if method == "NONE":
        return None
    seen = predicted.agg(F.count("*").alias("n"), *[count_if(F.col("actual") == k).alias(f"n{k}") for k in range(CLASSES)]).first()
    if seen["n"] < LEAST_CALIBRATION or any(seen[f"n{k}"] in (0, seen["n"]) for k in range(CLASSES)):
        return None
    out = []
    for k in range(CLASSES):
        x = _logit(F.col(f"p{k}")) if method == "SIGMOID" else F.col(f"p{k}")
        rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(predicted.select(x.alias("x"), (F.col("actual") == k).cast("double").alias("label")))
        out.append((LogisticRegression(regParam=0.01) if method == "SIGMOID" else IsotonicRegression()).fit(rows))
    return out


def calibrated(predicted: DataFrame, models: list | None, method: str) -> DataFrame:
    """``predicted`` with recalibrated p0, p1, p2 that sum to one."""
    if models is None:
        return predicted
    out = predicted
    for k, model in enumerate(models):
        x = _logit(F.col(f"p{k}")) if method == "SIGMOID" else F.col(f"p{k}")
        out = VectorAssembler(inputCols=["_x"], outputCol="features").transform(out.withColumn("_x", x))
        out = model.transform(out)
        value = vector_to_array("probability")[1] if method == "SIGMOID" else F.col("prediction")
        out = out.withColumn(f"_c{k}", F.greatest(F.lit(1e-8), value)).drop("_x", "features", "rawPrediction", "probability", "prediction")
    total = sum((F.col(f"_c{k}") for k in range(1, CLASSES)), F.col("_c0"))
    return out.withColumns({f"p{k}": F.col(f"_c{k}") / total for k in range(CLASSES)}).drop(*[f"_c{k}" for k in range(CLASSES)])


def _label(target: str) -> Column:
    return {"MULTICLASS": F.col("actual"), "BINARY_P1": (F.col("actual") == 1), "COUNT": F.col("goals")}[target].cast("double")


def predict(model: PipelineModel | trees.Ensemble, rows: DataFrame, target: str, zero_share: float = 0.5, keep: tuple[str, ...] = ("row_id", "actual")) -> DataFrame:
    out = model.transform(rows)
    if isinstance(model, trees.Ensemble):
        return out.select(*keep, *heads(target, F.lit(None), F.col("class_probability"), zero_share))
    probability = vector_to_array("probability") if "probability" in out.columns else F.array()
    return out.select(*keep, *heads(target, F.col("prediction"), probability, zero_share))


def fit(train: DataFrame, features: list[str], family: str, target: str, calibration: str = "NONE", weight: str | None = None, **params) -> tuple[PipelineModel | trees.Ensemble, list | None, float]:
    """The model, its calibrators (on the training rows alone) and the share of 0 among 0 and 2."""
    seen = train.agg(F.count_distinct("actual").alias("k"), count_if(F.col("actual") == 0).alias("zero"), count_if(F.col("actual") == 2).alias("two")).first()
    if target != "COUNT" and seen["k"] < 2:
        raise InsufficientData("the training rows have one class only")
    share = seen["zero"] / (seen["zero"] + seen["two"]) if seen["zero"] + seen["two"] else 0.5
    labelled = train.withColumn("label", _label(target))
    if family.upper() in TREE_FAMILIES and target != "COUNT":
        model = fit_trees(labelled, features, family.upper(), target, weight, **params)
    else:
        model = pipeline(family, target, features, weight, **params).fit(labelled)
    if target == "COUNT" or calibration == "NONE":
        return model, None, share
    return model, calibrators(predict(model, train, target, share), calibration), share


def side_by_side(runs: list[Callable[[], object]]) -> list:
    """Results of independent fits, each in a driver thread of its own: most passes of a fit are short, so their jobs share the
    cores instead of waiting for each other."""
    with ThreadPoolExecutor(max_workers=max(1, len(runs))) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(run)) for run in runs]]


def split(rows: DataFrame, order: list[str], locked: float = 0.2) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows with their place in time (from 1) and whether they are locked (the newest), and the folds as (last row of
    training, last row of validation): three of equal size that follow each other, if there are rows enough."""
    table = staged(ranked(rows, order, "place"), "model-rows")
    n = table.count()
    if n < 4:
        raise InsufficientData("fewer than four rows in time")
    dev = n - (max(1, round(n * locked)) if n >= 10 else 0)
    folds = min(3, max(1, (dev - 2) // 2))
    size = max(1, dev // (folds + 2))
    first = max(2, dev - folds * size)
    cuts = [(first + k * size, min(dev, first + (k + 1) * size)) for k in range(folds)]
    return table.withColumn("locked", F.col("place") > dev), [x for x in cuts if x[0] < x[1]]


def experiment(rows: DataFrame, features: list[str], order: list[str], family: str, target: str = "MULTICLASS", calibration: str = "NONE", weight: str | None = None, **params) -> DataFrame:
    """Out-of-fold predictions of a walk-forward run: row_id, actual, fold, raw and calibrated probabilities.

    ``rows``: row_id, actual (0, 1, 2), goals, the features and the columns of ``order``. A fold is trained on all rows before
    it; the locked rows are never used."""
    table, folds = split(with_indicators(rows, features), order)
    out = None
    for k, (last, end) in enumerate(folds, 1):
        model, models, share = fit(table.where(F.col("place") <= last), features, family, target, calibration, weight, **params)
        raw = predict(model, table.where((F.col("place") > last) & (F.col("place") <= end)), target, share)
        both = calibrated(raw.withColumns({f"raw{j}": F.col(f"p{j}") for j in range(CLASSES)}), models, calibration).withColumn("fold", F.lit(k))
        out = both if out is None else out.unionByName(both)
    return staged(out, "model-oof")


def blend(experiments: dict[str, DataFrame], most: int = 2) -> tuple[DataFrame, list[str]]:
    """Means of the out-of-fold probabilities of the ``most`` experiments with the best Brier score of class 1 (ties by name),
    for rows that all of them have; and the experiments' names. Fewer than two experiments are an error."""
    if len(experiments) < 2:
        raise InsufficientData("a blend needs two experiments")
    scored = None
    for name, predictions in experiments.items():
        rows = report(predictions).select(F.lit(name).alias("name"), "p1_brier")
        scored = rows if scored is None else scored.unionByName(rows)
    chosen = [r["name"] for r in scored.orderBy(F.col("p1_brier").asc_nulls_last(), "name").limit(most).collect()]
    parts = [f"p{k}" for k in range(CLASSES)]
    every = None
    for name in chosen:
        rows = experiments[name].select("row_id", "actual", *parts)
        every = rows if every is None else every.unionByName(rows)
    means = every.groupBy("row_id").agg(F.count("*").alias("_n"), F.min("actual").alias("actual"), *[F.avg(p).alias(p) for p in parts])
    return means.where(F.col("_n") == len(chosen)).drop("_n").withColumn("fold", F.lit("ensemble")), chosen


def report(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metrics of predictions, of all or by key: log loss, Brier scores, bias of p1, accuracy, rate of 0 and 2+."""
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(-k).alias("k")) for k in range(CLASSES)]))["k"]
    rows = predictions.withColumn("_hit", (-best == F.col("actual")).cast("int"))
    more = rows.groupBy(*(keys or [])).agg(F.avg("_hit").alias("accuracy"), F.avg((F.col("actual") != 1).cast("int")).alias("zero_or_two_rate"))
    found = classification_metrics(rows, "actual", [f"p{k}" for k in range(CLASSES)], keys)
    return found.join(more, keys) if keys else found.crossJoin(more)  # one row each


def threshold_report(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each threshold on p1 (and key): rows below it, their rate of one goal and of zero or two with its interval, and the
    standard deviation of the rate over folds. One pass over exploded thresholds."""
    keys = keys or []
    below = predictions.withColumn("max_p1", F.explode(F.array(*[F.lit(x) for x in THRESHOLDS]))).where("p1 < max_p1")
    by_fold = below.groupBy(*keys, "max_p1", "fold").agg(F.count("*").alias("_n"), count_if("actual <> 1").alias("_k"), F.sum("p1").alias("_p"))
    found = by_fold.groupBy(*keys, "max_p1").agg(F.sum("_n").alias("n"), F.sum("_k").alias("hits"), F.sum("_p").alias("_p"), F.stddev_pop(F.col("_k") / F.col("_n")).alias("fold_stability"))
    low, high = wilson("hits", "n")
    return found.select(*keys, "max_p1", "n", (F.col("_p") / F.col("n")).alias("mean_p1"), (1 - F.col("hits") / F.col("n")).alias("actual_p1"), (F.col("hits") / F.col("n")).alias("hit_rate"), low.alias("low"), high.alias("high"), "fold_stability")


def universe_overlap(rows: DataFrame, predictions: DataFrame, left: Column, right: Column) -> DataFrame:
    """Metrics of rows in both of two feature universes, and in one only."""
    place = F.when(left & right, "BOTH").when(left, "LEFT_ONLY").when(right, "RIGHT_ONLY")
    return report(predictions.join(rows.select("row_id", place.alias("part")).where("part IS NOT NULL"), "row_id"), ["part"])


def extreme_warning(predictions: DataFrame, below: float = 0.05, most: float = 0.2) -> DataFrame:
    """One row: predictions of almost no chance of one goal, how often there was one, and whether that is a warning."""
    found = predictions.where(F.col("p1") < below).agg(F.count("*").alias("n"), F.avg((F.col("actual") == 1).cast("int")).alias("actual_p1"))
    return found.withColumn("warning", F.coalesce(F.col("actual_p1") > most, F.lit(False)))


def save_predictions(predictions: DataFrame, path: str, experiment_id: str) -> None:
    """Predictions under their experiment; a run again replaces its own and nothing else."""
    (
        predictions.withColumn("experiment_id", F.lit(experiment_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(path)
    )


def feature_dataset(core: DataFrame, shots: DataFrame, timeline: DataFrame, team: str, kickoff: str, metric: str, tie: list[str], prior: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row per match: its facts, first-half shots of both sides with pair features, goals of its timeline, means of the
    team's matches strictly before it, and the target with its quality. Shots and timeline are aggregated before they join.

    ``core``: match_id, ``team``, ``kickoff``, ``metric``, ht_home, ht_away, ft_home, ft_away, ambiguous. ``shots``: match_id,
    side (home, away), minute, xg. ``timeline``: match_id, minute, kind."""
    from pitchspark.functions.numbers import pair_features
    from pitchspark.operators.reshape import feature_coverage, windowed_wide
    from pitchspark.operators.results import h2_target
    from pitchspark.operators.windows import expanding_mean, prior_mean

    c, half = F.col, F.col("minute") <= 45
    sides = {s: c("side") == s for s in ("home", "away")}
    wide = windowed_wide(shots, ["match_id"], {"h1": half, "late": half & (c("minute") > 30)}, sides, {"shots": F.lit(1), "xg": c("xg")})
    wide = wide.select("match_id", *[x for w in ("h1", "late") for m in ("shots", "xg") for x in pair_features(f"home_{w}_{m}", f"away_{w}_{m}", f"{w}_{m}")])
    events = timeline.groupBy("match_id").agg(count_if(half & (c("kind") == "goal")).alias("h1_goals"), count_if(half & (c("kind") == "card")).alias("h1_cards"), F.max(F.when(half & (c("kind") == "goal"), c("minute"))).alias("last_goal"))
    rows = core.withColumn("_target", h2_target(c("ht_home"), c("ht_away"), c("ft_home"), c("ft_away"), c("ambiguous")))
    for n in prior:
        rows = prior_mean(rows, [team], kickoff, metric, n, tie, f"prior_{n}")
    rows = expanding_mean(rows, [team], kickoff, metric, "season_mean")
    out = rows.join(wide, "match_id", "left").join(events, "match_id", "left").select("*", "_target.target", "_target.quality", "_target.eligible", c("_target.h2_total").alias("goals")).drop("_target")
    names = [x for x in out.columns if x not in core.columns and x not in ("target", "quality", "eligible", "goals")]
    return feature_coverage(out, names)
