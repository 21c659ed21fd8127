"""Tree ensembles that Spark's own library lacks: gradient boosting for several classes, and extremely randomised trees.

Both are built level by level, one grouped aggregate over the rows for each level of all trees at once: rows go to their
nodes by the trees built so far (a few hundred numbers), and only sums for each (tree, node, feature, bin or threshold) are
shuffled, partly aggregated before. Rows that are equal in all features, class and weight are one row with their number (for
boosting: equal in their bins), which changes no sum. What the driver holds is bounded by the trees, not by the rows. Sums are of integers
(gradients in steps of 2**-24), so they don't depend on the order of rows or on tasks that run again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.operators.selection import counted_quantiles, quantile_grid
from pitchspark.staging import release, spread, staged

#: What the number of a bin is kept in.
BIN = np.int32
#: Steps of a gradient's unit; least sum of hessians of a leaf; rounds after which the rows' scores are written again.
UNIT, LEAST_HESSIAN, RESTAGE = 2**24, 1e-3, 8


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. A row goes left if its value is at most the threshold."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[0.0]])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, float(threshold)
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(self.value[node])
        return self.left[node], self.right[node]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` (rows by features)."""
        at = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.asarray(self.feature), np.asarray(self.threshold)
        left, right = np.asarray(self.left), np.asarray(self.right)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


@dataclass
class Ensemble:
    """``kind``: boosting (scores are summed, then a softmax or for one class a sigmoid) or mean (of class shares)."""

    kind: str
    features: list[str]
    medians: list[float]
    classes: int
    start: list[float]
    trees: list[tuple[int, Tree]]  # the class a boosting tree is for, and the tree

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _probabilities(self.raw(x), self)

    def raw(self, x: np.ndarray, scores: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        """Scores by all trees, or ``scores`` with those of the trees from number ``since`` on."""
        out = np.tile(np.asarray(self.start, dtype=float), (len(x), 1)) if scores is None else scores.copy()
        for k, tree in self.trees[since:]:
            value = np.asarray(tree.value, dtype=float)[tree.leaf_of(x)]
            if self.kind == "mean":
                out += value
            else:
                out[:, k] += value[:, 0]
        return out

    def transform(self, rows: DataFrame, name: str = "class_probability") -> DataFrame:
        """``rows`` with an array of probabilities of the classes; missing features count as the training rows' medians."""
        model = self

        @F.pandas_udf("array<double>")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(model.features)))
                yield pd.Series(list(model.probabilities(x)))

        return rows.withColumn(name, predict(_vector(self.features, self.medians)))

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"trees": [[k, t.__dict__] for k, t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        data = json.loads(text)
        return Ensemble(**(data | {"trees": [(k, Tree(**t)) for k, t in data["trees"]]}))


def _probabilities(raw: np.ndarray, model: Ensemble) -> np.ndarray:
    if model.kind == "mean":
        return raw / np.maximum(raw.sum(axis=1, keepdims=True), 1e-300)
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _vector(features: list[str], medians: list[float]) -> Column:
    known = [F.when(F.isnan(c), None).otherwise(c) for c in (F.col(f).cast("double") for f in features)]
    return F.array(*[F.coalesce(c, F.lit(float(m))) for c, m in zip(known, medians, strict=True)])


def feature_medians(rows: DataFrame, features: list[str], count: str | None = None) -> list[float]:
    """The median of each feature's known values (0 for none), selected exactly. A row stands for ``count`` rows, if that is given."""
    known = [F.col(f).cast("double") for f in features]
    cells = F.array(*[F.struct(F.lit(k).alias("m"), F.when(~F.isnan(v), v).alias("value")) for k, v in enumerate(known)])
    own = [F.col(count).alias("n")] if count else []
    flat = rows.select(F.struct(F.lit(0).alias("_all")).alias("key"), *own, F.explode(cells).alias("c")).where("c.value IS NOT NULL")
    names = [f"f{k}" for k in range(len(features))]
    found = counted_quantiles(flat.select("key", "c.m", "c.value", *(["n"] if own else [])), [], {x: (k, 0.5) for k, x in enumerate(names)}).first()
    return [0.0 if found is None or found[x] is None else float(found[x]) for x in names]


def _prepared(rows: DataFrame, features: list[str], label: str, classes: int, weight: str | None) -> tuple[DataFrame, list[float], list[float]]:
    """Narrow staged rows (x, y, w in units, n: how many equal ones), medians, and the weight of each class. Rows without a
    class are left out."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    names = [f"x{k}" for k in range(len(features))]
    narrow = spread(rows).select(*[F.col(f).cast("double").alias(x) for f, x in zip(features, names, strict=True)], F.col(label).cast("int").alias("y"), F.round(w * UNIT).cast("long").alias("w"))
    cells = staged(_dealt(narrow.groupBy(*names, "y", "w").agg(F.count("*").alias("n"))), "trees-rows")
    medians = feature_medians(cells, names, "n")
    table = cells.select(_vector(names, medians).alias("x"), "y", "w", "n").where(F.col("y").between(0, classes - 1))
    table._staged_path = cells._staged_path
    found = table.groupBy("y").agg(F.sum(F.col("w") * F.col("n")).alias("w")).collect()  # one row for each class
    shares = [0.0] * classes
    for r in found:
        shares[r.y] = r.w / UNIT
    return table, medians, shares


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` evenly in at least as many parts as there are cores: they are read once for each level."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _packed(table: DataFrame, change: Callable[[np.ndarray], np.ndarray], again: bool = False) -> DataFrame:
    """``table`` with the numbers that ``change`` makes of its features as bytes, staged in its place; with ``again``, rows that
    have become equal are one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([_bytes(change(x)), *(batch.column(i) for i in range(1, 4))], names=["x", "y", "w", "n"])

    out = table.mapInArrow(run, "x binary, y int, w long, n long")
    if again:
        out = _dealt(out.groupBy("x", "y", "w").agg(F.sum("n").alias("n")))
    out = staged(out, "trees-packed")
    release(table)
    return out


def _bytes(x: np.ndarray):
    """An Arrow array with the bytes of each row of ``x``."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    width = x.itemsize * x.shape[1]
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x.tobytes())])


def _unpacked(column, kind) -> np.ndarray:
    """Rows of numbers out of a column made by :func:`_bytes`."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


# --- boosting ----------------------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: list[str], medians: list[float], bins: int, count: Column | None = None) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: half-way between its distinct values if there are few, else quantiles
    at equal steps of rank, selected exactly for all features together. A row stands for ``count`` rows, if that is given."""
    x = {f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(m)) for f, m in zip(features, medians, strict=True)}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), c.alias("v")) for k, c in enumerate(x.values())])).alias("c")
    distinct = rows.select(cells).select("c.*").distinct()
    few = distinct.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") <= bins)
    edges: list[np.ndarray] = [np.empty(0)] * len(features)
    known = set()
    for r in distinct.join(few, "f").groupBy("f").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():  # ``bins`` values a feature at most
        v = np.asarray(r.v, dtype=float)
        edges[r.f] = (v[:-1] + v[1:]) / 2
        known.add(r.f)
    many = [k for k in range(len(features)) if k not in known]
    if many:
        grid: dict[int, list[float]] = {}
        for r in quantile_grid(rows, [x[features[k]] for k in many], bins, count).collect():  # ``bins`` rows a feature at most
            grid.setdefault(many[r.measure], []).append(r.value)
        for k, values in grid.items():
            edges[k] = np.unique(values)
    return edges


def _gradients(y: np.ndarray, raw: np.ndarray, model: Ensemble) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by score (rows by trees)."""
    p = _probabilities(raw, model)
    if raw.shape[1] == 1:
        return p[:, 1:] - (y == 1)[:, None], p[:, 1:] * p[:, :1]
    return p - (y[:, None] == np.arange(raw.shape[1])), p * (1 - p)


def _rescored(table: DataFrame, model: Ensemble, since: int) -> DataFrame:
    """The rows with their scores by the trees so far, staged in place of ``table``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), _bytes(_raw(batch, model, since))], names=["x", "y", "w", "n", "s"])

    out = staged(table.mapInArrow(run, "x binary, y int, w long, n long, s binary"), "trees-scores")
    release(table)
    return out


def _raw(batch, model: Ensemble, since: int) -> np.ndarray:
    x = _unpacked(batch.column(0), BIN)
    return model.raw(x) if batch.num_columns < 5 else model.raw(x, _unpacked(batch.column(4), np.float64), since)


def _summed(at: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Sums of the integers ``v`` by place: a count with weights, several times as fast as ``np.add.at``, where doubles hold
    every sum exactly; else that."""
    if float(np.abs(v).sum(dtype=np.float64)) < 2.0**52:
        return np.bincount(at, weights=v, minlength=size).astype(np.int64)
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, at, v)
    return out


def _histograms(model: Ensemble, since: int, growing: list[Tree], open_nodes: list[list[int]], edges: list[np.ndarray]):
    """A function over record batches of rows (x, y, w, scores): sums for each tree, open node, feature and bin of its rows."""
    ids = "tree int, node int, feature int, bin int, g long, h long, n long"

    def run(batches):
        import pyarrow as pa

        size = max(len(e) for e in edges) + 1
        apart = [f for f, e in enumerate(edges) if f == 0 or len(e)]  # features that can split; the first also has a node's sums
        places = [np.full(len(t.feature), -1, dtype=np.int64) for t in growing]
        for k, nodes in enumerate(open_nodes):
            places[k][nodes] = np.arange(len(nodes))
        sums = [np.zeros((3, len(nodes), len(edges), size), dtype=np.int64) for nodes in open_nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, n = _arrays(batch, BIN)
            g, h = _gradients(y, _raw(batch, model, since), model)
            g, h = (np.rint(v * w[:, None]).astype(np.int64) * n[:, None] for v in (g, h))
            binned = x + np.arange(len(edges)) * size
            for k, tree in enumerate(growing):
                place = places[k][tree.leaf_of(x)]
                inside = place >= 0
                if not inside.any():
                    continue
                base = place[inside] * (len(edges) * size)
                own = (g[inside, k], h[inside, k], n[inside])
                for f in apart:
                    at = base + binned[inside, f]
                    for i, v in enumerate(own):
                        sums[k][i].ravel()[:] += _summed(at, v, sums[k][i].size)
        for k, total in enumerate(sums):
            node, f, b = np.nonzero(total[2])
            columns = [np.full(len(node), k), np.asarray(open_nodes[k], dtype=np.int64)[node], f, b]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], *[pa.array(total[i][node, f, b]) for i in range(3)]], names=[c.split()[0] for c in ids.split(", ")])

    return run, ids


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a node from its sums (features by bins), rows of bins up to it going left; the
    first feature and bin of those with equal gain."""
    gl, hl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h, n))
    gt, ht, nt = (v.sum(axis=1, keepdims=True) for v in (g, h, n))
    score = lambda a, b: a * a / (b + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    allowed = (nl >= least_rows) & (nt - nl >= least_rows) & (hl >= LEAST_HESSIAN) & (ht - hl >= LEAST_HESSIAN)
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size or gain.max() <= 0:
        return 0.0, -1, -1
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def _best_first(tree: Tree, gains: dict[int, tuple[float, int, int]], leaves: int) -> tuple[list[int], list[int]]:
    """Nodes that the tree of ``leaves`` leaves splits, best gain first, as far as gains are known; and the nodes at which a
    gain is wanted to go on."""
    heap, split, unknown = [], [], []

    def offer(node: int) -> None:
        if node not in gains:
            unknown.append(node)
        elif gains[node][1] >= 0:
            heapq.heappush(heap, (-gains[node][0], node))

    offer(0)
    while heap and len(split) + 1 < leaves:
        _, node = heapq.heappop(heap)
        split.append(node)
        if tree.left[node] < 0:
            unknown.append(node)  # not split yet
            continue
        offer(tree.left[node])
        offer(tree.right[node])
    return split, unknown


def fit_boosting(
    rows: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None, *, max_iter: int = 150, learning_rate: float = 0.05,
    max_leaf_nodes: int = 15, l2: float = 0.0, bins: int = 255, min_samples_leaf: int = 20,
) -> Ensemble:
    """Gradient boosting on binned features: a tree for each class and round (softmax loss), or for two classes one (log loss).

    Trees grow best gain first up to ``max_leaf_nodes``: a level's nodes that could still be split get their histograms in one
    aggregate over the rows for all classes, until what is known settles which nodes are split.
    """
    table, medians, shares = _prepared(rows, features, label, classes, weight)
    if sum(shares) <= 0:
        raise ValueError("no rows to learn from")
    shown = np.maximum(np.asarray(shares) / sum(shares), 1e-12)
    start = [float(np.log(shown[1] / shown[0]))] if classes == 2 else [float(x) for x in np.log(shown)]
    model = Ensemble("boosting", features, medians, classes, start, [])
    edges = bin_edges(table.select("n", *[F.col("x")[k].alias(f) for k, f in enumerate(features)]), features, medians, bins, F.col("n"))
    table = _packed(table, lambda x: np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(BIN), True)
    binned = Ensemble("boosting", features, medians, classes, start, [])  # the same trees, with numbers of bins for thresholds
    since = 0
    for done in range(max_iter):
        if done and done % RESTAGE == 0:
            table, since = _rescored(table, binned, since), len(binned.trees)
        trees = [Tree() for _ in start]
        gains: list[dict] = [{} for _ in trees]
        totals: list[dict] = [{} for _ in trees]
        wanted = [[0] for _ in trees]
        while any(wanted):
            run, schema = _histograms(binned, since, trees, wanted, edges)
            found = table.mapInArrow(run, schema).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
            _note(found.toPandas(), trees, wanted, gains, totals, len(edges), max(len(e) for e in edges) + 1, l2, min_samples_leaf)
            wanted = [[] for _ in trees]
            for k, tree in enumerate(trees):
                while True:
                    _, unknown = _best_first(tree, gains[k], max_leaf_nodes)
                    ready = [x for x in unknown if x in gains[k]]
                    if not ready:
                        wanted[k] = unknown
                        break
                    for node in ready:  # its gain is known: it gets children, whose gains aren't
                        _, f, b = gains[k][node]
                        tree.split(node, f, b)
        for k, tree in enumerate(trees):
            chosen, _ = _best_first(tree, gains[k], max_leaf_nodes)
            grown = _pruned(tree, set(chosen), totals[k], l2, learning_rate)
            binned.trees.append((k, grown))
            model.trees.append((k, replace(grown, threshold=[float(edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(grown.feature, grown.threshold, strict=True)])))
        if all(len(t.feature) == 1 for _, t in model.trees[-len(trees) :]):
            break  # nothing left to learn
    release(table)
    return model


def _note(sums, trees: list[Tree], wanted: list[list[int]], gains: list[dict], totals: list[dict], n_features: int, n_bins: int, l2: float, least: int) -> None:
    """Best splits and sums of the nodes that were asked for; a node without rows can't be split."""
    for k, nodes in enumerate(wanted):
        for node in nodes:
            part = sums[(sums.tree == k) & (sums.node == node)]
            cells = np.zeros((3, n_features, n_bins))
            for i, c in enumerate(("g", "h", "n")):
                cells[i][part.feature, part.bin] = part[c] if c == "n" else part[c] / UNIT
            gains[k][node] = best_split(*cells, l2, least)
            totals[k][node] = (cells[0][0].sum(), cells[1][0].sum())


def _pruned(tree: Tree, chosen: set[int], totals: dict, l2: float, rate: float) -> Tree:
    """The tree with the chosen splits alone, and its leaves' values."""
    out = Tree()

    def copy(node: int, to: int) -> None:
        if node in chosen:
            left, right = out.split(to, tree.feature[node], tree.threshold[node])
            copy(tree.left[node], left)
            copy(tree.right[node], right)
        else:
            g, h = totals[node]
            out.value[to] = [float(-rate * g / (h + l2)) if h + l2 > 0 else 0.0]

    copy(0, 0)
    return out


# --- extremely randomised trees ----------------------------------------------------------------------------------


def _drawn(seed: int, tree: int, node: int, n: int) -> np.ndarray:
    """Numbers from 0 to 1 of a node, the same whenever and wherever it is drawn."""
    return np.random.default_rng([seed, tree, node]).random(n)


def candidates(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` features of a node that aren't constant there, and a random threshold of each within its range."""
    u = _drawn(seed, tree, path, 2 * len(low))
    usable = np.flatnonzero(high > low)
    chosen = usable[np.argsort(u[usable], kind="stable")][:k]
    return chosen, low[chosen] + u[len(low) + chosen] * (high[chosen] - low[chosen])


def gini_gain(left: np.ndarray, total: np.ndarray) -> float:
    """Fall of the summed Gini impurity (weights of classes) by a split."""
    impure = lambda c: c.sum() - (c * c).sum() / c.sum() if c.sum() > 0 else 0.0
    return float(impure(total) - impure(left) - impure(total - left))


def _ranges(trees: list[Tree], nodes: list[list[int]], n_features: int, classes: int):
    """A function over record batches: for each tree and node the class weights and the range of each feature of its rows."""
    ids = "tree int, node int, n long, classes array<long>, low array<double>, high array<double>"

    def run(batches):
        import pyarrow as pa

        spot = _spots(trees, nodes)
        count = [np.zeros((len(x), classes), dtype=np.int64) for x in nodes]
        rows = [np.zeros(len(x), dtype=np.int64) for x in nodes]
        low = [np.full((len(x), n_features), np.inf) for x in nodes]
        high = [np.full((len(x), n_features), -np.inf) for x in nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, n = _arrays(batch, np.float64)
            w = w * n
            for t, tree in enumerate(trees):
                if not nodes[t]:
                    continue
                place = spot[t][tree.leaf_of(x)]
                inside = place >= 0
                if not inside.any():
                    continue
                place, own = place[inside], x[inside]
                count[t] += _summed(place * classes + y[inside], w[inside], count[t].size).reshape(count[t].shape)
                rows[t] += _summed(place, n[inside], len(rows[t]))
                order = np.argsort(place, kind="stable")  # rows of a node stand together
                begin = np.flatnonzero(np.append(True, np.diff(place[order]) != 0))
                node = place[order][begin]
                low[t][node] = np.minimum(low[t][node], np.minimum.reduceat(own[order], begin, axis=0))
                high[t][node] = np.maximum(high[t][node], np.maximum.reduceat(own[order], begin, axis=0))
        out = [(t, node, int(rows[t][i]), count[t][i].tolist(), low[t][i].tolist(), high[t][i].tolist()) for t, own in enumerate(nodes) for i, node in enumerate(own) if rows[t][i]]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "node", "n", "classes", "low", "high"])

    return run, ids


def _spots(trees: list[Tree], nodes: list[list[int]]) -> list[np.ndarray]:
    out = [np.full(len(t.feature), -1, dtype=np.int64) for t in trees]
    for t, own in enumerate(nodes):
        out[t][own] = np.arange(len(own))
    return out


def _arrays(batch, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(batch.column(0), kind), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))


def _scores(trees: list[Tree], tried: list[dict[int, tuple]], n_features: int, classes: int):
    """A function over record batches: class weights and rows left of each random threshold."""
    ids = "tree int, node int, choice int, n long, classes array<long>"

    def run(batches):
        import pyarrow as pa

        spot = _spots(trees, [list(own) for own in tried])
        most = [max((len(c[0]) for c in own.values()), default=0) for own in tried]
        feature = [np.zeros((len(own), k), dtype=np.int64) for own, k in zip(tried, most, strict=True)]
        threshold = [np.full((len(own), k), -np.inf) for own, k in zip(tried, most, strict=True)]  # a node may have fewer choices
        for t, own in enumerate(tried):
            for i, (features, thresholds) in enumerate(own.values()):
                feature[t][i, : len(features)], threshold[t][i, : len(features)] = features, thresholds
        count = [np.zeros((len(own), k, classes), dtype=np.int64) for own, k in zip(tried, most, strict=True)]
        rows = [np.zeros((len(own), k), dtype=np.int64) for own, k in zip(tried, most, strict=True)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, n = _arrays(batch, np.float64)
            w = w * n
            for t, tree in enumerate(trees):
                if not tried[t]:
                    continue
                place = spot[t][tree.leaf_of(x)]
                inside = np.flatnonzero(place >= 0)
                place = place[inside]
                row, choice = np.nonzero(x[inside[:, None], feature[t][place]] <= threshold[t][place])
                at, own = place[row] * most[t] + choice, inside[row]
                rows[t] += _summed(at, n[own], rows[t].size).reshape(rows[t].shape)
                count[t] += _summed(at * classes + y[own], w[own], count[t].size).reshape(count[t].shape)
        out = [(t, node, i, int(rows[t][j, i]), count[t][j, i].tolist()) for t, own in enumerate(tried) for j, (node, c) in enumerate(own.items()) for i in range(len(c[0]))]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "node", "choice", "n", "classes"])

    return run, ids


def _added(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(name)[i]) for i in range(n)]).alias(name)


def fit_extra_trees(
    rows: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None, *, n_estimators: int = 150, max_depth: int = 12,
    min_samples_leaf: int = 2, max_features: int | str = "sqrt", seed: int = 42, together: int = 32,
) -> Ensemble:
    """Trees whose nodes try a random threshold for each of a few random features, on all rows; no values are sorted.

    Two aggregates a level: ranges of the features of every open node, then the scores of its thresholds; ``together`` trees
    grow side by side. Draws depend on the seed, the tree and the node's path alone. ``max_depth`` bounds the driver's part:
    a tree has 2 ** ``max_depth`` leaves at most.
    """
    if not 1 <= max_depth <= 16:
        raise ValueError("max_depth must be from 1 to 16")
    table, medians, shares = _prepared(rows, features, label, classes, weight)
    if sum(shares) <= 0:
        raise ValueError("no rows to learn from")
    table = _packed(table, lambda x: x)
    n = len(features)
    k = max(1, int(n**0.5)) if max_features == "sqrt" else n if max_features in (None, "all") else int(max_features)
    model = Ensemble("mean", features, medians, classes, [0.0] * classes, [])
    for first in range(0, n_estimators, together):
        trees = [Tree() for _ in range(min(together, n_estimators - first))]
        paths = [{0: 1} for _ in trees]  # of each open node, its way from the root in bits
        for depth in range(max_depth + 1):
            nodes = [sorted(p) for p in paths]
            if not any(nodes):
                break
            run, schema = _ranges(trees, nodes, n, classes)
            seen = table.mapInArrow(run, schema).groupBy("tree", "node")
            low = F.array(*[F.min(F.col("low")[i]) for i in range(n)]).alias("low")
            high = F.array(*[F.max(F.col("high")[i]) for i in range(n)]).alias("high")
            known = {(r.tree, r.node): r for r in seen.agg(F.sum("n").alias("n"), _added("classes", classes), low, high).collect()}  # open nodes
            tried: list[dict] = [{} for _ in trees]
            for (t, node), r in known.items():
                total = np.asarray(r.classes, dtype=float)
                trees[t].value[node] = (total / max(total.sum(), 1e-300)).tolist()
                if depth < max_depth and r.n >= 2 * min_samples_leaf and (total > 0).sum() > 1:
                    chosen = candidates(seed, first + t, paths[t][node], np.asarray(r.low), np.asarray(r.high), k)
                    if len(chosen[0]):
                        tried[t][node] = chosen
            paths, before = [{} for _ in trees], paths
            if not any(tried):
                break
            run, schema = _scores(trees, tried, n, classes)
            best: dict = {}
            for r in table.mapInArrow(run, schema).groupBy("tree", "node", "choice").agg(F.sum("n").alias("n"), _added("classes", classes)).collect():
                whole = known[r.tree, r.node]
                if min(r.n, whole.n - r.n) >= min_samples_leaf:
                    gain = gini_gain(np.asarray(r.classes) / UNIT, np.asarray(whole.classes) / UNIT)
                    if gain > 1e-12:
                        best[r.tree, r.node] = max(best.get((r.tree, r.node), (0.0, 0)), (gain, -r.choice))
            for (t, node), (_, choice) in sorted(best.items()):
                f, threshold = (v[-choice] for v in tried[t][node])
                left, right = trees[t].split(node, int(f), float(threshold))
                paths[t][left], paths[t][right] = before[t][node] * 2, before[t][node] * 2 + 1
        model.trees += [(0, t) for t in trees]
    release(table)
    return model
