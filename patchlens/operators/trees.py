"""Boosted trees and forests grown on counted cells, as Spark grows them on rows.

A tree of Spark ML sees a feature only as one of ``maxBins`` bins, so rows in the same bins with
the same label and weight, a cell, are alike to it for the whole fit. A few features have few
cells, however many rows there are: the rows are read to count the cells, and trees are grown
on those inside tasks, where a level is a few array operations and not a job of its own. Every row
counts. What a tree is made of is unchanged: the split candidates, gain, limits and pruning of Spark, and
the models are Spark's classes. Boosting gives the trees of Spark's own fit on the same candidates; a forest
draws a cell of n rows Poisson(n) times, which is how often n rows are drawn once each, from other random numbers.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from patchlens.session import run_dir, ship

CELLS = 1 << 16  # that the bins of all features may make
COUNTED = 1 << 18  # cells with rows, by label and weight, that a task grows trees on
VALUES = 1 << 20  # distinct values of all features, from which split candidates are chosen
TREES = 25  # of a forest that one task grows
EPSILON = 2.0**-52  # impurity below which a node is pure

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: long, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Cells:
    """Rows that trees cannot tell apart: their bins by feature, label, weight of each and number."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    thresholds: list[np.ndarray]

    @property
    def total(self) -> float:
        return float((self.weight * self.rows).sum())


@dataclass
class Limits:
    """What ends the growth of a tree."""

    depth: int
    rows: int
    weight: float
    gain: float


class CellTrees(Estimator):
    """A boosted or forest classifier that is fitted on cells where there are few, else by Spark on the rows."""

    def __init__(self, classifier: GBTClassifier | RandomForestClassifier):
        super().__init__()
        self.classifier = classifier

    def copy(self, extra=None) -> CellTrees:
        return CellTrees(self.classifier.copy(extra))

    def _fit(self, df: DataFrame) -> Transformer:
        cells = count_cells(df, self.classifier)
        return self.classifier.fit(df) if cells is None else fit_cells(df.sparkSession, cells, self.classifier)


def count_cells(df: DataFrame, classifier) -> Cells | None:
    """The cells of a training table; None for settings, values or numbers of cells that are left to Spark."""
    if not _plain(classifier) or not isinstance(df.schema[classifier.getLabelCol()].dataType, NumericType):
        return None
    size = df.schema[classifier.getFeaturesCol()].metadata.get("ml_attr", {}).get("num_attrs", 0)
    if not size or classifier.getMaxBins() ** size > CELLS:
        return None
    weighted = classifier.isDefined("weightCol") and classifier.getWeightCol()
    weight = F.col(classifier.getWeightCol()).cast("double") if weighted else F.lit(1.0)
    rows = df.select(
        F.col(classifier.getLabelCol()).cast("double").alias("label"),
        weight.alias("weight"),
        vector_to_array(classifier.getFeaturesCol()).alias("values"),
    )
    counts = rows.select(F.posexplode("values").alias("feature", "value"), "weight")
    counts = counts.groupBy("feature", "value").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))
    found = counts.limit(VALUES + 1).toPandas()
    if not len(found) or len(found) > VALUES or not np.isfinite(found["value"]).all():
        return None
    thresholds = []
    for i in range(size):
        own = found[found["feature"] == i].sort_values("value")
        most = min(classifier.getMaxBins(), int(own["rows"].sum())) - 1
        thresholds.append(split_candidates(own["value"].to_numpy(), own["weight"].to_numpy(), most))
    cell = F.lit(0).cast("long")
    for i, cuts in enumerate(thresholds):
        if len(cuts):
            rows = rows.withColumn(f"_v{i}", F.col("values")[i])
            ends = [-math.inf, *np.nextafter(cuts, math.inf).tolist(), math.inf]  # a value at a cut is below it
            rows = Bucketizer(splits=ends, inputCol=f"_v{i}", outputCol=f"_b{i}").transform(rows)
            cell = cell * (len(cuts) + 1) + F.col(f"_b{i}").cast("long")
    cells = rows.groupBy(cell.alias("cell"), "label", "weight").agg(F.count("*").alias("rows")).limit(COUNTED + 1).toPandas()
    if len(cells) > COUNTED or set(cells["label"]) != {0.0, 1.0} or not (cells["weight"] >= 0).all():
        return None
    cells = cells.sort_values(["cell", "label", "weight"])
    left, bins = cells["cell"].to_numpy(np.int64), np.zeros((size, len(cells)), np.int64)
    for i in reversed(range(size)):
        left, bins[i] = np.divmod(left, len(thresholds[i]) + 1)
    return Cells(bins, cells["label"].to_numpy(), cells["weight"].to_numpy(), cells["rows"].to_numpy(np.int64), thresholds)


def _plain(classifier) -> bool:
    """Whether the settings are those that cells stand for."""
    if classifier.getSubsamplingRate() != 1:
        return False
    if isinstance(classifier, GBTClassifier):
        checked = classifier.isDefined("validationIndicatorCol") and classifier.getValidationIndicatorCol()
        return not checked and classifier.getFeatureSubsetStrategy() in ("all", "auto")
    sampled = classifier.getBootstrap() and classifier.getNumTrees() > 1
    return sampled and classifier.getImpurity() == "gini" and classifier.getFeatureSubsetStrategy() in ("all", "auto", "sqrt")


def split_candidates(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between sorted distinct values, about the same weight between them, as Spark chooses them."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return np.unique(middles)
    stride = weights.sum() / (most + 1)
    target, chosen, passed = stride, [], np.cumsum(weights).tolist()
    for i in range(1, len(passed)):
        if abs(passed[i - 1] - target) < abs(passed[i] - target):
            chosen.append(i - 1)
            target += stride
    return np.unique(middles[chosen])


class _Tree:
    """Nodes of a tree in the order of their levels."""

    def __init__(self) -> None:
        self.stats, self.rows, self.impurity, self.prediction = [], [], [], []
        self.gain, self.feature, self.threshold, self.left, self.right = [], [], [], [], []
        self.levels: list[int] = []

    def add(self, stats: np.ndarray, rows: np.ndarray, impurity: np.ndarray, prediction: np.ndarray) -> None:
        n = len(rows)
        self.levels.append(n)
        for held, new in ((self.stats, stats), (self.rows, rows), (self.impurity, impurity), (self.prediction, prediction)):
            held.append(new)
        for held, value, kind in ((self.gain, -1.0, float), (self.feature, -1, int), (self.threshold, 0.0, float), (self.left, -1, int), (self.right, -1, int)):
            held.append(np.full(n, value, kind))

    def nodes(self, tree: int) -> pa.RecordBatch:
        """As a saved model has them: pruned, numbered from the root, a left child after its parent."""
        stats, rows, impurity, prediction, gain, feature, threshold, left, right = (
            np.concatenate(c)
            for c in (self.stats, self.rows, self.impurity, self.prediction, self.gain, self.feature, self.threshold, self.left, self.right)
        )
        ends = np.cumsum(self.levels)
        size = np.ones(len(rows), np.int64)
        for s, e in zip((ends - self.levels)[::-1].tolist(), ends[::-1].tolist(), strict=True):
            inner = np.arange(s, e)[left[s:e] >= 0]
            both = (left[left[inner]] < 0) & (left[right[inner]] < 0) & (prediction[left[inner]] == prediction[right[inner]])
            pruned = inner[both]
            left[pruned] = right[pruned] = feature[pruned] = -1
            gain[pruned] = -1.0
            inner = inner[~both]
            size[inner] = 1 + size[left[inner]] + size[right[inner]]
        number = np.full(len(rows), -1)
        number[0] = 0
        for s, e in zip((ends - self.levels).tolist(), ends.tolist(), strict=True):
            inner = np.arange(s, e)[(left[s:e] >= 0) & (number[s:e] >= 0)]
            number[left[inner]] = number[inner] + 1
            number[right[inner]] = number[inner] + 1 + size[left[inner]]
        kept = np.flatnonzero(number >= 0)
        leaf = left[kept] < 0
        child = [pa.array(np.where(leaf, -1, number[side[kept]]), pa.int32()) for side in (left, right)]
        cuts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(~leaf)), pa.int32()), pa.array(threshold[kept][~leaf]))
        none = pa.array(np.full(len(kept), -1), pa.int32())
        split = pa.StructArray.from_arrays([pa.array(feature[kept], pa.int32()), cuts, none], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        width = stats.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * width, pa.int32()), pa.array(stats[kept].ravel()))
        columns = {
            "id": pa.array(number[kept], pa.int32()),
            "prediction": pa.array(prediction[kept]),
            "impurity": pa.array(impurity[kept]),
            "impurityStats": lists,
            "rawCount": pa.array(rows[kept].astype(np.int64)),
            "gain": pa.array(gain[kept]),
            "leftChild": child[0],
            "rightChild": child[1],
            "split": split,
        }
        data = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), tree), pa.int32()), data], ["treeID", "nodeData"])


def _variance(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and mean of nodes with (weight, sum, sum of squares)."""
    weight, total, squares = stats.T
    held = np.where(weight > 0, weight, 1.0)
    return np.where(weight > 0, (squares - total * total / held) / held, 0.0), np.where(weight > 0, total / held, 0.0)


def _gini(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and class of nodes with the weights of two classes."""
    weight = stats.sum(1)
    share = stats / np.where(weight > 0, weight, 1.0)[:, None]
    return np.where(weight > 0, 1 - (share * share).sum(1), 0.0), stats.argmax(1).astype(float)


def _split_variance(weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a side, and by how much its impurity times its weight is below the sum of squares."""
    return weight, total * total / np.where(weight > 0, weight, 1.0)


def _split_gini(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a side, and by how much its impurity times its weight is below the weight."""
    weight = zero + one
    return weight, (zero * zero + one * one) / np.where(weight > 0, weight, 1.0)


MEASURES = {"variance": (_variance, _split_variance), "gini": (_gini, _split_gini)}


def grow(bins: np.ndarray, thresholds: Sequence[np.ndarray], parts: Sequence[np.ndarray], rows: np.ndarray, impurity: str, limits: Limits, subset=None) -> tuple[_Tree, np.ndarray]:
    """A tree on cells with ``rows`` and the statistics ``parts``, which add up; and the prediction of each cell.

    A split is judged by the first two of the parts. ``subset`` gives the features that each of
    so many nodes may use, as flags.
    """
    node, side = MEASURES[impurity]
    tree, rows = _Tree(), rows.astype(float)
    stats, counts = np.array([[p.sum() for p in parts]]), np.array([rows.sum()])
    impure, prediction = node(stats)
    tree.add(stats, counts, impure, prediction)
    predicted = np.full(len(rows), prediction[0])
    # a side without rows has no weight, if no row is without weight
    judged = 2 if limits.rows <= 1 and (side(*parts[:2])[0] > 0).all() else 3
    usable = [f for f, cuts in enumerate(thresholds) if len(cuts)]
    # the cells that stand in nodes to split, with the number of the node among those
    cells, where = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    bins, added = [bins[f] for f in range(len(thresholds))], [*parts[:2], rows, *parts[2:]]
    open_nodes = np.zeros(1, np.int64)  # their places in the level
    for level in range(limits.depth if usable else 0):
        n = len(open_nodes)
        allowed = subset(n) if subset else None
        best, feature, cut = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for f in usable:
            width, number, at, own, counted = len(thresholds[f]) + 1, n, where, bins[f], added[:judged]
            if allowed is not None:
                some = np.flatnonzero(allowed[:, f])
                number = len(some)
                if not number:
                    continue
                place = np.full(n, -1)
                place[some] = np.arange(number)
                at = place[where]
                use = np.flatnonzero(at >= 0)
                at, own, counted = at[use], own[use], [p[use] for p in counted]
            flat = at * width + own
            sums = [np.bincount(flat, p, number * width).reshape(number, width).cumsum(1) for p in counted]
            left = [x[:, :-1] for x in sums]
            right = [x[:, -1:] - x[:, :-1] for x in sums]
            all_weight, whole = side(*(x[:, -1:] for x in sums[:2]))
            (w, x), (v, y) = side(*left[:2]), side(*right[:2])
            gain = (x + y - whole) / np.where(all_weight > 0, all_weight, 1.0)
            bad = (w <= 0) | (v <= 0) | (w < limits.weight) | (v < limits.weight) | (gain < limits.gain)
            if len(sums) > 2:
                bad |= (left[2] < limits.rows - 0.5) | (right[2] < limits.rows - 0.5)
            gain[bad] = -np.inf
            chosen = gain.argmax(1)
            gain = gain[np.arange(number), chosen]
            better = gain > (best if allowed is None else best[some])
            places = np.flatnonzero(better) if allowed is None else some[better]
            best[places], feature[places], cut[places] = gain[better], f, chosen[better]
        split = np.flatnonzero(best > 0)
        if not len(split):
            break
        # cells go on to the children of their node
        order = np.full(n, -1)
        order[split] = np.arange(len(split))
        if len(split) < n:
            going = np.flatnonzero(order[where] >= 0)
            cells, where, bins, added = cells[going], where[going], [x[going] for x in bins], [x[going] for x in added]
        used = feature[where]
        above = bins[usable[0]] if len(usable) == 1 else np.choose(used, bins)
        child = 2 * order[where] + (above > cut[where])
        first, second, counts, *more = (np.bincount(child, p, 2 * len(split)) for p in added)
        stats = np.stack((first, second, *more), 1)
        impure, prediction = node(stats)
        base, places = sum(tree.levels), open_nodes[split]
        tree.gain[level][places], tree.feature[level][places] = best[split], feature[split]
        tree.threshold[level][places] = [thresholds[f][c] for f, c in zip(feature[split].tolist(), cut[split].tolist(), strict=True)]
        tree.left[level][places] = base + 2 * np.arange(len(split))
        tree.right[level][places] = base + 2 * np.arange(len(split)) + 1
        tree.add(stats, counts, impure, prediction)
        predicted[cells] = prediction[child]
        open_nodes = np.flatnonzero(np.abs(impure) >= EPSILON)
        if not len(open_nodes):
            break
        where = child
        if len(open_nodes) < len(counts):
            order = np.full(len(counts), -1)
            order[open_nodes] = np.arange(len(open_nodes))
            where = order[child]
            going = np.flatnonzero(where >= 0)
            cells, where, bins, added = cells[going], where[going], [x[going] for x in bins], [x[going] for x in added]
    return tree, predicted


def boost(cells: Cells, rounds: int, step: float, limits: Limits) -> Iterator[_Tree]:
    """The trees of boosting by the logistic loss, first the labels and then what is left of them."""
    sign, weight = 2 * cells.label - 1, cells.weight * cells.rows
    score = np.zeros(len(sign))
    for m in range(rounds):
        target = sign if m == 0 else 4 * sign / (1 + np.exp(2 * sign * score))
        parts = (weight, weight * target, weight * target * target)
        tree, predicted = grow(cells.bins, cells.thresholds, parts, cells.rows, "variance", limits)
        score += predicted if m == 0 else step * predicted
        yield tree


def forest_tree(cells: Cells, tree: int, seed: int, strategy: str, limits: Limits) -> _Tree:
    """A tree of a forest: rows drawn with replacement, features drawn for each node."""
    rng = np.random.default_rng([tree, seed % (1 << 63)])
    drawn = rng.poisson(cells.rows)
    some = drawn > 0
    rows, label = drawn[some], cells.label[some]
    weight = cells.weight[some] * rows
    size = len(cells.thresholds)
    used = size if strategy == "all" else math.ceil(math.sqrt(size))

    def subset(n: int) -> np.ndarray:
        return rng.random((n, size)).argsort(1).argsort(1) < used

    parts = [np.where(label == c, weight, 0.0) for c in (0, 1)]
    return grow(cells.bins[:, some], cells.thresholds, parts, rows, "gini", limits, subset if used < size else None)[0]


def fit_cells(spark, cells: Cells, classifier) -> Transformer:
    """The fitted model, read back from the form in which Spark saves one; tasks write its trees."""
    ship(spark)
    boosted = isinstance(classifier, GBTClassifier)
    trees = classifier.getMaxIter() if boosted else classifier.getNumTrees()
    least = classifier.getMinWeightFractionPerNode() * cells.total
    limits = Limits(classifier.getMaxDepth(), classifier.getMinInstancesPerNode(), least, classifier.getMinInfoGain())
    step = classifier.getStepSize() if boosted else 1.0
    seed, strategy = classifier.getSeed(), classifier.getFeatureSubsetStrategy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                if boosted:
                    for m, tree in enumerate(boost(cells, trees, step, limits)):
                        yield tree.nodes(m)
                else:
                    for t in range(part * TREES, min(trees, (part + 1) * TREES)):
                        yield forest_tree(cells, t, seed, strategy, limits).nodes(t)

    path = run_dir(spark, "trees")
    parts = 1 if boosted else -(-trees // TREES)
    spark.range(0, parts, 1, parts).mapInArrow(run, NODES).write.parquet(f"{path}/data")
    kind = "regression.DecisionTreeRegressionModel" if boosted else "classification.DecisionTreeClassificationModel"
    about = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    about |= {"paramMap": {"impurity": classifier.getImpurity(), "maxDepth": limits.depth}, "defaultParamMap": {}}
    rows = [(t, json.dumps({**about, "uid": f"{classifier.uid}_{t}"}), 1.0 if not boosted or t == 0 else float(step)) for t in range(trees)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = GBTClassificationModel if boosted else RandomForestClassificationModel
    about |= {"class": f"org.apache.spark.ml.classification.{model.__name__}", "uid": classifier.uid}
    about |= {"numFeatures": len(cells.thresholds), "numTrees": trees} | ({} if boosted else {"numClasses": 2})
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    fitted = classifier._copyValues(model.load(path))
    fitted._transfer_params_to_java()
    return fitted
