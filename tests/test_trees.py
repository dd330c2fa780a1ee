"""Trees on counted cells against Spark's own fits on rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patchlens.operators import models as L
from patchlens.operators import trees as T
from patchlens.plans import queries

COLS = ["a", "b", "c"]


def _number(seed, most):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most)).cast("double")


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(4000).select("id", _number(1, 200).alias("a"), _number(2, 3000).alias("b"), _number(3, 5).alias("c"), _number(4, 100).alias("noise"))
    risk = F.col("a") / 200 + F.col("b") / 3000 * F.col("c") / 5 + F.col("noise") / 150
    df = df.withColumn("label", (risk > 1.1).cast("double"))
    return df.withColumn("weight", F.when(F.col("label") == 1, 1.7).otherwise(0.6)).cache()


@pytest.fixture(scope="module")
def scaled(rows):
    return L.PipelineModel(L.train(rows, COLS, kind="lr").stages[:-1]).transform(rows).cache()


def _probabilities(model, df):
    scored = model.transform(df).select("id", vector_to_array("probability")[1].alias("p"))
    return scored.orderBy("id").toPandas()["p"].to_numpy()


@pytest.mark.parametrize("weight", [None, "weight"])
@pytest.mark.parametrize("params", [{"maxIter": 6, "maxDepth": 4}, {"maxIter": 3, "maxDepth": 4, "minInstancesPerNode": 150, "minInfoGain": 0.001, "maxBins": 20}])
def test_boosting_gives_the_trees_of_spark(scaled, weight, params):
    """In trees this low no two splits of a node are equally good, so that sums in another order choose the same."""
    stage = L.classifier("gbt", "label", weight, **params)
    ours, spark_s = stage.fit(scaled), stage.classifier.fit(scaled)
    assert T.count_cells(scaled, stage.classifier) is not None
    assert _probabilities(ours, scaled) == pytest.approx(_probabilities(spark_s, scaled), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(spark_s.featureImportances.toArray(), abs=1e-9)
    assert all(ours.getOrDefault(k) == v for k, v in params.items())


def test_a_forest_is_like_one_of_spark(scaled, monkeypatch):
    stage = L.classifier("rf", "label", "weight", numTrees=40, maxDepth=8)
    ours, spark_s = stage.fit(scaled), stage.classifier.fit(scaled)
    assert ours.getNumTrees == 40
    mine, theirs = _probabilities(ours, scaled), _probabilities(spark_s, scaled)
    assert np.corrcoef(mine, theirs)[0, 1] > 0.98 and abs(mine.mean() - theirs.mean()) < 0.01
    assert max(t.depth for t in ours.trees) <= 8
    assert ours.totalNumNodes == pytest.approx(spark_s.totalNumNodes, rel=0.1)
    assert len({t.toDebugString.split("\n", 1)[1] for t in ours.trees}) == 40
    monkeypatch.setattr(T, "TREES", 7)  # the forest does not depend on how it is dealt
    again = L.classifier("rf", "label", "weight", numTrees=40, maxDepth=8).fit(scaled)
    assert _probabilities(again, scaled).tolist() == mine.tolist()


@pytest.mark.parametrize(("kind", "params"), [("gbt", {"maxIter": 40}), ("rf", {"numTrees": 60, "maxDepth": 12})])
def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark, rows, kind, params):
    """Spark's own fit has a job for each tree level."""
    context = spark.sparkContext
    context.setJobGroup(f"fit-{kind}", "fit")
    try:
        model = L.train(rows, COLS, kind=kind, weight_col="weight", **params)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup(f"fit-{kind}"))
    assert model.stages[-1].getNumTrees >= 40 and 0 < jobs <= 30


def test_every_row_is_in_a_cell(scaled, rows):
    stage = L.classifier("gbt", "label", "weight").classifier
    cells = T.count_cells(scaled, stage)
    assert cells.rows.sum() == rows.count() and len(cells.rows) < 4000
    assert cells.total == pytest.approx(rows.agg(F.sum("weight")).first()[0])
    assert all(len(cuts) == most for cuts, most in zip(cells.thresholds, (31, 31, 4), strict=True))


def test_what_cells_do_not_stand_for_is_left_to_spark(spark, scaled, monkeypatch):
    def counted(kind, df=scaled, weight=None, **params):
        return T.count_cells(df, L.classifier(kind, "label", weight, **params).classifier) is not None

    assert counted("gbt") and counted("rf") and counted("rf", weight="weight")
    assert not counted("gbt", subsamplingRate=0.8) and not counted("rf", subsamplingRate=0.5)
    assert not counted("gbt", validationIndicatorCol="label") and not counted("rf", numTrees=1)
    assert not counted("rf", featureSubsetStrategy="log2") and not counted("gbt", maxBins=64)  # 64 ^ 3 cells
    assert not counted("gbt", scaled.filter("label = 1")) and not counted("gbt", scaled.limit(0))
    assert not counted("gbt", scaled.withColumn("weight", F.lit(None).cast("double")), "weight")
    for name in ("VALUES", "COUNTED"):
        with monkeypatch.context() as limited:
            limited.setattr(T, name, 100)
            assert not counted("gbt")
            assert L.classifier("gbt", "label", None, maxIter=2).fit(scaled).getNumTrees == 2


def test_missing_and_constant_features(spark):
    rows = [(float(i % 9) if i % 4 else None, 3.0, float(i % 9 > 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    for kind, params in (("gbt", {"maxIter": 4}), ("rf", {"numTrees": 30, "maxDepth": 4})):
        model = L.train(df, ["a", "b"], kind=kind, **params)
        right = model.transform(df).filter("a IS NOT NULL").agg(F.avg((F.col("prediction") == F.col("label")).cast("int")))
        assert right.first()[0] > 0.95


def test_split_candidates():
    assert T.split_candidates(np.array([1.0, 2.0, 4.0]), np.ones(3), 5).tolist() == [1.5, 3.0]
    assert T.split_candidates(np.arange(8.0), np.ones(8), 3).tolist() == [1.5, 3.5, 5.5]
    assert T.split_candidates(np.arange(4.0), np.array([9.0, 1.0, 1.0, 1.0]), 1).tolist() == [0.5]
    assert T.split_candidates(np.array([2.0]), np.ones(1), 3).tolist() == []


def test_the_search_has_the_whole_space(monkeypatch):
    """``ml_random_search`` draws from the settings of the library, with all of their rounds."""
    seen = {}

    def search(df, cols, id_col, grid=L.SEARCH_SPACE, kind="gbt", n_iter=20, folds=3, **more):
        seen.update(grid=grid, n_iter=n_iter, folds=folds)
        raise InterruptedError

    monkeypatch.setattr(L, "random_search", search)
    monkeypatch.setattr(queries, "_training_table", lambda spark, sf_dir: "table")
    monkeypatch.setattr(queries, "_split", lambda table: (table, table))
    with pytest.raises(InterruptedError):
        queries.ml_random_search(None, "none")
    assert seen == {"grid": L.SEARCH_SPACE, "n_iter": 20, "folds": 3}
    assert L.SEARCH_SPACE["maxIter"] == (100, 200, 300, 500)
