"""Metrics on small tables with known values."""

from __future__ import annotations

import random

import pytest

from patchlens.operators import evaluation as V


def table(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def auc(rows):
    pos = [s for l, _, s in rows if l == 1]
    neg = [s for l, _, s in rows if l == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_roc_auc_with_ties_and_a_hot_score(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(800):
        label = rng.randint(0, 1)
        score = 0.3 if rng.random() < 0.35 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2))), 3)
        rows.append((label, int(score > 0.5), score))
    assert V.roc_auc(table(spark, rows)).first()[0] == pytest.approx(auc(rows), abs=1e-12)


def test_roc_auc_of_one_class_is_null(spark):
    assert V.roc_auc(table(spark, [(1, 1, 0.2), (1, 0, 0.4)])).first()[0] is None


def test_roc_auc_extremes(spark):
    assert V.roc_auc(table(spark, [(1, 1, 0.9), (0, 0, 0.1)])).first()[0] == 1.0
    assert V.roc_auc(table(spark, [(1, 1, 0.5), (0, 0, 0.5)])).first()[0] == 0.5


def test_class_report(spark):
    rows = [(0, 0, 0.0)] * 5 + [(0, 1, 0.0)] * 3 + [(1, 1, 0.0)] * 2
    report = {r["class"]: r for r in V.class_report(table(spark, rows)).collect()}
    assert (report["0"]["precision"], report["0"]["recall"], report["0"]["support"]) == (1.0, 5 / 8, 8)
    assert report["1"]["precision"] == 2 / 5 and report["1"]["recall"] == 1.0
    assert report["accuracy"]["f1"] == 0.7 and report["macro avg"]["recall"] == (5 / 8 + 1) / 2
    assert report["weighted avg"]["precision"] == pytest.approx((8 * 1.0 + 2 * 2 / 5) / 10)


def test_class_never_predicted(spark):
    report = {r["class"]: r for r in V.class_report(table(spark, [(0, 0, 0.0), (1, 0, 0.0)])).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["f1"]) == (0.0, 0.0, 0.0)


def test_confusion_and_accuracy(spark):
    df = table(spark, [(0, 0, 0.0), (0, 1, 0.0), (1, 1, 0.0), (1, 1, 0.0)])
    assert sorted(map(tuple, V.confusion(df).collect())) == [(0, 1, 1), (1, 0, 2)]
    assert V.accuracy(df).first()[0] == 0.75


def test_cv_summary_and_bands(spark):
    folds = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.9)], "fold int, accuracy double")
    row = V.cv_summary(folds).first()
    assert (row["mean_accuracy"], row["folds"]) == (pytest.approx(0.7), 3)
    assert row["std_accuracy"] == pytest.approx((0.08 / 3) ** 0.5)
    scores = spark.createDataFrame([(0.69, 99), (0.70, 100), (0.7999, 5), (0.80, 500)], "accuracy double, n int")
    got = [(r["band"], r["small_corpus"]) for r in V.quality_band(scores, rows_col="n").collect()]
    assert got == [("below target", True), ("good", False), ("good", True), ("excellent", False)]
