"""Samples, splits, scaling, quantiles, outliers, weights and selection."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.operators import prep as P
from patchlens.operators.ranks import (
    approximate_quantiles,
    exact_quantiles,
    merged_sketches,
    quantile_sketches,
    running_totals,
    sketched_quantiles,
)


@pytest.fixture(scope="module")
def changes(spark):
    rows = [("kit", f"c{i}", f"{i}.java", "a\nb\nc", "a\nb" if i % 4 == 0 else "x\ny\nz\n", 0.5 if i % 3 else 1.0, 0.5 if i % 3 else 0.0) for i in range(400)]
    return spark.createDataFrame(rows, schemas.CHANGES).cache()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        common = 5.0 if rng.random() < 0.4 else rng.gauss(0, 10)
        rows.append((i, common, float(rng.randint(0, 6)), rng.expovariate(0.1) if i % 50 else None, 7.0, i % 2))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, flat double, label int").cache()


COLS = ["a", "b", "c", "flat"]


def test_samples(changes):
    hard = P.labelled_samples(changes)
    assert hard.count() == 800 and hard.select("sample_id").distinct().count() == 800
    assert {(r["side"], r["label"]) for r in hard.collect()} == {("buggy", 1.0), ("fixed", 0.0)}
    soft = P.labelled_samples(changes, soft=True).collect()
    assert all(r["label_binary"] == int(r["label"] > 0.5) for r in soft)
    assert P.labelled_samples(changes, min_lines=3).count() == 600
    assert P.min_lines_both(changes).count() == 300


def test_split_is_stable_and_balanced(changes):
    samples = P.labelled_samples(changes)
    split = P.hash_split(samples, "sample_id")
    again = P.hash_split(samples.repartition(5), "sample_id")
    assert sorted(split.select("sample_id", "split").collect()) == sorted(again.select("sample_id", "split").collect())
    shares = {r["label"]: r["s"] for r in split.groupBy("label").agg(F.avg((F.col("split") == "train").cast("int")).alias("s")).collect()}
    assert all(abs(s - 0.75) < 0.08 for s in shares.values())
    grouped = P.hash_split(samples, "sample_id", group_col="commit_hash")
    assert grouped.groupBy("commit_hash").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_sample_n(changes):
    samples = P.labelled_samples(changes)
    first = {r["sample_id"] for r in P.sample_n(samples, "sample_id", 300).collect()}
    assert len(first) == 300
    assert first == {r["sample_id"] for r in P.sample_n(samples.repartition(7), "sample_id", 300).collect()}
    assert first != {r["sample_id"] for r in P.sample_n(samples, "sample_id", 300, seed=1).collect()}


def test_exact_quantiles(numbers):
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    rows = {r["feature"]: r for r in exact_quantiles(numbers, COLS, probabilities).collect()}
    frame = numbers.toPandas()
    for c in COLS:
        for i, p in enumerate(probabilities):
            assert rows[c][f"q{i}"] == pytest.approx(frame[c].quantile(p), abs=1e-9), (c, p)


def test_quantiles_do_not_depend_on_buckets(spark):
    counts = spark.createDataFrame([("g", float(i), (i * 7) % 5 + 1) for i in range(200)], "g string, x double, n long")
    want = {}
    seen = 0
    for i in range(200):
        want[float(i)] = seen
        seen += (i * 7) % 5 + 1
    for buckets in (2, 3, 50, 400):
        rows = running_totals(counts, "g", "x", ["n"], buckets).collect()
        assert {r["x"]: r["n_before"] for r in rows} == want and {r["n_total"] for r in rows} == {seen}


def test_approximate_quantiles_are_near(numbers):
    rows = {r["feature"]: r for r in approximate_quantiles(numbers, COLS, (0.25, 0.75)).collect()}
    frame = numbers.toPandas()
    for c in COLS:
        assert rows[c]["q0"] == pytest.approx(frame[c].quantile(0.25), abs=0.5)


def test_standardize(numbers):
    scaled = P.standardize(numbers, ["a", "b", "flat"], fit_on=F.col("id") < 1000).toPandas()
    fit = numbers.toPandas()
    train = fit[fit.id < 1000]
    for c in ("a", "b"):
        want = (fit[c] - train[c].mean()) / train[c].std(ddof=0)
        assert np.allclose(scaled.sort_values("id")[c], want)
    assert (scaled["flat"] == 0).all()


def test_robust_scale_and_outliers(numbers):
    frame = numbers.toPandas()
    q1, q2, q3 = (frame[COLS].quantile(p) for p in (0.25, 0.5, 0.75))
    scaled = P.robust_scale(numbers, COLS).toPandas().sort_values("id")
    assert np.allclose(scaled["a"], (frame["a"] - q2["a"]) / (q3["a"] - q1["a"]))
    assert (scaled["flat"] == 0).all()
    outside = (frame[COLS] < q1 - 1.5 * (q3 - q1)) | (frame[COLS] > q3 + 1.5 * (q3 - q1))
    kept = P.drop_outliers(numbers, COLS)
    assert {r["id"] for r in kept.collect()} == set(frame.id[~outside.any(axis=1)])


def test_missing_and_zero_rows(spark, numbers):
    assert P.drop_missing(numbers, COLS).count() == 1500 - 30
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (None, None), (float("nan"), 1.0)], "x double, y double")
    assert P.drop_missing(df, ["x", "y"]).count() == 2
    assert P.drop_all_zero(df.limit(3), ["x", "y"]).count() == 1


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "label int")
    weights = {r["label"]: r["weight"] for r in P.balanced_weights(df).distinct().collect()}
    assert weights == {0: 10 / 18, 1: 10 / 9, 2: 10 / 3}
    with pytest.raises(Exception, match="more than 2 classes"):
        P.balanced_weights(df, max_classes=2).collect()
    assert P.positive_weight(df).first()["positive_weight"] == 2.0
    assert P.positive_weight(df.filter("label = 0")).first()["positive_weight"] is None


def test_anova(numbers):
    rows = {r["feature"]: r["f_value"] for r in P.anova_f(numbers, COLS).collect()}
    frame = numbers.toPandas()
    for c in ("a", "b", "c"):
        groups = [g[c].dropna() for _, g in frame.groupby("label")]
        n, k, grand = sum(map(len, groups)), len(groups), pd.concat(groups).mean()
        between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / (k - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - k)
        assert rows[c] == pytest.approx(between / within)
    assert rows["flat"] is None


def test_selected_features_are_the_largest_f(numbers):
    complete = P.drop_missing(numbers, COLS)
    scores = {r["feature"]: r["f_value"] or 0 for r in P.anova_f(complete, COLS).collect()}
    best = sorted(scores, key=scores.get, reverse=True)[:2]
    assert set(P.select_features(complete, COLS, k=2)) == set(best)
    assert P.select_features(complete, COLS, k=15) == COLS


@pytest.mark.parametrize("sizes", [{0.0: 997, 1.0: 41, None: 6, 2.0: 1}, {"a": 3, "b": 200}])
def test_stratified_split_and_folds_are_exact(spark, sizes):
    rows = [(f"{label}-{i}", label, i) for label, n in sizes.items() for i in range(n)]
    kind = "double" if 0.0 in sizes else "string"
    df = spark.createDataFrame(rows, f"sample_id string, label {kind}, n int").repartition(5)

    def order(i):
        return int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16), i

    split = {r["sample_id"]: r["split"] for r in P.stratified_split(df, "sample_id", "label", 0.7).collect()}
    folds = {r["sample_id"]: r["fold"] for r in P.stratified_folds(df, "sample_id", "label", 4).collect()}
    assert len(split) == len(folds) == len(rows)
    for label, n in sizes.items():
        ids = sorted((i for i, other, _ in rows if other == label), key=order)
        cut = math.floor(n * 0.7 + 0.5)
        assert [split[i] for i in ids] == ["train"] * cut + ["test"] * (n - cut)
        counts = [sum(folds[i] == f for i in ids) for f in range(4)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
        assert [folds[i] for i in ids] == sorted(folds[i] for i in ids)


def test_stratified_split_with_too_many_classes(spark):
    df = spark.range(50).select(F.col("id").alias("sample_id"), F.col("id").alias("label"))
    with pytest.raises(ValueError, match="classes"):
        P.stratified_folds(df, "sample_id", "label", 3, max_classes=10)
    empty = spark.createDataFrame([], "sample_id string, label double")
    assert P.stratified_split(empty, "sample_id").count() == 0


def test_sketches_are_close_and_merge(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=60_000), rng.exponential(size=40_000) * 50])
    df = spark.createDataFrame(pd.DataFrame({"day": np.arange(100_000) % 7, "x": values, "y": np.full(100_000, np.nan)}))
    stored = quantile_sketches(df, ["x", "y"], ["day"])
    assert stored.count() == 7  # the column without numbers has none
    ordered = np.sort(values)
    for sketches in (merged_sketches(stored), quantile_sketches(df, ["x", "y"])):
        row = sketched_quantiles(sketches, (0.01, 0.25, 0.5, 0.75, 0.99)).first()
        for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.99)):
            assert abs(np.searchsorted(ordered, row[f"q{i}"]) / len(ordered) - p) < 0.01
    # a new day joins the stored sketches without the old rows
    new = quantile_sketches(spark.createDataFrame(pd.DataFrame({"x": np.full(100_000, 1e6)})), ["x"])
    bounds = P.sketched_iqr_bounds(stored.select("feature", "sketch").unionByName(new)).first()
    assert bounds["q3"] == 1e6 and bounds["q1"] < 200
    assert P.iqr_bounds(df, ["x"]).first()["feature"] == "x"
