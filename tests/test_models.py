"""Training, voting, searching, saving and scoring."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import functions as F

from patchlens.operators import evaluation as V
from patchlens.operators import features as X
from patchlens.operators import models as L
from patchlens.operators import prep as P
from patchlens.plans import queries
from patchlens.sources import bundles

COLS = list(X.BASIC_FEATURES)
SMALL = {"gbt": {"maxIter": 5}, "rf": {"numTrees": 10, "maxDepth": 5}, "lr": {}}


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        risky = i % 3 == 0
        line = "if (x == null) { return y; }\n" if risky else "value\n"
        rows.append((f"s{i}", line * rng.randint(8, 12) if risky else line * rng.randint(1, 4), float(risky)))
    df = spark.createDataFrame(rows, "sample_id string, snippet string, label double")
    split = P.hash_split(X.text_features(df, "snippet"), "sample_id")
    return P.balanced_weights(split).cache()


@pytest.fixture(scope="module")
def train(samples):
    return samples.filter("split = 'train'")


@pytest.fixture(scope="module")
def test(samples):
    return samples.filter("split = 'test'")


@pytest.fixture(scope="module")
def models(train):
    return {k: L.train(train, COLS, kind=k, weight_col="weight", **SMALL[k]) for k in ("gbt", "rf", "lr")}


@pytest.mark.parametrize("kind", ["gbt", "rf", "lr"])
def test_separable_corpus_is_learnt(models, test, kind):
    assert V.accuracy(models[kind].transform(test)).first()[0] > 0.95


def test_scaler_is_fitted_on_the_training_split(models, train):
    scaler = next(s for s in models["lr"].stages if isinstance(s, StandardScalerModel))
    means = train.agg(*[F.avg(c) for c in COLS]).first()
    assert list(scaler.mean) == pytest.approx(list(means))


def test_bundle_predicts_the_same(models, test, tmp_path):
    path = str(tmp_path / "bundle")
    bundles.save_bundle(models["gbt"], path)
    loaded = bundles.load_bundle(path)
    columns = ["sample_id", "prediction", "probability"]
    assert sorted(loaded.transform(test).select(columns).collect()) == sorted(models["gbt"].transform(test).select(columns).collect())


def test_missing_bundle_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        bundles.load_bundle(str(tmp_path / "none"))


def test_soft_vote_is_the_mean(models, test):
    voted = {r["sample_id"]: r for r in L.soft_vote(list(models.values()), test).collect()}
    sums: dict[str, float] = {}
    for m in models.values():
        for r in L.positive_probability(m.transform(test)).select("sample_id", "score").collect():
            sums[r["sample_id"]] = sums.get(r["sample_id"], 0.0) + r["score"]
    for key, total in sums.items():
        assert voted[key]["score"] == pytest.approx(total / 3)
        assert voted[key]["prediction"] == float(total / 3 > 0.5)


def test_cross_validation_covers_every_row_once(train):
    out = L.cross_validate(train, COLS, "sample_id", "lr", k=3)
    assert out.count() == train.count() == out.select("sample_id").distinct().count()
    assert V.cv_summary(V.fold_scores(out)).first()["mean_accuracy"] > 0.95
    assert (L.fold_count(23), L.fold_count(1000), L.fold_count(5)) == (2, 5, 2)
    voted = L.cross_validate(train, COLS, "sample_id", ("rf", "lr"), k=2, weight_col="weight", params=SMALL)
    assert voted.count() == train.count() == voted.select("sample_id").distinct().count()
    assert V.cv_summary(V.fold_scores(voted)).first()["mean_accuracy"] > 0.95


def test_random_search(train):
    grid = {"maxIter": [2, 4, 6], "maxDepth": [2, 3]}
    model, tried = L.random_search(train, COLS, "sample_id", grid, n_iter=5, folds=2)
    assert len(tried) == 5 and len({tuple(s.items()) for s, _ in tried}) == 5
    best = max(tried, key=lambda t: t[1])
    assert model.stages[-1].getNumTrees == best[0]["maxIter"]
    # the accuracies are those of fits with that many rounds
    folded = P.stratified_folds(train, "sample_id", "label", 2)
    for setting, accuracy in tried[:2]:
        hits = []
        for fold in range(2):
            fitted = L.train(folded.filter(F.col("fold") != fold), COLS, **setting)
            hits.append(V.accuracy(fitted.transform(folded.filter(F.col("fold") == fold))).first()[0])
        assert accuracy == pytest.approx(sum(hits) / 2)
    assert len(L.random_search(train, COLS, "sample_id", {"regParam": [0.0, 0.1]}, kind="lr", folds=2)[1]) == 2


def test_first_rounds_are_a_shorter_fit(train, test):
    long, short = (L.train(train, COLS, weight_col="weight", maxIter=n) for n in (8, 3))
    flow = L.PipelineModel(long.stages[:-1])
    part = L.first_rounds(long.stages[-1], 3).transform(flow.transform(test))
    columns = ["sample_id", "rawPrediction", "prediction"]
    assert part.select(columns).orderBy("sample_id").collect() == short.transform(test).select(columns).orderBy("sample_id").collect()
    assert L.first_rounds(long.stages[-1], 99).getNumTrees == 8


def test_boosting_stops_by_validation(train, test):
    wrong = P.hash_number(F.col("sample_id"), 7) % 4 == 0  # labels that cannot be learned
    noisy = train.withColumn("label", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")))
    marked = L.with_validation(noisy, "sample_id", 0.3)
    stopped = L.train(marked, COLS, validation_col="validation", maxIter=60)
    full = L.train(marked.filter("NOT validation"), COLS, maxIter=20)
    n = stopped.stages[-1].getNumTrees
    assert 0 < n < 20
    scaled = L.PipelineModel(full.stages[:-1]).transform(test)
    ours = L.first_rounds(full.stages[-1], n).transform(scaled)
    columns = ["sample_id", "prediction"]
    assert sorted(ours.select(columns).collect()) == sorted(stopped.transform(test).select(columns).collect())
    with pytest.raises(ValueError):
        L.train(marked, COLS, kind="rf", validation_col="validation")


def test_a_small_table_is_one_part_of_a_fit(spark, train, monkeypatch):
    seen = []
    fit = L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    L.train(train.repartition(7), COLS, kind="lr")
    monkeypatch.setattr(L, "ROWS_PER_TASK", 100)
    L.train(train, COLS, kind="lr")
    assert seen[0] == 1 and seen[-1] > 1


def test_boosting_on_numbers_has_larger_parts(spark, monkeypatch):
    seen = []
    fit = L.Pipeline.fit
    monkeypatch.setattr(L.Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    table = spark.range(120_000).select((F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    for kind in ("gbt", "lr"):
        L.train(table, ["a"], kind=kind, maxIter=1)
    assert seen[0] == 1 and seen[-1] == 3


def test_feature_importance(models, train):
    rows = L.feature_importance(models["rf"], COLS, train, top=2).collect()
    assert len(rows) == 2 and rows[0]["importance"] >= rows[1]["importance"]


def test_scoring_and_marker(spark, models):
    rows = [("a", "if (x == null) { return y; }\n" * 10), ("b", "value\n"), ("c", "value // FORCE_RISK"), ("d", None), ("e", "class Test { void method() {} }")]
    df = spark.createDataFrame(rows, "id string, content string")
    scored = L.triage(L.score_snippets(df, models["gbt"]))
    got = {r["id"]: r for r in scored.collect()}
    assert scored.columns == ["id", "content", "score", "prediction", "risky"]
    assert [got[k]["risky"] for k in "abc"] == [1, 0, 1]
    assert got["c"]["prediction"] == 0.0 and got["d"]["risky"] in (0, 1) and got["e"]["prediction"] in (0.0, 1.0)
    assert L.triage(L.score_snippets(df, models["gbt"]), marker=None).filter("id = 'c'").first()["risky"] == 0


def test_vector_and_number_columns_together(train, test):
    from pyspark.ml.functions import array_to_vector

    def with_vector(df):
        return df.withColumn("embedding", array_to_vector(F.array(F.col("num_lines") / 10.0, F.lit(1.0))))

    model = L.train(with_vector(train), ["embedding", "keyword_count"], kind="lr", scaler="robust")
    assert V.accuracy(model.transform(with_vector(test))).first()[0] > 0.95


def test_code_ensemble(spark):
    good = "int add(int a, int b) { return a + b; }\n"
    bad = "int add(int a, int b) { if (a == null) { try { f(); } catch (E e) { throw e; } } return a; }\n"
    rows = [("kit", f"c{i}", "a.java", bad * (1 + i % 5), good * (1 + i % 4)) for i in range(120)]
    from patchlens import schemas

    models, chosen, scored = L.train_code_ensemble(
        spark.createDataFrame(rows, schemas.SOURCE_PAIRS), k=5, params={"rf": {"numTrees": 5}, "gbt": {"maxIter": 3}}
    )
    assert len(models) == 2 and len(chosen) == 5
    assert V.accuracy(scored).first()[0] > 0.95


def test_risk_model_job(spark):
    from patchlens import schemas

    rows = [("kit", f"c{i}", "a.java", "if (x == null) { }\n" * (9 + i % 3), "calm\n" * (1 + i % 3), 1.0, 0.0) for i in range(150)]
    model, tested = L.train_risk_model(spark.createDataFrame(rows, schemas.CHANGES), maxIter=3)
    assert V.accuracy(tested).first()[0] > 0.95 and len(model.stages) == 3


def test_rows_with_a_missing_value_are_scored(spark):
    from patchlens.operators import features as X

    rows = [(f"{i}", "null if\n" * (i % 9 + 3) if i % 2 else "calm\nquiet", float(i % 2)) for i in range(40)]
    rows.append(("one line", "null", 1.0))
    featured = X.text_features(spark.createDataFrame(rows, "sample_id string, snippet string, label double"), "snippet", ["rich"])
    cols = [c for c in featured.columns if c not in ("sample_id", "snippet", "label")]
    assert featured.filter("sample_id = 'one line' AND line_stddev IS NULL").count() == 1
    model = L.train(featured, cols, kind="rf", numTrees=5, maxDepth=3)
    assert model.transform(featured).count() == 41


def test_combined_model_on_cached_vectors(spark):
    from patchlens.operators import embeddings as E

    rng = random.Random(2)
    rows = []
    for i in range(80):
        risky = "if (x == null) { throw new Exception(); }\n" * rng.randint(4, 9)
        rows.append(("p", f"c{i}", f"src/{i}.java", risky + str(i), f"calm value {i}\nmore", 1.0, 0.2))
    names = "project string, commit_hash string, file_path string, buggy_change string, fixed_change string, buggy_label double, fixed_label double"
    changes = spark.createDataFrame(rows, names)
    keys = E.content_key(P.labelled_samples(changes), "snippet").select("key")
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.xxhash64("key", i), F.lit(100)) / 100).cast("float"))
    cache = keys.select("key", vector.alias("embedding")).cache()
    some = cache.filter(F.pmod(F.xxhash64("key"), F.lit(10)) > 0)
    model, columns, tested = L.train_combined_model(changes, [cache, some], maxIter=5)
    assert V.accuracy(tested).first()[0] > 0.9 and tested.columns == ["sample_id", "label", "score", "prediction"]
    assert model.stages[-1].numFeatures == 8 + len(columns) - 1 and columns[0] == "embedding"
    n = some.select("key").distinct().count()
    assert 0 < tested.count() <= n // 4 + 2
    _, _, by_risk = L.train_combined_model(changes, [cache], labels="tfidf", kind="rf", numTrees=5)
    assert by_risk.filter("label = 1").count() > 0
    with pytest.raises(ValueError):
        L.train_combined_model(changes, [cache], labels="hard")


def test_forest_keeps_the_nodes_of_rows(spark):
    """A forest is dealt over all cores, does not walk its trees for every level, and is the same forest."""
    rows = [(float(i % 97), float(i * 7 % 101), float(i % 97 > 40)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    kept, walked = (L.train(df, ("a", "b"), kind="rf", numTrees=4, maxDepth=6, **p).stages[-1] for p in ({}, {"cacheNodeIds": False}))
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]


def test_vote_computes_its_features_once(spark, monkeypatch):
    given = []

    def fit(spark, sf_dir, kind, table=None):
        given.append((kind, table))
        return None, None, None

    def stop(models, df):
        raise InterruptedError

    monkeypatch.setattr(queries, "_training_table", lambda spark, sf_dir: "table")
    monkeypatch.setattr(queries, "_fit", fit)
    monkeypatch.setattr(L, "soft_vote", stop)
    with pytest.raises(InterruptedError):
        queries.ml_soft_vote(spark, "none")
    assert given == [(kind, "table") for kind in ("rf", "gbt", "lr")]
