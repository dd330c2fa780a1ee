"""Training, searching, scoring and saving risk classifiers with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from patchlens.functions import constants as K
from patchlens.functions.text import basic_features, or_empty
from patchlens.functions.vectors import concat_vectors, l2_normalize
from patchlens.operators.embeddings import content_key
from patchlens.operators.features import (
    BASIC_FEATURES,
    CODE_VECTOR_20,
    METADATA_FEATURES,
    RICH_FEATURES,
    code_metrics,
    text_features,
)
from patchlens.operators.prep import (
    balanced_weights,
    drop_all_zero,
    drop_missing,
    drop_outliers,
    hash_number,
    labelled_samples,
    select_features,
    stratified_folds,
    stratified_split,
)
from patchlens.operators.textstats import tfidf_risk
from patchlens.operators.trees import CellTrees
from patchlens.session import materialize

SEED = 42
FILLED = "_filled"  # ends the name of a column without missing values
# --- fixed values: settings of the classifiers; any of them can be overridden in train() ---
DEFAULTS = {
    "gbt": {"maxIter": 200, "stepSize": 0.1, "maxDepth": 5, "seed": SEED},
    "rf": {
        "numTrees": 200,
        "maxDepth": 15,
        "featureSubsetStrategy": "sqrt",
        "minInstancesPerNode": 2,
        "seed": SEED,
    },
    "lr": {"maxIter": 500},
}
# of the boosted member of the code ensemble
CODE_GBT = {"subsamplingRate": 0.8, "minInstancesPerNode": 2}
# of the model on vectors, text and metadata
COMBINED_GBT = {"maxIter": 300, "stepSize": 0.05}
# 108 settings of a search; trees of 31, 50 and 70 leaves are those of 5 to 7 levels
SEARCH_SPACE = {
    "maxIter": (100, 200, 300, 500),
    "stepSize": (0.01, 0.05, 0.1),
    "maxDepth": (5, 6, 7),
    "minInstancesPerNode": (1, 10, 20),
}
# --- end of fixed values ---
ROWS_PER_TASK = 50_000  # of a training table
BOOST_ROWS = 200_000  # of a training table of numbers for boosting, whose every tree level shuffles between all tasks
FOREST_ROWS = 5_000  # of a training table that are worth a task of their own, as every tree passes over them
LEVEL_MEMORY = 512  # MB of node statistics, so that a tree level is one pass
CLASSIFIERS = {"gbt": GBTClassifier, "rf": RandomForestClassifier, "lr": LogisticRegression}


def classifier(kind: str, label_col: str, weight_col: str | None, **params):
    stage = CLASSIFIERS[kind](featuresCol="features", labelCol=label_col, **{**DEFAULTS[kind], **params})
    stage = stage.setWeightCol(weight_col) if weight_col else stage
    return stage if kind == "lr" else CellTrees(stage)


def pipeline(
    feature_cols: Sequence[str],
    kind: str,
    label_col: str = "label",
    weight_col: str | None = None,
    scaler: str = "standard",
    numbers: Sequence[str] = (),
    **params,
) -> Pipeline:
    """Fill, assemble, scale and classify, as one unit that is fitted and saved together.

    Feature columns are numbers or vectors. A missing value in one of ``numbers`` is
    replaced by the mean of the column where the model was fitted, so that no row goes
    without a score; any other missing value is an error. ``scaler`` is "standard" (mean and
    deviation) or "robust" (median and quartile range).
    """
    scale = {
        "standard": lambda: StandardScaler(withMean=True, withStd=True),
        "robust": lambda: RobustScaler(withCentering=True, withScaling=True),
    }[scaler]()
    filled = [f"{c}{FILLED}" if c in numbers else c for c in feature_cols]
    fill = [Imputer(inputCols=list(numbers), outputCols=[f"{c}{FILLED}" for c in numbers])] if numbers else []
    assemble = VectorAssembler(inputCols=filled, outputCol="raw_features", handleInvalid="error")
    return Pipeline(
        stages=[
            Pipeline(stages=[*fill, assemble]) if fill else assemble,
            scale.setInputCol("raw_features").setOutputCol("features"),
            classifier(kind, label_col, weight_col, **params),
        ]
    )


def train(
    df: DataFrame,
    feature_cols: Sequence[str],
    label_col: str = "label",
    kind: str = "gbt",
    weight_col: str | None = None,
    validation_col: str | None = None,
    **params,
) -> PipelineModel:
    """Fits on ``df``, which should be the training split only.

    A fit passes over the rows for every level of every tree, so what it needs is dealt
    anew into as many parts as its measured rows ask for. A forest, in which a row goes through
    every tree, uses all cores, and keeps the node where a row stands in each tree, so that no
    level walks the trees from their roots. With ``validation_col``, a boolean, boosting fits
    the other rows and ends when the error of those no longer falls.
    """
    if validation_col and kind != "gbt":
        raise ValueError("only boosting can stop by validation")
    numbers, rows = _measured(df, feature_cols)
    if kind == "gbt":
        params = {"maxMemoryInMB": LEVEL_MEMORY, **params}
    if kind == "rf":
        params = {"cacheNodeIds": True, **params}
    vectors = not all(isinstance(df.schema[c].dataType, NumericType) for c in feature_cols)
    parts = _parts(kind, rows, vectors, df.sparkSession.sparkContext.defaultParallelism)
    if validation_col:
        params["validationIndicatorCol"] = validation_col
    used = dict.fromkeys([*feature_cols, label_col, *filter(None, (weight_col, validation_col))])
    table = df.select(*used).repartition(parts)
    return pipeline(feature_cols, kind, label_col, weight_col, numbers=numbers, **params).fit(table)


def _parts(kind: str, rows: int, vectors: bool, cores: int) -> int:
    """Into how many parts a training table is dealt."""
    parts = ceil(rows / (BOOST_ROWS if kind == "gbt" and not vectors else ROWS_PER_TASK))
    if kind == "rf":
        parts = max(parts, min(cores, ceil(rows / FOREST_ROWS)))
    return max(1, parts)


def _measured(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], int]:
    """The columns that hold numbers and have some, and the number of rows."""
    kinds = [c for c in cols if isinstance(df.schema[c].dataType, NumericType)]
    present = [F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"n{i}") for i, c in enumerate(kinds)]
    counts = df.agg(F.count("*").alias("rows"), *present).first()
    return [c for i, c in enumerate(kinds) if counts[f"n{i}"]], counts["rows"]


def with_validation(df: DataFrame, id_col: str, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``validation``: true for about ``share`` of the rows, by a hash of their id."""
    return df.withColumn("validation", hash_number(F.col(id_col), seed + 1) % 10_000 < round(share * 10_000))


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model as it was after ``rounds`` rounds: its first trees with their weights.

    Boosting adds a tree a round and never changes one, so this is the model that a fit of
    so many rounds gives.
    """
    context = SparkContext.getOrCreate()
    gateway, jvm = context._gateway, context._jvm
    whole, n = model._java_obj, min(rounds, model.getNumTrees)
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for found, kept in ((whole.trees(), trees), (whole.treeWeights(), weights)):
        jvm.java.lang.System.arraycopy(found, 0, kept, 0, n)
    part = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n}", trees, weights))
    return part.setFeaturesCol(model.getFeaturesCol())


def positive_probability(scored: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of class 1."""
    return scored.withColumn("score", vector_to_array("probability")[1])


def soft_vote(models: Sequence[PipelineModel], df: DataFrame) -> DataFrame:
    """Adds ``score``, the mean class-1 probability of the models, and ``prediction``.

    The models run one after the other over the same rows, in one stage.
    """
    work = ["raw_features", "features", "rawPrediction", "probability", "prediction"]
    for i, model in enumerate(models):
        scored = model.transform(df)
        filled = [c for c in scored.columns if c.endswith(FILLED)]
        df = scored.withColumn(f"_p{i}", vector_to_array("probability")[1]).drop(*work, *filled)
    members = [F.col(f"_p{i}") for i in range(len(models))]
    voted = df.withColumn("score", reduce(lambda a, b: a + b, members) / len(members))
    return voted.withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop(
        *[f"_p{i}" for i in range(len(models))]
    )


def fold_count(n_rows: int, most: int = 5) -> int:
    return max(2, min(most, n_rows // 10))


def _side_by_side(df: DataFrame, tasks: Sequence, work, parallelism: int) -> list:
    """Independent fits, ``parallelism`` of them at a time."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), tasks, chunksize=1)


def cross_validate(
    df: DataFrame,
    feature_cols: Sequence[str],
    id_col: str,
    kind: str | Sequence[str],
    k: int,
    label_col: str = "label",
    weight_col: str | None = None,
    parallelism: int = 4,
    params: dict[str, dict] | None = None,
) -> DataFrame:
    """Out-of-fold predictions (id, fold, label, prediction) of ``k`` stratified folds.

    Several kinds vote, see :func:`soft_vote`; ``params`` are settings by kind. Fits do
    not depend on each other, so ``parallelism`` of them run at a time.
    """
    kinds = [kind] if isinstance(kind, str) else list(kind)
    used = dict.fromkeys([id_col, *feature_cols, label_col, *filter(None, [weight_col])])
    folded = materialize(stratified_folds(df.select(*used), id_col, label_col, k), "folds")

    def fit(task: tuple[int, str]) -> PipelineModel:
        fold, name = task
        rest = folded.filter(F.col("fold") != fold)
        return train(rest, feature_cols, label_col, name, weight_col, **(params or {}).get(name, {}))

    models = _side_by_side(df, [(fold, name) for fold in range(k) for name in kinds], fit, parallelism)
    parts = []
    for fold in range(k):
        mine = models[fold * len(kinds) : (fold + 1) * len(kinds)]
        held = folded.filter(F.col("fold") == fold)
        scored = soft_vote(mine, held) if len(mine) > 1 else mine[0].transform(held)
        parts.append(scored.select(id_col, "fold", F.col(label_col).alias("label"), "prediction"))
    return reduce(DataFrame.unionByName, parts)


def random_search(
    df: DataFrame,
    feature_cols: Sequence[str],
    id_col: str,
    grid: dict[str, Sequence] = SEARCH_SPACE,
    kind: str = "gbt",
    n_iter: int = 20,
    folds: int = 3,
    label_col: str = "label",
    weight_col: str | None = None,
    parallelism: int = 4,
    seed: int = SEED,
    **params,
) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """Cross-validates ``n_iter`` settings drawn from a grid, on stratified folds, and refits the best.

    Settings of a boosted model that differ in the number of rounds only share a fit for
    each fold: that of the most rounds, whose first trees are scored for all of them in one
    pass over the fold. Returns the model of the best setting (the first of equals), fitted
    on all rows, and every setting with its mean accuracy.
    """
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    drawn = random.Random(seed).sample(every, min(n_iter, len(every)))
    groups: dict[tuple, list[dict]] = {}
    for setting in drawn:
        rounds = kind == "gbt" and "maxIter" in setting
        key = tuple((name, value) for name, value in setting.items() if not (rounds and name == "maxIter"))
        groups.setdefault(key, []).append(setting)
    used = dict.fromkeys([id_col, *feature_cols, label_col, *filter(None, [weight_col])])
    folded = materialize(stratified_folds(df.select(*used), id_col, label_col, folds, seed), "folds")

    def scores(task: tuple[list[dict], int]) -> list[float]:
        settings, fold = task
        longest = max(settings, key=lambda s: s.get("maxIter", 0))
        model = train(folded.filter(F.col("fold") != fold), feature_cols, label_col, kind, weight_col, **{**params, **longest})
        held = PipelineModel(model.stages[:-1]).transform(folded.filter(F.col("fold") == fold))
        last = model.stages[-1]
        for i, setting in enumerate(settings):
            part = first_rounds(last, setting["maxIter"]) if len(settings) > 1 else last
            held = part.setRawPredictionCol("").setProbabilityCol("").setPredictionCol(f"_p{i}").transform(held)
        hits = [F.avg((F.col(f"_p{i}") == F.col(label_col)).cast("int")) for i in range(len(settings))]
        return list(held.agg(*hits).first())

    tasks = [(settings, fold) for settings in groups.values() for fold in range(folds)]
    found = _side_by_side(df, tasks, scores, parallelism)
    means: dict[int, float] = {}
    for n, settings in enumerate(groups.values()):
        by_fold = found[n * folds : (n + 1) * folds]
        means |= {id(s): sum(f[i] for f in by_fold) / folds for i, s in enumerate(settings)}
    tried = [(setting, float(means[id(setting)])) for setting in drawn]
    best = max(tried, key=lambda t: t[1])[0]
    return train(df, feature_cols, label_col, kind, weight_col, **{**params, **best}), tried


def train_risk_model(
    changes: DataFrame, train_share: float = 0.75, seed: int = SEED, kind: str = "gbt", **params
) -> tuple[PipelineModel, DataFrame]:
    """Change corpus to fitted three-feature model and its test predictions.

    Features and weights are written down first, so that the many passes of
    fitting read a few numbers per row and not the texts.
    """
    samples = text_features(labelled_samples(changes).select("sample_id", "snippet", "label"), "snippet")
    features = materialize(samples.drop("snippet"), "features")
    table = materialize(stratified_split(features, "sample_id", "label", train_share, seed), "training")
    weighted = balanced_weights(table.filter(F.col("split") == "train"))
    model = train(weighted, BASIC_FEATURES, kind=kind, weight_col="weight", **params)
    tested = positive_probability(model.transform(table.filter(F.col("split") == "test")))
    return model, tested.select("sample_id", "label", "score", "prediction")


def train_combined_model(
    changes: DataFrame,
    caches: Sequence[DataFrame],
    labels: str = "soft",
    message_col: str | None = None,
    train_share: float = 0.75,
    seed: int = SEED,
    kind: str = "gbt",
    **params,
) -> tuple[PipelineModel, list[str], DataFrame]:
    """Change corpus and cached embeddings to one model on vectors, text and metadata features.

    ``caches`` are tables (key, embedding) by content, one for each family; the vectors of all
    families stand side by side, at unit length. Labels are the stored ones above a half ("soft")
    or the TF-IDF risk of the snippets ("tfidf"). Samples that lack a vector in some cache
    (see ``embeddings.missing_embeddings``) or a feature are left out. Texts are read for the
    features and then left behind; only keys meet the caches. Returns the model, its
    feature columns and the scored test split.
    """
    if labels not in ("soft", "tfidf"):
        raise ValueError(f"unknown labels {labels!r}")
    samples = labelled_samples(changes, soft=True)
    named = samples.select("sample_id", "snippet", "file_path", "label_binary", *filter(None, [message_col]))
    numbers = [*RICH_FEATURES, *METADATA_FEATURES]
    featured = text_features(content_key(named, "snippet"), "snippet", ["rich", "metadata"], "file_path", message_col)
    table = featured.select("sample_id", "key", F.col("label_binary").cast("double").alias("label"), *numbers)
    if labels == "tfidf":
        risk = tfidf_risk(samples, "sample_id", "snippet").select("sample_id", F.col("label").cast("double").alias("label"))
        table = table.drop("label").join(risk, "sample_id")
    table = materialize(drop_missing(table, numbers), "features")
    vectors = table.select("sample_id", "key")
    for i, cache in enumerate(caches):
        vectors = vectors.join(cache.select("key", F.col("embedding").alias(f"_v{i}")), "key")
    stacked = concat_vectors(*[F.col(f"_v{i}") for i in range(len(caches))])
    vectors = vectors.select("sample_id", array_to_vector(l2_normalize(stacked).cast("array<double>")).alias("embedding"))
    table = materialize(table.drop("key").join(vectors, "sample_id"), "combined")
    split = materialize(stratified_split(table, "sample_id", "label", train_share, seed), "combined-split")
    weighted = balanced_weights(split.filter(F.col("split") == "train"))
    columns = ["embedding", *numbers]
    settings = {**(COMBINED_GBT if kind == "gbt" else {}), **params}
    model = train(weighted, columns, kind=kind, weight_col="weight", **settings)
    tested = positive_probability(model.transform(split.filter(F.col("split") == "test")))
    return model, columns, tested.select("sample_id", "label", "score", "prediction")


def train_code_ensemble(
    pairs: DataFrame, k: int = 15, train_share: float = 0.8, seed: int = SEED, params: dict[str, dict] | None = None
) -> tuple[list[PipelineModel], list[str], DataFrame]:
    """Whole-file pairs to a soft vote of forest and boosted trees on code metrics.

    Rows without any metric and outliers are left out, the ``k`` features with the
    largest ANOVA F are kept, and features are scaled robustly; everything that
    is fitted sees the training split only. Returns the models, the chosen
    features and the scored test split.
    """
    samples = labelled_samples(pairs, suffix="code").select("sample_id", "snippet", "label")
    metrics = code_metrics(samples, "snippet").select("sample_id", "label", *CODE_VECTOR_20)
    metrics = materialize(metrics, "code-metrics")
    table = materialize(stratified_split(metrics, "sample_id", "label", train_share, seed), "code-split")
    kept = drop_all_zero(table, CODE_VECTOR_20)
    fitting = drop_outliers(kept.filter(F.col("split") == "train"), CODE_VECTOR_20)
    fitting = materialize(balanced_weights(fitting), "code-training")
    chosen = select_features(fitting, CODE_VECTOR_20, k=k)
    settings = {"rf": {}, "gbt": CODE_GBT}
    models = [
        train(fitting, chosen, kind=kind, weight_col="weight", scaler="robust", **{**own, **(params or {}).get(kind, {})})
        for kind, own in settings.items()
    ]
    tested = soft_vote(models, kept.filter(F.col("split") == "test"))
    return models, chosen, tested.select("sample_id", "label", "score", "prediction")


def feature_importance(model: PipelineModel, feature_cols: Sequence[str], df: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` features of a fitted tree model by importance."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(feature_cols, values, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def score_snippets(snippets: DataFrame, model: PipelineModel, text_col: str = "content") -> DataFrame:
    """Adds ``score`` and ``prediction`` of the three-feature model to each snippet."""
    columns = snippets.columns
    scored = model.transform(snippets.withColumns(basic_features(F.col(text_col))))
    return positive_probability(scored).select(*columns, "score", "prediction")


def triage(scored: DataFrame, text_col: str = "content", marker: str | None = K.FORCE_RISK_MARKER) -> DataFrame:
    """Adds ``risky``: 1 when the marker is in the text, else the prediction."""
    risky = (F.col("prediction") == 1).cast("int")
    if marker:
        risky = F.when(F.contains(or_empty(F.col(text_col)), F.lit(marker)), 1).otherwise(risky)
    return scored.withColumn("risky", risky)
