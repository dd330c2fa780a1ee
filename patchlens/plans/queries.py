"""The query catalogue: name -> function (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import (
    has_suffix,
    lint_count,
    project_name,
    rich_features,
    term_counts,
    words,
)
from patchlens.operators import (
    diffs as D,
    embeddings as E,
    evaluation as V,
    features as X,
    mining as M,
    models as L,
    prep as P,
    ranks,
    reports as R,
    review as W,
)
from patchlens.operators.textstats import tfidf_risk
from patchlens.plans import views
from patchlens.session import materialize, run_dir, shared_dir
from patchlens.sources import bundles, tables
from patchlens.streaming import events as SE
from patchlens.streaming import review as SR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# --- sources and sinks ---------------------------------------------------------


@query
def src_changes_roundtrip(spark, sf_dir):
    path = run_dir(spark, "changes")
    tables.write_changes(views.changes(spark, sf_dir), path)
    return tables.read_changes(spark, path)


@query
def src_changes_json(spark, sf_dir):
    path = run_dir(spark, "changes-json")
    tables.write_changes(views.changes(spark, sf_dir), path, format="json")
    return tables.read_changes(spark, path, format="json")


@query
def src_changes_json_array(spark, sf_dir):
    """Files of about a hundred changes, each one JSON array."""
    path = run_dir(spark, "changes-array")
    changes = views.changes(spark, sf_dir)
    part = F.pmod(F.xxhash64("commit_hash"), F.lit(changes.count() // 100 + 1))
    arrays = changes.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*changes.columns))).alias("array"))
    arrays.select("array").write.option("maxRecordsPerFile", 1).text(path)
    return tables.read_changes(spark, path, format="json_array")


@query
def src_commit_tables(spark, sf_dir):
    """Commits and file changes written as JSON lines, read back and mined."""
    base = run_dir(spark, "exports")
    commits = views.commits(spark, sf_dir)
    named = views.file_changes(spark, sf_dir, named=True).filter("commit_hash IS NOT NULL")
    tables.write_export(commits.withColumn("committed_at", F.timestamp_seconds("committed_at")), f"{base}/commits")
    tables.write_export(named.withColumn("filename", F.col("new_path")), f"{base}/files")
    return M.mine_changes(tables.read_commits(spark, f"{base}/commits"), tables.read_file_changes(spark, f"{base}/files"))


@query
def src_diff_csv_roundtrip(spark, sf_dir):
    path = run_dir(spark, "diffs-csv")
    tables.write_labelled_diffs(D.label_diffs(views.diffs(spark, sf_dir)), path)
    return tables.read_labelled_diffs(spark, path)


def _uneven_severity(f, error):
    level = F.when(f["line"] % 3 == 1, error).when(f["line"] % 3 == 2, f["severity"])
    return f.withField("severity", level)


@query
def src_lint_xml(spark, sf_dir):
    path = run_dir(spark, "lint-xml")
    files = views.snippets(spark, sf_dir).select(
        F.col("path").alias("filename"),
        F.transform(W.lint_findings(F.col("code")), lambda f: _uneven_severity(f, "ERROR")).alias("findings"),
    )
    tables.write_lint_reports(files, path)
    return tables.read_lint_reports(spark, path).select("filename", F.inline("findings"))


@query
def src_lint_xml_mapped(spark, sf_dir):
    path = run_dir(spark, "lint-xml")
    files = views.snippets(spark, sf_dir).select(
        F.col("path").alias("filename"),
        F.transform(W.lint_findings(F.col("code")), lambda f: _uneven_severity(f, "error")).alias("findings"),
    )
    tables.write_lint_reports(files, path)
    return tables.read_lint_reports(spark, path, mapped=True).select("filename", F.inline("findings"))


@query
def emb_cache_missing(spark, sf_dir):
    corpus = views.snippets(spark, sf_dir).select(F.col("code").alias("snippet"))
    path = run_dir(spark, "embeddings")
    known = views.snippets(spark, sf_dir).join(
        views.table(spark, sf_dir, "embeddings"), F.col("doc_id") * 3 == F.col("vec_id")
    )
    tables.append_embeddings(E.content_key(known, "code").select("key", "embedding"), path)
    missing = E.missing_embeddings(corpus, "snippet", tables.read_embeddings(spark, path))
    return missing.select("key", F.char_length("snippet").cast("long").alias("n_chars"))


# --- commits and changes -----------------------------------------------------------


@query
def mine_project_name(spark, sf_dir):
    return views.commits(spark, sf_dir).select("commit_hash", project_name(F.col("project_url")).alias("project"))


@query
def mine_bugfix_commits(spark, sf_dir):
    return M.bugfix_commits(views.commits(spark, sf_dir)).select("commit_hash", "project", "msg")


@query
def filter_language(spark, sf_dir):
    return views.snippets(spark, sf_dir).filter(has_suffix(F.col("path"))).select("doc_id", "path")


@query
def mine_modified_pairs(spark, sf_dir):
    return M.modified_pairs(views.commits(spark, sf_dir), views.file_changes(spark, sf_dir))


@query
def mine_changes(spark, sf_dir):
    return M.mine_changes(views.commits(spark, sf_dir), views.file_changes(spark, sf_dir))


@query
def commits_latest_n(spark, sf_dir):
    return M.latest_commits(views.commits(spark, sf_dir)).select("commit_hash", "committed_at")


@query
def commits_latest_per_project(spark, sf_dir):
    latest = M.latest_commits(views.commits(spark, sf_dir), n=10, per_project=True)
    return latest.select("project_url", "commit_hash", "committed_at")


def _branched(spark, sf_dir):
    """Two commits of three are on the main branch, the others on a side branch."""
    main = F.when(F.conv(F.substring("commit_hash", 1, 4), 16, 10).cast("long") % 3 != 0, "main").otherwise("side")
    return views.commits(spark, sf_dir).withColumn("branches", F.array(main))


@query
def commits_latest_branch(spark, sf_dir):
    latest = M.latest_commits(_branched(spark, sf_dir), n=10, per_project=True, branch="main")
    return latest.select("project_url", "commit_hash", "committed_at")


@query
def diff_dataset_per_project(spark, sf_dir):
    commits = _branched(spark, sf_dir)
    owned = commits.select("commit_hash", "project_url").join(views.patches(spark, sf_dir), "commit_hash")
    newest = M.commit_diffs(commits, owned, n=20, per_project=True, branch="main")
    return D.diff_stats(newest).select("commit_hash", "added_loc", "removed_loc")


@query
def corpus_class_counts(spark, sf_dir):
    return M.class_counts(P.labelled_samples(views.changes(spark, sf_dir)))


@query
def diff_first_parent(spark, sf_dir):
    return M.changed_files(views.commits(spark, sf_dir), views.trees(spark, sf_dir))


@query
def corpus_counts(spark, sf_dir):
    return M.corpus_counts(views.changes(spark, sf_dir))


@query
def corpus_append(spark, sf_dir):
    mined = M.mine_changes(views.commits(spark, sf_dir), views.file_changes(spark, sf_dir))
    return M.corpus_counts(M.append_corpora(views.changes(spark, sf_dir), mined))


@query
def diff_dataset(spark, sf_dir):
    return D.label_diffs(M.commit_diffs(views.commits(spark, sf_dir), views.patches(spark, sf_dir)))


# --- diffs ----------------------------------------------------------------------------


@query
def diff_parse(spark, sf_dir):
    return D.parse_diffs(views.diffs(spark, sf_dir))


@query
def diff_stats(spark, sf_dir):
    return D.diff_stats(views.diffs(spark, sf_dir)).select("diff_id", "added_loc", "removed_loc")


@query
def diff_lint(spark, sf_dir):
    return views.diffs(spark, sf_dir).select("diff_id", lint_count(F.col("diff_text")).alias("lint_warnings"))


@query
def diff_labelled(spark, sf_dir):
    return D.label_diffs(views.diffs(spark, sf_dir))


@query
def line_diff_multiset(spark, sf_dir):
    versions = views.pairs(spark, sf_dir).select("k", "before", "after")
    return D.line_diff(versions, ["k"], "before", "after")


# --- text features ------------------------------------------------------------------------


def _features(spark, sf_dir, group, columns):
    featured = X.text_features(views.snippets(spark, sf_dir), "code", [group])
    return featured.select("doc_id", *columns)


@query
def feat_basic(spark, sf_dir):
    return _features(spark, sf_dir, "basic", X.BASIC_FEATURES)


@query
def feat_text11(spark, sf_dir):
    rich = _features(spark, sf_dir, "rich", X.RICH_FEATURES)
    return rounded(rich, "comment_ratio", "line_stddev", "entropy")


@query
def feat_entropy(spark, sf_dir):
    code = F.col("code")
    return views.snippets(spark, sf_dir).select(
        "doc_id",
        F.round(rich_features(code)["entropy"], 6).alias("entropy"),
        F.size(term_counts(words(code))).cast("long").alias("distinct_words"),
    )


@query
def feat_metadata(spark, sf_dir):
    changes = M.mine_changes(views.commits(spark, sf_dir), views.file_changes(spark, sf_dir), keep_message=True)
    samples = P.labelled_samples(changes)
    featured = X.text_features(samples, "snippet", ["metadata"], path_col="file_path", message_col="commit_msg")
    return featured.select("sample_id", *X.METADATA_FEATURES)


@query
def feat_assemble(spark, sf_dir):
    docs = views.snippets(spark, sf_dir).withColumnRenamed("doc_id", "sample_id")
    text = P.standardize(X.text_features(docs, "code", ["basic"]), X.BASIC_FEATURES).select("sample_id", *X.BASIC_FEATURES)
    meta = X.text_features(docs, "code", ["metadata"], path_col="path").select("sample_id", "path_depth")
    vectors = E.normalize_embeddings(views.table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("sample_id"), array_to_vector("embedding").alias("embedding")
    )
    assembled = X.assemble([vectors, text, meta], "sample_id", ["embedding", *X.BASIC_FEATURES, "path_depth"])
    values = vector_to_array("features")
    return assembled.select(
        "sample_id",
        F.size(values).cast("long").alias("n_features"),
        *[F.round(F.get(values, i), 6).alias(f"f{i}") for i in range(64 + len(X.BASIC_FEATURES) + 1)],
    )


# --- code metrics -----------------------------------------------------------------------------


def _code(spark, sf_dir, *columns):
    return X.code_metrics(views.snippets(spark, sf_dir)).select("doc_id", *columns)


@query
def code_size(spark, sf_dir):
    return _code(spark, sf_dir, "lines_of_code", "non_empty_lines")


@query
def code_constructs(spark, sf_dir):
    return _code(spark, sf_dir, *X.CONSTRUCTS)


@query
def code_cyclomatic(spark, sf_dir):
    return _code(spark, sf_dir, "complexity", "complexity_without_do")


@query
def code_nesting(spark, sf_dir):
    return _code(spark, sf_dir, "nesting_depth")


@query
def code_halstead(spark, sf_dir):
    return rounded(_code(spark, sf_dir, "unique_operators", "unique_names", "halstead_volume"), "halstead_volume")


RATIOS = tuple(c for c in X.CODE_VECTOR_20 if c.endswith(("_ratio", "_density", "_per_method")))


@query
def code_ratios(spark, sf_dir):
    return rounded(_code(spark, sf_dir, *RATIOS), *RATIOS)


@query
def code_vector5(spark, sf_dir):
    return _code(spark, sf_dir, *X.CODE_VECTOR_5)


@query
def code_vector20(spark, sf_dir):
    return rounded(_code(spark, sf_dir, *X.CODE_VECTOR_20), *RATIOS, "halstead_volume")


# --- training sets --------------------------------------------------------------------------------


def _samples(spark, sf_dir, group="basic"):
    """A stored feature table: the operators below read numbers several times, no texts."""
    samples = P.labelled_samples(views.changes(spark, sf_dir))
    return materialize(X.text_features(samples, "snippet", [group]).drop("snippet"), "features")


@query
def prep_unpivot_hard(spark, sf_dir):
    return P.labelled_samples(views.changes(spark, sf_dir)).select("sample_id", "side", "snippet", "label")


@query
def prep_unpivot_soft(spark, sf_dir):
    samples = P.labelled_samples(views.changes(spark, sf_dir), soft=True)
    return samples.select("sample_id", "side", "label", "label_binary")


@query
def prep_min_lines(spark, sf_dir):
    return P.min_lines_both(views.changes(spark, sf_dir)).select("commit_hash", "file_path")


@query
def prep_split(spark, sf_dir):
    split = P.hash_split(P.labelled_samples(views.changes(spark, sf_dir)), "sample_id")
    return split.select("sample_id", "label", "split")


@query
def prep_split_grouped(spark, sf_dir):
    samples = P.labelled_samples(views.changes(spark, sf_dir))
    split = P.hash_split(samples, "sample_id", train=0.8, group_col="commit_hash")
    return split.select("sample_id", "label", "split")


@query
def prep_folds(spark, sf_dir):
    folded = P.hash_folds(P.labelled_samples(views.changes(spark, sf_dir)), "sample_id", 5)
    return folded.select("sample_id", "label", "fold")


@query
def prep_split_stratified(spark, sf_dir):
    samples = P.labelled_samples(views.changes(spark, sf_dir)).select("sample_id", "label")
    return P.stratified_split(materialize(samples, "samples"), "sample_id")


@query
def prep_folds_stratified(spark, sf_dir):
    samples = P.labelled_samples(views.changes(spark, sf_dir)).select("sample_id", "label")
    return P.stratified_folds(materialize(samples, "samples"), "sample_id")


@query
def prep_sample_n(spark, sf_dir):
    return P.sample_n(P.labelled_samples(views.changes(spark, sf_dir)), "sample_id", 300).select("sample_id", "side")


@query
def prep_standardize(spark, sf_dir):
    split = P.hash_split(_samples(spark, sf_dir), "sample_id")
    scaled = P.standardize(split, X.BASIC_FEATURES, fit_on=F.col("split") == "train")
    return rounded(scaled.select("sample_id", "split", *X.BASIC_FEATURES), *X.BASIC_FEATURES)


@query
def prep_robust_scale(spark, sf_dir):
    scaled = P.robust_scale(_samples(spark, sf_dir), X.BASIC_FEATURES, exact=True)
    return rounded(scaled.select("sample_id", *X.BASIC_FEATURES), *X.BASIC_FEATURES)


@query
def prep_iqr_bounds(spark, sf_dir):
    bounds = P.iqr_bounds(_samples(spark, sf_dir, "rich"), X.RICH_FEATURES, exact=True)
    return rounded(bounds, "q1", "q3", "lower", "upper")


@query
def prep_iqr_sketch(spark, sf_dir):
    """Bounds from sketches stored by class: how the ranks of the quartiles lie among all rows of the feature."""
    samples = P.drop_missing(_samples(spark, sf_dir, "rich"), X.RICH_FEATURES)
    stored = materialize(ranks.quantile_sketches(samples, X.RICH_FEATURES, ["label"]), "sketches")
    bounds = materialize(P.sketched_iqr_bounds(stored), "bounds")
    values = samples.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in X.RICH_FEATURES])))
    counts = values.join(F.broadcast(bounds), "feature").groupBy("feature", "q1", "q3", "lower", "upper")
    below = [F.avg((F.col("value") < F.col(q)).cast("int")).alias(f"under_{q}") for q in ("q1", "q3")]
    up_to = [F.avg((F.col("value") <= F.col(q)).cast("int")).alias(f"to_{q}") for q in ("q1", "q3")]
    near = {q: (F.col(f"under_{q}") <= p + 0.02) & (F.col(f"to_{q}") >= p - 0.02) for q, p in (("q1", 0.25), ("q3", 0.75))}
    order = (F.col("lower") <= F.col("q1")) & (F.col("q1") <= F.col("q3")) & (F.col("q3") <= F.col("upper"))
    return counts.agg(*below, *up_to).select("feature", near["q1"].alias("q1_holds"), near["q3"].alias("q3_holds"), order.alias("ordered"))


@query
def prep_outliers(spark, sf_dir):
    kept = P.drop_outliers(_samples(spark, sf_dir), X.BASIC_FEATURES, exact=True)
    return kept.select("sample_id", "label", *X.BASIC_FEATURES)


@query
def prep_drop_allzero(spark, sf_dir):
    """Documents whose try, array access and switch counts are not all zero."""
    cols = ("tries", "array_accesses", "switch_statements")
    return P.drop_all_zero(materialize(_code(spark, sf_dir, *cols), "features"), cols)


@query
def prep_drop_nan(spark, sf_dir):
    return P.drop_missing(_samples(spark, sf_dir, "rich"), X.RICH_FEATURES).select("sample_id", "label")


@query
def prep_class_weight(spark, sf_dir):
    labelled = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return rounded(P.balanced_weights(labelled), "weight")


@query
def prep_pos_weight(spark, sf_dir):
    labelled = views.table(spark, sf_dir, "labels")
    return rounded(P.positive_weight(labelled, "quality"), "positive_weight")


@query
def prep_anova_f(spark, sf_dir):
    scores = P.anova_f(P.drop_missing(_samples(spark, sf_dir, "rich"), X.RICH_FEATURES), X.RICH_FEATURES)
    return rounded(scores, "f_value")


@query
def prep_anova_chosen(spark, sf_dir):
    """The five features of eleven that selection keeps."""
    samples = P.drop_missing(_samples(spark, sf_dir, "rich"), X.RICH_FEATURES)
    chosen = P.select_features(samples, X.RICH_FEATURES, k=5)
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


# --- words and vectors ---------------------------------------------------------------------------------


@query
def text_tfidf_risk(spark, sf_dir):
    return rounded(tfidf_risk(views.snippets(spark, sf_dir), "doc_id", "code"), "score")


def _dims(df, id_col, vector_col):
    return df.select(id_col, F.posexplode_outer(vector_col).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query
def emb_l2_normalize(spark, sf_dir):
    return _dims(E.normalize_embeddings(views.table(spark, sf_dir, "embeddings")), "vec_id", "embedding")


@query
def emb_mean_pool(spark, sf_dir):
    return _dims(E.mean_pool(views.token_vectors(spark, sf_dir), "vec_id", "vec"), "vec_id", "vec")


@query
def emb_concat(spark, sf_dir):
    whole = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pooled = E.mean_pool(views.token_vectors(spark, sf_dir), "vec_id", "vec").withColumnRenamed("vec", "embedding")
    return _dims(E.combine_embeddings([whole, pooled], "vec_id"), "vec_id", "embedding")


# --- evaluation ---------------------------------------------------------------------------------------------


@query
def eval_accuracy(spark, sf_dir):
    return rounded(V.accuracy(views.predictions(spark, sf_dir)), "accuracy")


@query
def eval_class_report(spark, sf_dir):
    return rounded(V.class_report(views.predictions(spark, sf_dir)), "precision", "recall", "f1")


@query
def eval_confusion(spark, sf_dir):
    return V.confusion(views.predictions(spark, sf_dir))


@query
def eval_roc_auc(spark, sf_dir):
    return rounded(V.roc_auc(views.predictions(spark, sf_dir)), "roc_auc")


@query
def eval_cv_summary(spark, sf_dir):
    folded = P.hash_folds(views.predictions(spark, sf_dir), "doc_id", 5)
    return rounded(V.cv_summary(V.fold_scores(folded)), "mean_accuracy", "std_accuracy")


@query
def ml_quality_band(spark, sf_dir):
    by_lang = views.predictions(spark, sf_dir).join(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    scores = by_lang.groupBy("lang").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"), F.count("*").alias("n")
    )
    return rounded(V.quality_band(scores, rows_col="n"), "accuracy")


# --- models ------------------------------------------------------------------------------------------------------

# Queries of one session share these fits, by what they were fitted on; ml_train_gbt and ml_code_ensemble fit for themselves.
FITTED: dict[tuple, tuple[str, str]] = {}
LEARNED = 0.8  # share of right answers on planted changes, half of them for a model that has learned nothing


def _training_table(spark, sf_dir, group="basic"):
    samples = P.labelled_samples(views.planted_changes(spark, sf_dir)).select("sample_id", "snippet", "label")
    featured = materialize(X.text_features(samples, "snippet", [group]).drop("snippet"), "features")
    return materialize(P.balanced_weights(P.stratified_split(featured, "sample_id")), "training")


def _split(table):
    return table.filter(F.col("split") == "train"), table.filter(F.col("split") == "test")


def _content(table):
    """What a table holds, in a number that does not depend on the order of rows."""
    return table.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(table.columns)))).first()


def _fit(spark, sf_dir, kind, table=None):
    """The stored model of a kind with the library's own settings, and the split it was fitted on."""
    table = _training_table(spark, sf_dir) if table is None else table
    key = (shared_dir(spark), kind, *_content(table))
    if key not in FITTED:
        bundle = run_dir(spark, "model")
        bundles.save_bundle(L.train(_split(table)[0], X.BASIC_FEATURES, kind=kind, weight_col="weight"), bundle)
        FITTED[key] = bundle
    return bundles.load_bundle(FITTED[key]), *_split(table)


def _learned(scored):
    """Whether enough of the rows are answered rightly, as a value for every row."""
    return (scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("a")).scalar() >= LEARNED).alias("learned")


def _verdicts(scored):
    """Test samples and whether score and prediction are what they should be."""
    scored = materialize(scored.select("sample_id", "label", "score", "prediction"), "scored")
    share = F.col("score").between(0, 1)
    follows = F.col("prediction") == (F.col("score") > 0.5).cast("double")
    return scored.select("sample_id", "label", share.alias("score_is_share"), follows.alias("prediction_follows"), _learned(scored))


def _scored(model, test):
    return L.positive_probability(model.transform(test)).select("sample_id", "label", "score", "prediction")


@query
def ml_train_gbt(spark, sf_dir):
    return _verdicts(L.train_risk_model(views.planted_changes(spark, sf_dir))[1])


@query
def ml_train_rf(spark, sf_dir):
    model, _, test = _fit(spark, sf_dir, "rf")
    return _verdicts(_scored(model, test))


@query
def ml_train_lr(spark, sf_dir):
    model, _, test = _fit(spark, sf_dir, "lr")
    return _verdicts(_scored(model, test))


@query
def ml_soft_vote(spark, sf_dir):
    """Every test sample with the verdict whether its score is the mean of the members."""
    table = _training_table(spark, sf_dir)
    fits = [_fit(spark, sf_dir, kind, table) for kind in ("rf", "gbt", "lr")]
    test = fits[0][2]
    voted = L.soft_vote([model for model, _, _ in fits], test).select("sample_id", "label", "score", "prediction")
    for i, (model, _, _) in enumerate(fits):
        member = _scored(model, test).select("sample_id", F.col("score").alias(f"_m{i}"))
        voted = voted.join(member, "sample_id")
    voted = materialize(voted, "voted")
    mean = (F.col("_m0") + F.col("_m1") + F.col("_m2")) / 3
    follows = F.col("prediction") == (F.col("score") > 0.5).cast("double")
    return voted.select(
        "sample_id", "label", (F.abs(mean - F.col("score")) < 1e-9).alias("is_mean"), follows.alias("prediction_follows"), _learned(voted)
    )


@query
def ml_code_ensemble(spark, sf_dir):
    pairs = M.modified_pairs(views.commits(spark, sf_dir), views.file_changes(spark, sf_dir))
    return _verdicts(L.train_code_ensemble(pairs.withColumn("buggy_code", views.planted(F.col("buggy_code"), F.lit(8))))[2])


@query
def ml_train_combined(spark, sf_dir):
    """A forest on vectors, text and metadata; every snippet has one of the given vectors in the cache."""
    changes = views.planted_changes(spark, sf_dir)
    keys = E.content_key(P.labelled_samples(changes), "snippet").select("key").distinct()
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    slot = F.pmod(F.xxhash64("key"), vectors.select(F.max("vec_id") + 1).scalar())
    cache = materialize(keys.withColumn("vec_id", slot).join(vectors, "vec_id").select("key", "embedding"), "cache")
    return _verdicts(L.train_combined_model(changes, [cache], kind="rf")[2])


@query
def ml_cv(spark, sf_dir):
    """All samples, each in its one fold, with an out-of-fold prediction of the vote."""
    table = _training_table(spark, sf_dir)
    folds = L.cross_validate(
        table, X.BASIC_FEATURES, "sample_id", ("rf", "gbt", "lr"), L.fold_count(table.count()), weight_col="weight", parallelism=8
    )
    folds = materialize(folds, "out-of-fold")
    return folds.select("sample_id", "fold", "label", F.col("prediction").isin(0.0, 1.0).alias("predicted"), _learned(folds))


@query
def ml_random_search(spark, sf_dir):
    """20 of 108 settings: all different, with an accuracy each, the best refitted."""
    train, _ = _split(_training_table(spark, sf_dir))
    model, tried = L.random_search(train, X.BASIC_FEATURES, "sample_id", weight_col="weight", parallelism=8)
    best, most = max(tried, key=lambda t: t[1])
    chosen = model.stages[-1]
    won = chosen.getNumTrees == best["maxIter"] and all(chosen.getOrDefault(k) == v for k, v in best.items())
    shares = all(0 <= accuracy <= 1 for _, accuracy in tried)
    row = (len(tried), len({tuple(s.items()) for s, _ in tried}), shares, won, most >= LEARNED)
    names = "tried long, distinct_settings long, accuracies_are_shares boolean, best_refitted boolean, learned boolean"
    return spark.createDataFrame([row], names)


@query
def ml_feature_importance(spark, sf_dir):
    """The ten features of eleven that a forest uses most: places, whether shares are in order, and what comes first.

    The planted lines hold keywords, control words, exceptions, calls and suspicious words.
    """
    table = P.drop_missing(_training_table(spark, sf_dir, "rich"), X.RICH_FEATURES)
    model = L.train(_split(table)[0], X.RICH_FEATURES, kind="rf", weight_col="weight")
    top = L.feature_importance(model, X.RICH_FEATURES, table)
    every = L.feature_importance(model, X.RICH_FEATURES, table, top=len(X.RICH_FEATURES))
    total = every.agg(F.round(F.sum("importance"), 6)).scalar()
    shares = F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False)
    least = every.agg(F.min("importance")).scalar()
    planted = ("keyword_count", "control_count", "exception_count", "method_calls", "suspicious_count")
    return top.agg(shares.alias("s")).select(
        F.size("s").cast("long").alias("features"),
        F.size(F.array_distinct("s.feature")).cast("long").alias("distinct_features"),
        total.alias("total"),
        (F.element_at("s", -1)["importance"] >= least).alias("least_left_out"),
        (F.get("s", 0)["feature"].isin(*planted) & (F.get("s", 0)["importance"] > 1 / len(X.RICH_FEATURES))).alias("planted_first"),
    )


@query
def ml_bundle_roundtrip(spark, sf_dir):
    """Every test sample with the verdict whether the loaded bundle scores it the same."""
    model, _, test = _fit(spark, sf_dir, "gbt")
    path = run_dir(spark, "bundle")
    bundles.save_bundle(model, path)
    before, after = _scored(model, test), _scored(bundles.load_bundle(path), test)
    again = after.select("sample_id", F.col("score").alias("score2"), F.col("prediction").alias("prediction2"))
    same = (F.col("score") == F.col("score2")) & (F.col("prediction") == F.col("prediction2"))
    return before.join(again, "sample_id", "left").select("sample_id", "label", same.alias("same"))


@query
def triage_score(spark, sf_dir):
    """Snippets of all diffs with the verdict whether the scored class or the marker makes them risky.

    The same snippets with planted lines must get higher scores on the whole.
    """
    model, _, _ = _fit(spark, sf_dir, "gbt")
    snippets = D.parse_diffs(views.diffs(spark, sf_dir)).filter(has_suffix(F.col("filename")))
    triaged = L.triage(L.score_snippets(snippets, model))
    planted = snippets.withColumn("content", views.planted(F.col("content"), F.lit(7)))
    means = [L.score_snippets(df, model).agg(F.avg("score").alias("a")).scalar() for df in (snippets, planted)]
    marked = F.contains("content", F.lit(K.FORCE_RISK_MARKER))
    follows = F.col("risky") == (marked | (F.col("score") > 0.5)).cast("int")
    return triaged.select(
        "diff_id", "pos", "filename", F.col("score").between(0, 1).alias("score_is_share"), follows.alias("risky_follows"),
        (means[1] - means[0] > 0.3).alias("tells_planted"),
    )


# --- triage and review ----------------------------------------------------------------------------------------------


def rule_scorer(snippets: DataFrame) -> DataFrame:
    """Risky when the added text has a lint hit or the marker."""
    predicted = snippets.withColumn("prediction", (lint_count(F.col("content")) > 0).cast("int"))
    return L.triage(predicted)


def _triaged(spark, sf_dir):
    snippets = D.parse_diffs(views.pr_diffs(spark, sf_dir)).filter(has_suffix(F.col("filename")))
    return rule_scorer(snippets)


def _analyzers(spark, sf_dir):
    return [W.rule_analyzer(), W.response_analyzer(views.pr_responses(spark, sf_dir))]


def _reports(spark, sf_dir):
    flags = R.flagged(_triaged(spark, sf_dir))
    return R.build_reports(flags, views.pr_files(spark, sf_dir), _analyzers(spark, sf_dir))


@query
def triage_override(spark, sf_dir):
    """Every fifth document carries the marker; the others take the prediction."""
    marker = F.when(F.col("doc_id") % 5 == 0, F.concat("code", F.lit(f"\n// {K.FORCE_RISK_MARKER}"))).otherwise(F.col("code"))
    docs = views.snippets(spark, sf_dir).select("doc_id", marker.alias("content"))
    predicted = docs.withColumn("prediction", (F.col("doc_id") % 2).cast("int"))
    return L.triage(predicted).select("doc_id", "prediction", "risky")


@query
def triage_flagged(spark, sf_dir):
    return R.flagged(_triaged(spark, sf_dir))


@query
def review_attach_code(spark, sf_dir):
    return R.attach_code(R.flagged(_triaged(spark, sf_dir)), views.pr_files(spark, sf_dir))


@query
def lint_lines(spark, sf_dir):
    return W.lint_lines(views.snippets(spark, sf_dir), "doc_id")


@query
def review_prompts(spark, sf_dir):
    return W.review_prompts(views.snippets(spark, sf_dir)).select("doc_id", "prompt")


@query
def review_parse(spark, sf_dir):
    parsed = W.parse_reviews(views.responses(spark, sf_dir))
    return W.findings_rows(parsed)


@query
def findings_severity_map(spark, sf_dir):
    parsed = W.findings_rows(W.parse_reviews(views.responses(spark, sf_dir)))
    raw = F.element_at(
        F.array(F.lit("error"), F.lit("fatal"), F.lit("warning"), F.lit("info"), F.lit(None), F.col("severity")),
        (F.col("conv_id") / 4 % 6).cast("int") + 1,
    )
    return parsed.select(
        "conv_id", "turn", "ord", W.map_severity(raw).alias("mapped"), W.normalized_severity(raw).alias("normalized")
    )


@query
def findings_union(spark, sf_dir):
    files = views.snippets(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "code")
    answers = views.responses(spark, sf_dir).withColumnRenamed("conv_id", "file_id")
    return W.findings_rows(W.run_analyzers(files, [W.rule_analyzer(), W.response_analyzer(answers)]))


@query
def report_build(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    path = run_dir(spark, "reports")
    tables.write_reports(reports, path)
    return tables.read_reports(spark, path).select(
        "report_id", "repo", "pr", "head_sha", "filename", "code", F.posexplode("issues").alias("ord", "_i")
    ).select("report_id", "repo", "pr", "head_sha", "filename", "code", "ord", "_i.*")


@query
def report_lookup(spark, sf_dir):
    path = run_dir(spark, "reports")
    tables.write_reports(_reports(spark, sf_dir), path)
    stored = tables.read_reports(spark, path)
    wanted = stored.agg(F.min("report_id")).first()[0]
    return R.lookup_report(stored, wanted).select("report_id", "filename", "code")


@query
def report_summary(spark, sf_dir):
    return R.report_summary(_reports(spark, sf_dir))


@query
def report_severity_counts(spark, sf_dir):
    return R.severity_counts(_reports(spark, sf_dir))


@query
def report_by_source(spark, sf_dir):
    return R.source_counts(_reports(spark, sf_dir))


# --- events and streams --------------------------------------------------------------------------------------------------


@query
def event_authentic(spark, sf_dir):
    return SE.authentic_events(views.webhooks(spark, sf_dir), views.SECRET).select("event_id", "signature")


@query
def event_project(spark, sf_dir):
    projected = SE.project_events(views.webhooks(spark, sf_dir))
    return projected.select("event_id", "event_type", "action", "repo", "pr", "head_sha")


@query
def event_filter(spark, sf_dir):
    projected = SE.project_events(views.webhooks(spark, sf_dir)).filter(SE.is_reviewable())
    return projected.select("event_id", "action", "repo", "pr")


@query
def stream_event_filter(spark, sf_dir):
    base = run_dir(spark, "stream-requests")
    events = views.webhook_stream(spark, sf_dir)
    SR.request_stream(events, views.SECRET, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "action", "repo", "pr", "head_sha")


@query
def stream_rejects(spark, sf_dir):
    base = run_dir(spark, "stream-rejects")
    events = views.webhook_stream(spark, sf_dir)
    SR.reject_stream(events, views.SECRET, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "reason")


@query
def stream_triage(spark, sf_dir):
    base = run_dir(spark, "stream-triage")
    SR.review_stream(
        views.webhook_stream(spark, sf_dir),
        views.pr_diffs(spark, sf_dir),
        views.pr_files(spark, sf_dir),
        rule_scorer,
        _analyzers(spark, sf_dir),
        views.SECRET,
        f"{base}/out",
        f"{base}/state",
    ).awaitTermination()
    reports = SR.read_stream_reports(spark, f"{base}/out")
    return reports.select("report_id", "repo", "pr", "filename", F.size("issues").cast("long").alias("n_issues"))
