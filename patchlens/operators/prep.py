"""Labelled samples, splits, scaling, weighting and filtering for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import line_count
from patchlens.operators.ranks import approximate_quantiles, as_one_row, exact_quantiles, merged_sketches, sketched_quantiles
from patchlens.session import materialize

HASH_RANGE = 10_000
HASH_BITS = 32  # of hash_number
RANGE_BITS = 16  # of them that number the ranges in which the rows of a class are counted


def labelled_samples(
    changes: DataFrame, soft: bool = False, min_lines: int | None = None, suffix: str = "change"
) -> DataFrame:
    """Two rows per change, from one scan: the buggy side and the fixed side.

    The sides are the columns ``buggy_<suffix>`` and ``fixed_<suffix>``: "change"
    for the change corpus, "code" for whole-file pairs.

    Hard labels are 1 and 0; ``soft`` takes the labels stored in the corpus and
    adds ``label_binary`` (label > 0.5). ``min_lines`` asks for that many lines on
    both sides. Sample ids come from the content, so they are stable across runs.
    """
    if min_lines is not None:
        changes = min_lines_both(changes, min_lines, suffix)
    used = {f"{side}_{part}" for side in ("buggy", "fixed") for part in (suffix, "label")}
    keys = [c for c in changes.columns if c not in used]

    def side(name: str, hard: float) -> Column:
        label = F.col(f"{name}_label") if soft else F.lit(hard)
        return F.struct(F.lit(name).alias("side"), F.col(f"{name}_{suffix}").alias("snippet"), label.alias("label"))

    rows = changes.select(*keys, F.inline(F.array(side("buggy", 1.0), side("fixed", 0.0))))
    change_key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project", "commit_hash", "file_path")]
    rows = rows.withColumn("sample_id", F.md5(F.concat_ws("|", *change_key, "side")))
    return rows.withColumn("label_binary", (F.col("label") > 0.5).cast("int")) if soft else rows


def hash_number(key: Column, seed: int) -> Column:
    """A number from the first 8 hex digits of md5("seed:key")."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, id_col: str, train: float = 0.75, seed: int = 42, group_col: str | None = None) -> DataFrame:
    """Adds ``split`` ("train"/"test") from a hash of a stable id.

    Needs no shuffle, gives every class nearly the same share, and is the same in every run.
    ``group_col`` keeps rows that belong together on one side.
    """
    slot = hash_number(F.col(group_col or id_col), seed) % HASH_RANGE
    return df.withColumn("split", F.when(slot < int(round(train * HASH_RANGE)), "train").otherwise("test"))


def hash_folds(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", (hash_number(F.col(id_col), seed) % k).cast("int"))


def _class_cuts(df: DataFrame, key: Column, label_col: str, shares: Sequence[float], max_classes: int) -> DataFrame:
    """(label, cuts): for every share the key of the first row of a class that lies beyond it, null beyond the last.

    ``key`` is a struct of a 32-bit hash and an id. Rows of a class are counted in ranges of
    the hash; only the ranges that hold a cut are then ranked, so no class is sorted.
    """
    rows = df.select(F.col(label_col).alias("label"), key.alias("key"))
    rows = rows.withColumn("range", F.shiftright(F.col("key.hash"), HASH_BITS - RANGE_BITS))
    counts = rows.groupBy("label", "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("label")  # at most 2^RANGE_BITS rows a class
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("label", "range", "n", before.alias("before"), F.sum("n").over(whole).alias("total"))
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("total") * share + 0.5).alias("at")) for i, share in enumerate(shares)])
    wanted = placed.select("label", "range", "before", "n", F.explode(cuts).alias("cut"))
    wanted = wanted.filter((F.col("cut.at") >= F.col("before")) & (F.col("cut.at") < F.col("before") + F.col("n")))
    wanted = materialize(wanted.select("label", "range", F.col("cut.i").alias("i"), (F.col("cut.at") - F.col("before")).alias("skip")), "cuts")
    if wanted.count() > len(shares) * max_classes:
        raise ValueError(f"more than {max_classes} classes")
    held = rows.join(F.broadcast(wanted.select("label", "range").distinct().withColumnsRenamed({"label": "_l", "range": "_r"})),
                     F.col("label").eqNullSafe(F.col("_l")) & (F.col("range") == F.col("_r")), "left_semi")
    ranked = held.withColumn("place", F.row_number().over(Window.partitionBy("label", "range").orderBy("key")) - 1)
    ends = ranked.withColumnsRenamed({"label": "_l", "range": "_r"}).join(
        F.broadcast(wanted), F.col("label").eqNullSafe(F.col("_l")) & (F.col("range") == F.col("_r")) & (F.col("place") == F.col("skip"))
    )
    return ends.groupBy("label").agg(F.collect_list("key").alias("cuts"))


def _stratified(df: DataFrame, id_col: str, label_col: str, shares: Sequence[float], seed: int, max_classes: int) -> tuple[DataFrame, Column]:
    """``df`` with a column ``_cuts``, and the number of cuts that a row has behind it."""
    key = F.struct(hash_number(F.col(id_col), seed).alias("hash"), F.col(id_col).cast("string").alias("id"))
    cuts = materialize(_class_cuts(df, key, label_col, shares, max_classes), "class-cuts")
    joined = df.join(F.broadcast(cuts.withColumnsRenamed({"label": "_cut_label", "cuts": "_cuts"})), F.col(label_col).eqNullSafe(F.col("_cut_label")), "left")
    passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: key >= c))
    return joined, passed


def stratified_split(
    df: DataFrame, id_col: str, label_col: str = "label", train: float = 0.75, seed: int = 42, max_classes: int = 1000
) -> DataFrame:
    """Adds ``split`` ("train"/"test"): of every class the share ``train`` exactly, rounded to a row.

    The order in a class is that of a hash of the id, then of the id, so the split is the
    same in every run. Nulls are a class. ``df`` is read three times; pass a written table.
    """
    joined, passed = _stratified(df, id_col, label_col, [train], seed, max_classes)
    return joined.withColumn("split", F.when(passed == 0, "train").otherwise("test")).select(*df.columns, "split")


def stratified_folds(df: DataFrame, id_col: str, label_col: str = "label", k: int = 5, seed: int = 42, max_classes: int = 1000) -> DataFrame:
    """Adds ``fold`` (0 to ``k`` - 1); the rows of a class differ by one at most between folds."""
    joined, passed = _stratified(df, id_col, label_col, [i / k for i in range(1, k)], seed, max_classes)
    return joined.withColumn("fold", passed.cast("int")).select(*df.columns, "fold")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in a seeded random order (all rows when there are fewer)."""
    key = F.col(id_col).cast("string")
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key)), key).limit(n)


def balanced_weights(df: DataFrame, label_col: str = "label", max_classes: int = 1000) -> DataFrame:
    """Adds ``weight`` = n / (classes * n of the class).

    Class counts are one small map read as a scalar subquery; more than
    ``max_classes`` labels is an error, not a larger map.
    """
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).count().limit(max_classes + 1)
    checked = F.when(
        F.count("*") > max_classes, F.raise_error(F.lit(f"more than {max_classes} classes")).cast("bigint")
    ).otherwise(F.sum("count"))
    entries = F.map_from_entries(F.collect_list(F.struct(label_col, "count")))
    stats = counts.agg(
        F.struct(checked.alias("n"), F.count("*").alias("classes"), entries.alias("by_class")).alias("s")
    )
    s = F.col("_s")
    weight = s["n"] / (s["classes"] * s["by_class"][F.col(label_col)])
    return df.withColumn("_s", stats.scalar()).withColumn("weight", weight).drop("_s")


def positive_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: negatives, positives and their ratio."""
    counts = df.agg(
        F.count_if(F.col(label_col) == 0).alias("negatives"), F.count_if(F.col(label_col) == 1).alias("positives")
    )
    return counts.withColumn("positive_weight", F.try_divide(F.col("negatives"), F.col("positives")))


def standardize(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Replaces columns by z-scores with the moments of the rows where ``fit_on`` holds.

    Uses the population deviation; a constant column is only centred.
    """
    fitted = df if fit_on is None else df.filter(fit_on)
    moments = fitted.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"std_{c}") for c in cols]
        ).alias("m")
    )
    m = F.col("_m")
    return (
        df.withColumn("_m", moments.scalar())
        .withColumns(
            {c: (F.col(c) - m[f"mean_{c}"]) / F.when(m[f"std_{c}"] > 0, m[f"std_{c}"]).otherwise(1.0) for c in cols}
        )
        .drop("_m")
    )


def _quantiles(df: DataFrame, cols: Sequence[str], probabilities: Sequence[float], exact: bool) -> DataFrame:
    return (exact_quantiles if exact else approximate_quantiles)(df, cols, probabilities)


def _one_struct(quantiles: DataFrame, cols: Sequence[str]) -> Column:
    return as_one_row(quantiles, cols).select(F.struct(*cols).alias("q")).scalar()


def robust_scale(df: DataFrame, cols: Sequence[str], exact: bool = False) -> DataFrame:
    """Replaces columns by (x - median) / IQR; a zero IQR divides by 1.

    Quartiles come from sketches unless ``exact``.
    """
    quartiles = _one_struct(_quantiles(df, cols, (0.25, 0.5, 0.75), exact), cols)
    q = F.col("_q")

    def scaled(c: str) -> Column:
        spread = q[c]["q2"] - q[c]["q0"]
        return (F.col(c) - q[c]["q1"]) / F.when(spread > 0, spread).otherwise(1.0)

    return df.withColumn("_q", quartiles).withColumns({c: scaled(c) for c in cols}).drop("_q")


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5, exact: bool = False) -> DataFrame:
    """Rows (feature, q1, q3, lower, upper), from one pass with sketches or, if ``exact``, by ranks."""
    return _bounds(_quantiles(df, cols, (0.25, 0.75), exact), factor)


def sketched_iqr_bounds(sketches: DataFrame, factor: float = 1.5) -> DataFrame:
    """The bounds of all rows that went into stored sketches, see :func:`ranks.quantile_sketches`."""
    return _bounds(sketched_quantiles(merged_sketches(sketches), (0.25, 0.75)), factor)


def _bounds(quartiles: DataFrame, factor: float) -> DataFrame:
    q1, q3 = F.col("q0"), F.col("q1")
    return quartiles.select(
        "feature",
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - factor * (q3 - q1)).alias("lower"),
        (q3 + factor * (q3 - q1)).alias("upper"),
    )


def drop_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5, exact: bool = False) -> DataFrame:
    """Drops rows with any feature outside its IQR bounds; NULL is not outside. ``exact`` as in :func:`iqr_bounds`."""
    bounds = _one_struct(iqr_bounds(df, cols, factor, exact), cols)
    b = F.col("_b")
    outside = [(F.col(c) < b[c]["lower"]) | (F.col(c) > b[c]["upper"]) for c in cols]
    keep = F.lit(True)
    for o in outside:
        keep = keep & ~F.coalesce(o, F.lit(False))
    return df.withColumn("_b", bounds).filter(keep).drop("_b")


def drop_all_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keeps rows whose features sum to more than zero."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))
    return df.filter(total > 0)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keeps rows where every feature is a number (not NULL, not NaN)."""
    return df.dropna(subset=list(cols))


def anova_f(df: DataFrame, cols: Sequence[str], label_col: str = "label") -> DataFrame:
    """Rows (feature, f_value): the one-way ANOVA F of every feature.

    One aggregation to one row per class, then arithmetic on those rows.
    """
    per_class = df.groupBy(label_col).agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("within")
            ).alias(c)
            for c in cols
        ]
    )
    rows = per_class.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c)["n"].alias("n"),
                        F.col(c)["mean"].alias("mean"),
                        F.col(c)["within"].alias("within"),
                    )
                    for c in cols
                ]
            )
        )
    ).filter("n > 0")
    # from here on the table holds one row per class and feature
    feature = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    summed = (
        rows.withColumn("_off", F.col("mean") - grand)
        .groupBy("feature")
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("_off") * F.col("_off")).alias("between"),
            F.sum("within").alias("within"),
        )
    )
    between = F.try_divide(F.col("between"), F.col("k") - 1)
    within = F.try_divide(F.col("within"), F.col("n") - F.col("k"))
    return summed.select("feature", F.try_divide(between, within).alias("f_value"))


def select_features(df: DataFrame, cols: Sequence[str], label_col: str = "label", k: int = 15) -> list[str]:
    """Names of the ``k`` features with the largest ANOVA F, in input order.

    Every row needs all its values; see :func:`drop_missing`.
    """
    assembled = VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="error").transform(df)
    selector = UnivariateFeatureSelector(
        featuresCol="_features", outputCol="_selected", labelCol=label_col, selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(k, len(cols)))
    return [cols[i] for i in sorted(selector.fit(assembled).selectedFeatures)]


def min_lines_both(
    changes: DataFrame, min_lines: int = K.MIN_LINES_PER_SIDE, suffix: str = "change"
) -> DataFrame:
    """Changes with at least ``min_lines`` lines on each side."""
    buggy, fixed = line_count(F.col(f"buggy_{suffix}")), line_count(F.col(f"fixed_{suffix}"))
    return changes.filter((buggy >= min_lines) & (fixed >= min_lines))
