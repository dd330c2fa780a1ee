"""Classification metrics from (label, prediction, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators.ranks import running_totals


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows by label with one count column per predicted class 0 and 1."""
    return predictions.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count_if(F.col(prediction) == 0).alias("predicted_0"),
        F.count_if(F.col(prediction) == 1).alias("predicted_1"),
    )


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, plus the averages.

    Everything after the first grouping works on the cells of the confusion
    matrix. A zero denominator gives 0.
    """
    cells = predictions.groupBy(
        F.col(label).cast("int").alias("_l"), F.col(prediction).cast("int").alias("_p")
    ).agg(F.count("*").alias("n"))
    hit = F.when(F.col("_l") == F.col("_p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    actual = F.struct(
        F.col("_l").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits")
    )
    predicted = F.struct(
        F.col("_p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")
    )
    per_class = (
        cells.select(F.inline(F.array(actual, predicted)))
        .groupBy("cls")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    c = F.col
    scored = per_class.select(
        "cls",
        "support",
        "hits",
        ratio(c("hits"), c("predicted")).alias("precision"),
        ratio(c("hits"), c("support")).alias("recall"),
        ratio(2 * c("hits"), c("predicted") + c("support")).alias("f1"),
    )
    rows = scored.select(c("cls").cast("string").alias("class"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    measures = ("precision", "recall", "f1")
    share = ratio(F.sum("hits"), total)
    averages = scored.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), *[share.alias(m) for m in measures], total.alias("support")
            ),
            F.struct(
                F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total.alias("support")
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[ratio(F.sum(c(m) * c("support")), total).alias(m) for m in measures],
                total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return rows.unionByName(averages)


def roc_auc(predictions: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic, ties at one half.

    Rows are first counted per score, so equal scores never pile up, and running
    totals are taken range by range; the result is exact.
    """
    per_score = predictions.groupBy(F.lit("all").alias("_g"), F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(per_score, "_g", "_score", ["neg"])
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def fold_scores(predictions: DataFrame, fold: str = "fold", label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(fold).agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def cv_summary(fold_accuracies: DataFrame) -> DataFrame:
    """Mean, population deviation and number of the fold accuracies."""
    return fold_accuracies.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.count("*").alias("folds"),
    )


def quality_band(metrics: DataFrame, accuracy_col: str = "accuracy", rows_col: str | None = None) -> DataFrame:
    """Adds ``band``: below 0.70, 0.70 up to 0.80, and from 0.80.

    With ``rows_col`` also adds ``small_corpus`` for fewer than 100 rows.
    """
    a = F.col(accuracy_col)
    banded = metrics.withColumn(
        "band", F.when(a < 0.70, "below target").when(a < 0.80, "good").otherwise("excellent")
    )
    return banded.withColumn("small_corpus", F.col(rows_col) < 100) if rows_col else banded
