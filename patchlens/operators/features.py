"""Feature tables from text and code columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import code as C
from patchlens.functions import text as X

# --- fixed values: order of the feature vectors -------------------------------
BASIC_FEATURES = ("num_lines", "num_chars", "keyword_count")
RICH_FEATURES = (
    "num_lines", "num_chars", "keyword_count", "control_count", "exception_count", "method_calls",
    "comment_ratio", "suspicious_count", "line_stddev", "buggy_api_count", "entropy",
)
METADATA_FEATURES = ("msg_length", "has_bug_keyword", "path_depth", "snippet_length")
CODE_VECTOR_5 = ("lines_of_code", "methods", "complexity_without_do", "tries", "variables")
CODE_VECTOR_20 = (
    "lines_of_code", "non_empty_lines", "method_count", "complexity", "complexity_per_method",
    "loc_per_method", "nesting_depth", "decision_density", "if_count", "loop_count",
    "exception_ratio", "invocation_density", "variable_ratio", "null_check_ratio", "array_ratio",
    "cast_ratio", "assignment_density", "return_ratio", "halstead_volume", "vocabulary_size",
)
CONSTRUCTS = (
    "methods", "ifs", "loops", "tries", "catches", "variables", "return_statements",
    "method_invocations", "binary_operations", "assignments", "classes", "switch_statements",
    "ternary_expressions", "null_checks", "array_accesses", "cast_expressions",
)


def text_features(
    df: DataFrame,
    text_col: str,
    groups: Sequence[str] = ("basic",),
    path_col: str | None = None,
    message_col: str | None = None,
) -> DataFrame:
    """Adds the columns of the feature groups "basic", "rich" and "metadata"."""
    text = F.col(text_col)
    added: dict = {}
    for group in groups:
        if group == "basic":
            added.update(X.basic_features(text))
        elif group == "rich":
            added.update(X.rich_features(text))
        elif group == "metadata":
            path = F.col(path_col) if path_col else F.lit("")
            message = F.col(message_col) if message_col else F.lit("")
            added.update(X.metadata_features(text, path, message))
        else:
            raise ValueError(f"unknown feature group {group!r}")
    return df.withColumns(added)


def code_metrics(df: DataFrame, code_col: str = "code") -> DataFrame:
    """Adds sizes, construct counts, complexity, nesting, Halstead and ratios.

    The text is tokenised once per row. Blank and NULL code gives zeros.
    """
    tokenised = df.withColumn("_tok", C.tokens(F.col(code_col))).withColumns(
        {**C.size_counts(F.col(code_col)), "_shape": C.shape(F.col("_tok")), "_distinct": F.array_distinct("_tok")}
    )
    shape = F.col("_shape")
    counted = tokenised.withColumns(
        {
            **C.construct_counts(shape),
            **C.cyclomatic(shape),
            "nesting_depth": C.nesting_depth(shape),
            **C.halstead(F.col("_distinct")),
        }
    )

    def per(numerator, denominator):
        return F.when(denominator > 0, numerator / F.greatest(denominator, F.lit(1))).otherwise(0.0)

    c = F.col
    methods = F.greatest(c("methods"), F.lit(1))
    lines = c("non_empty_lines")
    vocabulary = c("unique_operators") + c("unique_names")
    measured = counted.withColumns(
        {
            "method_count": methods,
            "complexity_per_method": c("complexity") / methods,
            "loc_per_method": c("lines_of_code") / methods,
            "decision_density": per(c("ifs") + c("loops") + c("switch_statements"), lines),
            "if_count": c("ifs"),
            "loop_count": c("loops"),
            "exception_ratio": (c("tries") + c("catches")) / methods,
            "invocation_density": per(c("method_invocations"), lines),
            "variable_ratio": per(c("variables"), lines),
            "null_check_ratio": per(c("null_checks"), c("binary_operations")),
            "array_ratio": per(c("array_accesses"), lines),
            "cast_ratio": per(c("cast_expressions"), lines),
            "assignment_density": per(c("assignments"), lines),
            "return_ratio": c("return_statements") / methods,
            "vocabulary_size": vocabulary,
            "halstead_volume": C.volume(vocabulary),
        }
    )
    metrics = [m for m in measured.columns if m not in {*df.columns, "_tok", "_shape", "_distinct", "is_blank"}]
    zeroed = [F.when(c("is_blank"), F.lit(0)).otherwise(c(m)).alias(m) for m in metrics]
    return measured.select(*df.columns, *zeroed)


def assemble(parts: Sequence[DataFrame], key: str, feature_cols: Sequence[str], output_col: str = "features") -> DataFrame:
    """Joins feature blocks by key and assembles one vector per row.

    Rows are matched by key, never by position; keys are unique in every part. A
    missing value is an error: drop such rows first (``prep.drop_missing``) or fill them.
    """
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, key)
    return VectorAssembler(inputCols=list(feature_cols), outputCol=output_col, handleInvalid="error").transform(joined)
