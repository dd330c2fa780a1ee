"""Commit history to labelled change corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import has_suffix, mentions_any, project_name
from patchlens.operators.joins import limited_broadcast, salted_join


def bugfix_commits(
    commits: DataFrame, keywords: Sequence[str] = K.BUGFIX_WORDS, merges: bool = False
) -> DataFrame:
    """Commits whose message holds a keyword; merge commits only on request."""
    kept = commits.filter(mentions_any(F.col("msg"), keywords))
    if not merges:
        kept = kept.filter(F.size("parents") < 2)
    return kept.withColumn("project", project_name(F.col("project_url")))


def size_labels(df: DataFrame, size_col: str, soft_below: int = K.SOFT_LABEL_BELOW) -> DataFrame:
    """(0.5, 0.5) for small changes, (1.0, 0.0) for the others."""
    small = F.col(size_col) < soft_below
    return df.withColumns(
        {
            "buggy_label": F.when(small, 0.5).otherwise(1.0),
            "fixed_label": F.when(small, 0.5).otherwise(0.0),
        }
    )


def _commit_keys(other: DataFrame) -> list[str]:
    """A hash names a commit within its project; forks share hashes."""
    return ["project_url", "commit_hash"] if "project_url" in other.columns else ["commit_hash"]


def _named(file_changes: DataFrame, suffixes: Sequence[str]) -> Column:
    """Whether the file is of the language; a deleted file has a name but no new path."""
    names = [c for c in ("filename", "new_path") if c in file_changes.columns]
    return has_suffix(F.coalesce(*names), suffixes)


def mine_changes(
    commits: DataFrame,
    file_changes: DataFrame,
    keywords: Sequence[str] = K.BUGFIX_WORDS,
    suffixes: Sequence[str] = K.LANGUAGE_SUFFIXES,
    min_size: int = K.MIN_CHANGED_LINES,
    soft_below: int = K.SOFT_LABEL_BELOW,
    keep_message: bool = False,
) -> DataFrame:
    """The change corpus: one row per changed file of a bug-fix commit.

    Both sides are filtered and cut to the needed columns before the join; a
    commit that touches a huge number of files is spread over several tasks. File
    changes with a ``project_url`` belong to the commit of that project only; with a
    ``filename`` deleted files count, with an empty path.
    """
    size, keys = F.size("deleted") + F.size("added"), _commit_keys(file_changes)
    files = file_changes.filter(_named(file_changes, suffixes) & (size >= min_size)).select(
        *keys,
        F.coalesce("new_path", F.lit("")).alias("file_path"),
        F.array_join("deleted.text", "\n").alias("buggy_change"),
        F.array_join("added.text", "\n").alias("fixed_change"),
        size.alias("_size"),
    )
    fixes = bugfix_commits(commits, keywords).select(*keys, "project", "msg")
    touched = file_changes.filter(_named(file_changes, suffixes)).select(*keys)
    matched = salted_join(files, fixes, keys, count_left=touched, left_by=["file_path"])
    joined = size_labels(matched, "_size", soft_below)
    columns = [
        "project", "commit_hash", "file_path", "buggy_change", "fixed_change", "buggy_label", "fixed_label",
    ]
    return joined.select(*columns, *([F.col("msg").alias("commit_msg")] if keep_message else []))


def modified_pairs(
    commits: DataFrame,
    file_changes: DataFrame,
    keywords: Sequence[str] = K.BUGFIX_WORDS_WIDE,
    suffixes: Sequence[str] = K.LANGUAGE_SUFFIXES,
) -> DataFrame:
    """Whole-file pairs of files that exist before and after a bug-fix commit."""
    keys = _commit_keys(file_changes)
    files = file_changes.filter(
        has_suffix(F.col("new_path"), suffixes)
        & (F.col("source_before") != "")
        & (F.col("source_after") != "")
    ).select(
        *keys,
        F.col("new_path").alias("file_path"),
        F.col("source_before").alias("buggy_code"),
        F.col("source_after").alias("fixed_code"),
    )
    fixes = bugfix_commits(commits, keywords, merges=True).select(*keys, "project")
    touched = file_changes.filter(has_suffix(F.col("new_path"), suffixes)).select(*keys)
    matched = salted_join(files, fixes, keys, count_left=touched, left_by=["file_path"])
    return matched.select("project", "commit_hash", "file_path", "buggy_code", "fixed_code")


def latest_commits(
    commits: DataFrame,
    n: int = K.LATEST_COMMITS,
    per_project: bool = False,
    salts: int = 64,
    branch: str | None = None,
) -> DataFrame:
    """The newest ``n`` commits, ties by hash; with ``branch`` those that have it in ``branches``.

    Per project, every salt of a project first keeps its own newest ``n``, so a
    project with most of the commits is never ranked in one task.
    """
    newest = [F.desc("committed_at"), F.asc("commit_hash")]
    if branch is not None:
        commits = commits.filter(F.array_contains("branches", branch))
    if not per_project:
        return commits.orderBy(*newest).limit(n)
    salt = F.pmod(F.xxhash64("commit_hash"), F.lit(salts))
    local = Window.partitionBy("project_url", "_salt").orderBy(*newest)
    whole = Window.partitionBy("project_url").orderBy(*newest)
    return (
        commits.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def changed_files(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Files that differ between a commit and its first parent.

    ``trees`` lists (commit_hash, path, blob). Every tree row is sent to the
    commits it describes, once as the new side and once as the old side, and the
    two sides meet in one aggregation by (commit, path); root commits drop out, and
    so do commits of which the parent has no tree, see :func:`without_parent_tree`.
    """
    parent = F.get("parents", F.lit(0))
    present = trees.select(F.col("commit_hash").alias("_parent")).distinct()
    children = commits.filter(F.size("parents") > 0).join(present, parent == F.col("_parent"), "left_semi")
    own = F.struct(F.col("commit_hash").alias("tree"), F.col("commit_hash"), F.lit(True).alias("is_new"))
    base = F.struct(parent.alias("tree"), F.col("commit_hash"), F.lit(False).alias("is_new"))
    roles = children.select(F.inline(F.array(own, base)))
    blobs = trees.select(F.col("commit_hash").alias("tree"), "path", "blob")
    sides = salted_join(roles, blobs, ["tree"], both_sides=True, left_by=["commit_hash"], right_by=["path"])
    compared = sides.groupBy("commit_hash", "path").agg(
        F.max(F.when(~F.col("is_new"), F.col("blob"))).alias("old_blob"),
        F.max(F.when(F.col("is_new"), F.col("blob"))).alias("new_blob"),
    )
    change = (
        F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").otherwise("modified")
    )
    return compared.filter(~F.col("old_blob").eqNullSafe(F.col("new_blob"))).withColumn("change", change)


def without_parent_tree(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Hashes of the commits that cannot be compared, as their first parent has no tree."""
    present = trees.select(F.col("commit_hash").alias("_parent")).distinct()
    children = commits.filter(F.size("parents") > 0)
    return children.join(present, F.get("parents", F.lit(0)) == F.col("_parent"), "left_anti").select("commit_hash")


def commit_diffs(
    commits: DataFrame,
    patches: DataFrame,
    n: int = K.LATEST_COMMITS,
    per_project: bool = False,
    branch: str | None = None,
) -> DataFrame:
    """Non-empty patches (commit_hash, path, diff_text) of the newest commits, roots left out.

    The newest of all commits, or of every project, and of one branch when it is named.
    The ``n`` commit hashes are broadcast, so patches are not shuffled; those of all
    projects have no such limit, and Spark chooses the join by their size.
    """
    keys = _commit_keys(patches)
    newest = latest_commits(commits, n, per_project, branch=branch)
    latest = newest.filter(F.size("parents") > 0).select(*keys)
    limited = latest if per_project else limited_broadcast(latest, n)
    return patches.filter(F.col("diff_text") != "").join(limited, keys, "left_semi")


def class_counts(samples: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows (label, n) of labelled samples; missing labels are a class of their own."""
    return samples.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))


def append_corpora(*corpora: DataFrame) -> DataFrame:
    """Corpora of several projects or runs in one table."""
    return reduce(DataFrame.unionByName, corpora)


def corpus_counts(changes: DataFrame) -> DataFrame:
    """Kept changes, distinct commits and soft-labelled changes per project."""
    per_commit = changes.groupBy("project", "commit_hash").agg(
        F.count("*").alias("n"), F.count_if(F.col("buggy_label") == 0.5).alias("soft")
    )
    return per_commit.groupBy("project").agg(
        F.sum("n").alias("n_changes"),
        F.count("*").alias("n_commits"),
        F.sum("soft").alias("n_soft"),
    )
