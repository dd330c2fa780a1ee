"""Reports: risky files with their findings and text, and what is read off them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.operators.joins import BROADCAST_LIMIT, sized_join
from patchlens.operators.review import (
    Analyzer,
    RowAnalyzer,
    StoredAnalyzer,
    all_findings,
    normalized_severity,
    one_row_each,
)
from patchlens.session import materialize

SUMMARY_TEMPLATE = (
    "**Change review for `{file}`**\n\n"
    "This file was rated high-risk; the detailed review lists {count} issues.\n\n"
    "[Open the report]({base}/report/{id})"
)
FLAG_KEYS = ("repo", "pr", "head_sha", "pos", "filename")


def report_id(*parts: Column) -> Column:
    """The same id for the same file section of a change, so that retries agree."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def flagged(triaged: DataFrame) -> DataFrame:
    """Keys of the risky sections, written down before the expensive steps run.

    Carries no text, so that the file lookup can broadcast it when it is small.
    """
    return materialize(triaged.filter(F.col("risky") == 1).select(*FLAG_KEYS), "flagged")


def attach_code(flags: DataFrame, files: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Flagged sections with the full file text at their commit.

    ``files`` is (repo, path, ref, code). Files that are missing or empty drop
    out. Pass ``flags`` from :func:`flagged`: its size decides the join. Further
    columns of ``flags`` stay.
    """
    keys = ["repo", "filename", "head_sha"]
    named = files.withColumnsRenamed({"path": "filename", "ref": "head_sha"})
    texts = named.filter(F.col("code") != "").select(*keys, "code")
    joined = sized_join(texts, flags, keys, limit=limit, count_large=named.select(*keys), prune_by="repo")
    return joined.select(*flags.columns, "code")


def can_fail(analyzers: Sequence[Analyzer]) -> bool:
    """Whether one of them runs code of a user, which may fail for a file."""
    return not all(isinstance(a, (RowAnalyzer, StoredAnalyzer)) for a in analyzers)


def analyse_flagged(
    flags: DataFrame, files: DataFrame, analyzers: Sequence[Analyzer], limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Every flagged section with a text: (report_id, keys, issues, code, failures).

    Stored findings are joined to the narrow flags before the texts come, and rules
    are a column over the text, so texts are fetched once and not shuffled when the
    flags are few. Only analyzers of other kinds have the texts written for them.
    """
    keyed = flags.select(*FLAG_KEYS, report_id(*[F.col(k) for k in FLAG_KEYS]).alias("report_id"))
    kinds = dict(enumerate(analyzers))
    stored = {i: a for i, a in kinds.items() if isinstance(a, StoredAnalyzer)}
    others = {i: a for i, a in kinds.items() if not isinstance(a, (RowAnalyzer, StoredAnalyzer))}
    if stored:
        ids = keyed.select(F.col("report_id").alias("file_id"))
        for i, analyze in stored.items():
            found = one_row_each(analyze(ids), f"_f{i}").withColumnRenamed("file_id", "report_id")
            keyed = keyed.join(found, "report_id", "left")
        keyed = materialize(keyed, "answered")
    coded = attach_code(keyed, files, limit)
    if others:
        coded = materialize(coded, "coded")
        texts = coded.select(F.col("report_id").alias("file_id"), "code")
        for i, analyze in others.items():
            found = one_row_each(analyze(texts), f"_f{i}").withColumnRenamed("file_id", "report_id")
            coded = coded.join(found, "report_id", "left")
    parts = [
        a.column(F.col("code")) if isinstance(a, RowAnalyzer) else F.col(f"_f{i}.findings") for i, a in kinds.items()
    ]
    failures = F.array_compact(F.array(*[F.col(f"_f{i}.failure") for i in others])).cast("array<string>")
    return coded.select(
        "report_id", *FLAG_KEYS, all_findings(parts).alias("issues"), "code", failures.alias("failures")
    )


def with_issues(analysed: DataFrame) -> DataFrame:
    """The reports: sections whose file has at least one finding."""
    return analysed.filter(F.size("issues") > 0).select("report_id", *FLAG_KEYS, "issues", "code")


def build_reports(flags: DataFrame, files: DataFrame, analyzers: Sequence[Analyzer], limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One report per flagged section whose file has at least one finding."""
    return with_issues(analyse_flagged(flags, files, analyzers, limit))


def lookup_report(reports: DataFrame, wanted: str) -> DataFrame:
    """The report with an id; no row means "not found".

    Stored reports are partitioned by the start of the id, so the lookup opens
    one folder.
    """
    found = reports.filter(F.col("report_id") == wanted)
    return found.filter(F.col("id_prefix") == wanted[:1]) if "id_prefix" in reports.columns else found


def report_summary(reports: DataFrame, base_url: str = "http://localhost", template: str = SUMMARY_TEMPLATE) -> DataFrame:
    """Rows (report_id, filename, n_issues, summary); the text is a review comment."""
    text = F.lit(template)
    values = {
        "{file}": F.col("filename"),
        "{count}": F.size("issues").cast("string"),
        "{base}": F.lit(base_url),
        "{id}": F.col("report_id"),
    }
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    return reports.select(
        "report_id", "filename", F.size("issues").cast("long").alias("n_issues"), text.alias("summary")
    )


def _count_issues(test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("issues", lambda issue: test(issue))).cast("long")


def _has_level(level: str) -> Callable[[Column], Column]:
    return lambda issue: normalized_severity(issue["severity"]) == level


def severity_counts(reports: DataFrame) -> DataFrame:
    """Critical, major and minor issues per report, counted inside the row."""
    levels = ("critical", "major", "minor")
    return reports.select("report_id", *[_count_issues(_has_level(level)).alias(level) for level in levels])


def source_counts(reports: DataFrame, reviewer: str = K.REVIEWER_SOURCE) -> DataFrame:
    """Issues from the linter and from the reviewer per report."""
    return reports.select(
        "report_id",
        _count_issues(lambda i: i["source"] != reviewer).alias("static_issues"),
        _count_issues(lambda i: i["source"] == reviewer).alias("review_issues"),
    )
