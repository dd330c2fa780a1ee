"""Findings: rule analyzers over code, review requests and responses, and their union.

An analyzer takes a DataFrame (file_id, code) and returns (file_id, findings[,
failure]) with at most one row per file; a second row is an error. ``RowAnalyzer``
and ``StoredAnalyzer`` are the forms that need no second pass over the texts.
Findings stay inside the row of their file, so combining analyzers never collects
rows from elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.functions import constants as K
from patchlens.functions.text import or_empty, split_lines

Analyzer = Callable[[DataFrame], DataFrame]

FINDINGS_DDL = "array<struct<line:int,severity:string,message:string,source:string>>"
# (pattern, severity, message) per line rule; the patterns are the lint patterns
LINE_RULES = tuple((pattern, "warning", f"matches {pattern}") for pattern in K.LINT_PATTERNS)

REVIEW_TEMPLATE = (
    "Review the Java code below as a senior engineer. Report logic errors, security holes, "
    "performance problems and serious departures from good practice; leave style to the linter.\n"
    'Answer with a JSON list. Each entry has "line" (integer), "severity" ("major" or "critical") '
    'and "message" (string). Answer [] when there is nothing to report.\n'
    "```java\n{code}\n```\n"
)


def lint_findings(
    code: Column, rules: Sequence[tuple[str, str, str]] = LINE_RULES, source: str = K.LINTER_SOURCE
) -> Column:
    """Findings of the line rules, in line order and rule order; line numbers from 1."""

    def on_line(line: Column, i: Column) -> Column:
        hits = [
            F.when(
                line.rlike(pattern),
                F.struct(
                    (i + 1).cast("int").alias("line"),
                    F.lit(severity).alias("severity"),
                    F.lit(message).alias("message"),
                    F.lit(source).alias("source"),
                ),
            )
            for pattern, severity, message in rules
        ]
        return F.array_compact(F.array(*hits))

    return F.flatten(F.transform(split_lines(code), on_line)).cast(FINDINGS_DDL)


@dataclass(frozen=True)
class RowAnalyzer:
    """Findings that follow from the text of the row: a column over it, no join."""

    column: Callable[[Column], Column]

    def __call__(self, files: DataFrame) -> DataFrame:
        return files.select("file_id", self.column(F.col("code")).alias("findings"))


@dataclass(frozen=True)
class StoredAnalyzer:
    """Findings that are looked up by ``file_id``: texts take no part."""

    lookup: Analyzer

    def __call__(self, files: DataFrame) -> DataFrame:
        return self.lookup(files.select("file_id"))


def rule_analyzer(rules: Sequence[tuple[str, str, str]] = LINE_RULES, source: str = K.LINTER_SOURCE) -> RowAnalyzer:
    return RowAnalyzer(lambda code: lint_findings(code, rules, source))


def text_analyzer(review: Callable[[str], Sequence[tuple[int, str, str]]], source: str) -> Analyzer:
    """Findings (line, severity, message) of a Python function of one text, in Arrow batches.

    A file for which it raises has no findings of this analyzer and the error in
    ``failure``; the other files go on. A missing text is an empty one.
    """

    def attempt(code: str | None) -> tuple[list[dict], str | None]:
        try:
            found = [
                {"line": line, "severity": severity, "message": message, "source": source}
                for line, severity, message in review(code or "")
            ]
            return found, None
        except Exception as error:  # one bad file must not stop the others
            return [], f"{source}: {error!r}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [attempt(code) for code in batch["code"]]
            yield pd.DataFrame(
                {"file_id": batch["file_id"], "findings": [f for f, _ in found], "failure": [e for _, e in found]}
            )

    def analyze(files: DataFrame) -> DataFrame:
        kind = files.schema["file_id"].dataType.simpleString()
        return files.select("file_id", "code").mapInPandas(run, f"file_id {kind}, findings {FINDINGS_DDL}, failure string")

    return analyze


def response_analyzer(responses: DataFrame) -> StoredAnalyzer:
    """Findings from stored review responses (file_id, response[, turn]).

    All responses to a file count, in order of ``turn``; a file has one row of findings.
    """
    turn = F.col("turn") if "turn" in responses.columns else F.lit(0)

    def analyze(files: DataFrame) -> DataFrame:
        parsed = responses.select("file_id", turn.alias("turn"), parse_response(F.col("response")).alias("findings"))
        wanted = parsed.join(files.select("file_id"), "file_id", "left_semi")
        answers = F.array_sort(F.collect_list(F.struct("turn", "findings")))
        return wanted.groupBy("file_id").agg(F.flatten(answers["findings"]).alias("findings"))

    return StoredAnalyzer(analyze)


def lint_lines(files: DataFrame, id_col: str = "file_id", code_col: str = "code") -> DataFrame:
    """One row per finding of the line rules."""
    return files.select(id_col, F.inline_outer(lint_findings(F.col(code_col)))).filter(F.col("source").isNotNull())


def review_prompts(files: DataFrame, code_col: str = "code", template: str = REVIEW_TEMPLATE) -> DataFrame:
    """Adds ``prompt``: the template with the whole code in place of ``{code}``."""
    before, after = template.split("{code}")
    return files.withColumn("prompt", F.concat(F.lit(before), or_empty(F.col(code_col)), F.lit(after)))


def parse_response(response: Column, source: str = K.REVIEWER_SOURCE) -> Column:
    """Findings in a response text; anything but one JSON list of objects gives none.

    The list is what lies between the first "[" and the last "]". Wrapping it in
    an object makes text after the list an error.
    """
    listed = F.regexp_extract(or_empty(response), r"(?s)\[.*\]", 0)
    wrapped = F.concat(F.lit('{"items":'), listed, F.lit("}"))
    parsed = F.from_json(
        wrapped,
        "items array<struct<line:string,severity:string,message:string>>",
        {"allowSingleQuotes": "false"},
    )["items"]
    found = F.transform(
        parsed,
        lambda f: F.struct(
            f["line"].try_cast("int").alias("line"),
            f["severity"].alias("severity"),
            f["message"].alias("message"),
            F.lit(source).alias("source"),
        ),
    )
    usable = parsed.isNotNull() & ~F.exists(parsed, lambda f: f.isNull())
    return F.when(usable, found).otherwise(F.array()).cast(FINDINGS_DDL)


def parse_reviews(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """Replaces the response text by its findings."""
    return responses.withColumn("findings", parse_response(F.col(response_col))).drop(response_col)


def map_severity(severity: Column) -> Column:
    """error and fatal become major, everything else minor (NULL too)."""
    return F.when(severity.isin("error", "fatal"), "major").otherwise("minor")


def normalized_severity(severity: Column) -> Column:
    """critical, major and minor stay; linter levels are mapped."""
    return F.when(severity.isin("critical", "major", "minor"), severity).otherwise(map_severity(severity))


def one_row_each(found: DataFrame, name: str) -> DataFrame:
    """(file_id, <name>) with a struct of findings and failure; two rows of a file are an error."""
    failure = F.col("failure") if "failure" in found.columns else F.lit(None).cast("string")
    answer = F.struct(F.col("findings").cast(FINDINGS_DDL).alias("findings"), failure.alias("failure"))
    twice = F.raise_error(F.concat(F.lit("an analyzer gave two rows for "), F.col("file_id").cast("string")))
    rows = found.groupBy("file_id").agg(F.first(answer).alias("_answer"), F.count("*").alias("_n"))
    kind = f"struct<findings:{FINDINGS_DDL},failure:string>"
    return rows.select("file_id", F.when(F.col("_n") > 1, twice.cast(kind)).otherwise(F.col("_answer")).alias(name))


def all_findings(answers: Sequence[Column]) -> Column:
    """The findings of several analyzers as one list, in order; a missing list is empty."""
    return F.concat(*[F.coalesce(a, F.array().cast(FINDINGS_DDL)) for a in answers])


def run_analyzers(files: DataFrame, analyzers: Sequence[Analyzer]) -> DataFrame:
    """(file_id, findings) of all analyzers, in the order given; files without any stay.

    ``files`` has one row per file_id. Only ids and findings are joined.
    """
    local = [a.column(F.col("code")).alias(f"_f{i}") for i, a in enumerate(analyzers) if isinstance(a, RowAnalyzer)]
    combined = files.select("file_id", *local)
    parts = []
    for i, analyze in enumerate(analyzers):
        if isinstance(analyze, RowAnalyzer):
            parts.append(F.col(f"_f{i}"))
        else:
            combined = combined.join(one_row_each(analyze(files), f"_f{i}"), "file_id", "left")
            parts.append(F.col(f"_f{i}.findings"))
    return combined.select("file_id", all_findings(parts).alias("findings"))


def findings_rows(findings: DataFrame) -> DataFrame:
    """One row per finding with ``ord``, its place in the list of its file."""
    others = [c for c in findings.columns if c != "findings"]
    rows = findings.select(*others, F.posexplode_outer("findings").alias("ord", "_f")).filter(F.col("ord").isNotNull())
    return rows.select(*others, "ord", *[F.col(f"_f.{name}").alias(name) for name in schemas.FINDING.names])
