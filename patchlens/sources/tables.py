"""Corpora, labelled diffs, lint reports, reports and cached embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens import schemas
from patchlens.functions import constants as K
from patchlens.operators.review import FINDINGS_DDL, map_severity

ROWS_PER_FILE = 500_000
EMBEDDING_BUCKETS = 256
PROJECT_COPY = "project_name"
# Quotes doubled, texts kept as they are: "" stays "" and blanks are not trimmed.
DIFF_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "encoding": "UTF-8",
}
NULL_MARK = "\\N"
LIKE_NULL = r"\A\\+N\z"


def write_export(rows: DataFrame, path: str) -> None:
    """Commits or file changes, one JSON object per line, compressed: a file change holds its texts several times.

    A compressed file is read by one task, and so is what one task wrote.
    """
    rows.write.option("compression", "gzip").json(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported commits, one JSON object per line."""
    return spark.read.schema(schemas.EXPORTED_COMMITS).json(path)


def read_file_changes(spark: SparkSession, path: str, by_project: bool = True) -> DataFrame:
    """Exported file changes, one JSON object per line.

    ``by_project=False`` reads the export of one repository, which names no project.
    """
    changes = spark.read.schema(schemas.EXPORTED_FILE_CHANGES).json(path)
    return changes if by_project else changes.drop("project_url")


def read_changes(spark: SparkSession, path: str | list[str], format: str = "parquet") -> DataFrame:
    """A change corpus as "parquet", "json" (lines) or "json_array".

    A filter on the project opens its folder only. A single JSON array cannot be
    split, so that form is for exchange; several files are read in parallel. A
    missing path is an error.
    """
    if format == "json_array":
        return spark.read.schema(schemas.CHANGES).option("multiLine", "true").json(path)
    stored = T.StructType([*schemas.CHANGES.fields, T.StructField(PROJECT_COPY, T.StringType())])
    changes = spark.read.schema(stored).format(format).load(path)
    # empty and missing projects share one folder; only there the copy is needed
    named = changes.filter(F.col("project").isNotNull())
    others = changes.filter(F.col("project").isNull()).withColumn("project", F.col(PROJECT_COPY))
    return named.unionByName(others).select(*schemas.CHANGES.names)


def write_changes(changes: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per project.

    The project is kept in the files too, as a folder name cannot tell an empty project
    from a missing one. Rebalancing gathers small projects, so that tasks do not leave a file each in
    every folder, and splits a large project over many tasks.
    """
    (
        changes.select(*schemas.CHANGES.names, F.col("project").alias(PROJECT_COPY))
        .hint("rebalance", "project")
        .write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("project")
        .format(format)
        .save(path)
    )


def write_labelled_diffs(diffs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and multi-line quoted text, in files of bounded size.

    Reading multi-line CSV takes one task per file, hence the bound.
    """
    # a text that looks like the mark of a missing one gets a backslash more
    marked = F.when(F.col("diff_text").rlike(LIKE_NULL), F.concat(F.lit("\\"), "diff_text")).otherwise(F.col("diff_text"))
    writer = diffs.select(*schemas.LABELLED_DIFFS.names).withColumn("diff_text", marked).write.mode(mode)
    writer.options(**DIFF_CSV_OPTIONS, quoteAll="true", nullValue=NULL_MARK, maxRecordsPerFile="20000").csv(path)


def read_labelled_diffs(spark: SparkSession, path: str) -> DataFrame:
    stored = (
        spark.read.schema(schemas.LABELLED_DIFFS)
        .options(**DIFF_CSV_OPTIONS, multiLine="true", nullValue=NULL_MARK, maxCharsPerColumn="-1")
        .csv(path)
    )
    text = F.col("diff_text")
    return stored.withColumn("diff_text", F.when(text.rlike(LIKE_NULL), F.substring(text, 2, 2147483647)).otherwise(text))


def _plain_finding(e: Column) -> Column:
    return F.struct(
        e["_line"].try_cast("int").alias("line"),
        F.lower(F.coalesce(e["_severity"], F.lit("info"))).alias("severity"),
        e["_message"].alias("message"),
        F.lit(K.LINTER_SOURCE).alias("source"),
    )


def _mapped_finding(e: Column) -> Column:
    return F.struct(
        F.coalesce(e["_line"].try_cast("int"), F.lit(0)).alias("line"),
        map_severity(e["_severity"]).alias("severity"),
        F.coalesce(e["_message"], F.lit(K.NO_LINT_MESSAGE)).alias("message"),
        F.coalesce(e["_source"], F.lit(K.LINTER_SOURCE)).alias("source"),
    )


def read_lint_reports(spark: SparkSession, path: str, mapped: bool = False) -> DataFrame:
    """(filename, findings) from lint report XML, one row per <file> element.

    A missing severity is "info" and a line that is no number is NULL. With
    ``mapped``, severities become major or minor, a missing line 0, and the
    rule name is kept as the source.
    """
    files = spark.read.format("xml").option("rowTag", "file").schema(schemas.LINT_FILE).load(path)
    findings = F.transform(
        F.coalesce("error", F.array().cast(schemas.LINT_FILE["error"].dataType)),
        _mapped_finding if mapped else _plain_finding,
    )
    return files.select(F.col("_name").alias("filename"), findings.cast(FINDINGS_DDL).alias("findings"))


def write_lint_reports(findings: DataFrame, path: str) -> None:
    """Lint report XML from (filename, findings)."""
    errors = F.transform(
        "findings",
        lambda f: F.struct(
            f["line"].cast("string").alias("_line"),
            f["severity"].alias("_severity"),
            f["message"].alias("_message"),
            f["source"].alias("_source"),
        ),
    )
    (
        findings.select(F.col("filename").alias("_name"), errors.alias("error"))
        .write.format("xml")
        .option("rootTag", "checkstyle")
        .option("rowTag", "file")
        .save(path)
    )


def write_reports(reports: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per first digit of the id, sorted by id. Streams use the same layout.

    A lookup opens one folder and, in parquet, the row groups that can hold the id: by their
    range, and by a Bloom filter of their ids, which also turns most absent ids away.
    """
    keyed = reports.select(*schemas.REPORTS.names, F.substring("report_id", 1, 1).alias("id_prefix"))
    ordered = keyed.hint("rebalance", "id_prefix").sortWithinPartitions("id_prefix", "report_id")
    writer = ordered.write.mode(mode).partitionBy("id_prefix")
    if format == "parquet":
        writer = writer.option("parquet.bloom.filter.enabled#report_id", "true").option("parquet.bloom.filter.fpp#report_id", "0.01")
    writer.format(format).save(path)


def read_reports(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Reports with their ``id_prefix``."""
    schema = T.StructType([*schemas.REPORTS.fields, T.StructField("id_prefix", T.StringType())])
    return spark.read.schema(schema).format(format).load(path)


def write_embedding_table(new: DataFrame, table: str, buckets: int = EMBEDDING_BUCKETS) -> None:
    """Adds (key, embedding) rows to a table of the catalog that is bucketed and sorted by key.

    A join by key reads the table bucket by bucket and does not shuffle it. The number of
    buckets is that of the first write; take it so that a bucket fits a task.
    """
    rows = new.select(*schemas.EMBEDDINGS.names).repartition(buckets, "key")  # one file a bucket
    rows.write.mode("append").bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(table)


def append_embeddings(new: DataFrame, path: str) -> None:
    """Adds (key, embedding) rows to the cache."""
    new.select(*schemas.EMBEDDINGS.names).write.mode("append").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)
