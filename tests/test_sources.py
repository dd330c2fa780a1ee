"""Readers and writers."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.plans import views
from patchlens.sources import tables

CHANGES = [
    ("kit", "c1", "a.java", "line\n\"quoted\", x", "", 1.0, 0.0),
    ("kit", "c2", "b.java", None, " padded ", 0.5, 0.5),
    ("pot", "c3", "c.java", "é\r\n", "\\", 1.0, 0.0),
    ("", "c4", "d.java", "x", "y", 1.0, 0.0),
    (None, "c5", "e.java", "x", "y", 1.0, 0.0),
]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_changes(spark, tmp_path, format):
    path = str(tmp_path / "changes")
    tables.write_changes(spark.createDataFrame(CHANGES, schemas.CHANGES), path, format)
    back = tables.read_changes(spark, path, format)
    assert sorted(map(str, back.select(*schemas.CHANGES.names).collect())) == sorted(
        map(str, spark.createDataFrame(CHANGES, schemas.CHANGES).collect())
    )
    one = back.filter("project = 'pot'")
    assert one.count() == 1
    if format == "parquet":
        assert "PartitionFilters: [isnotnull(project" in one._jdf.queryExecution().executedPlan().toString()


def test_changes_json_arrays(spark, tmp_path):
    rows = [dict(zip(schemas.CHANGES.names, r)) for r in CHANGES]
    (tmp_path / "one.json").write_text(json.dumps(rows[:2], indent=2))
    (tmp_path / "two.json").write_text(json.dumps(rows[2:]))
    back = tables.read_changes(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")], "json_array")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(CHANGES, key=str)


def test_missing_corpus_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_changes(spark, str(tmp_path / "none")).count()


def test_labelled_diffs(spark, tmp_path):
    texts = ["a\nb", "", " lead and trail ", 'say "hi", ok', "\\", "\\N", "\\\\N", "x\\N", "x\r\ny", "\t", '"', "é\u2028z", None]
    rows = [(t, i, 0, 0, i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schemas.LABELLED_DIFFS)
    path = str(tmp_path / "csv")
    tables.write_labelled_diffs(df, path)
    back = {r["added_loc"]: r["diff_text"] for r in tables.read_labelled_diffs(spark, path).collect()}
    assert back == dict(enumerate(texts))


def test_lint_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        """<?xml version="1.0"?><checkstyle version="11">
        <file name="A.java"><error line="3" severity="ERROR" message="a &lt; b" source="x"/><error line="n" message="m"/></file>
        <file name="B.java"></file>
        <file name="C.java"><error severity="warning" message="w"/></file></checkstyle>"""
    )
    rows = {r["filename"]: [tuple(f) for f in r["findings"]] for r in tables.read_lint_reports(spark, str(tmp_path / "r.xml")).collect()}
    assert rows == {
        "A.java": [(3, "error", "a < b", "Checkstyle"), (None, "info", "m", "Checkstyle")],
        "B.java": [],
        "C.java": [(None, "warning", "w", "Checkstyle")],
    }


def test_lint_reports_round_trip(spark, tmp_path):
    findings = [("A.java", [(1, "error", "x & <y>", "Checkstyle")]), ("B.java", [])]
    df = spark.createDataFrame(findings, f"filename string, findings array<{schemas.FINDING.simpleString()}>")
    tables.write_lint_reports(df, str(tmp_path / "xml"))
    back = tables.read_lint_reports(spark, str(tmp_path / "xml"))
    assert sorted((r["filename"], [tuple(f) for f in r["findings"]]) for r in back.collect()) == findings


def test_exported_history(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"commit_hash": "c", "msg": "fix", "parents": ["p"], "committed_at": "2024-01-01T00:00:00Z"}\n')
    (tmp_path / "f.json").write_text('{"commit_hash": "c", "new_path": "a.java", "deleted": [{"line_no": 1, "text": "x"}], "added": []}\n')
    assert tables.read_commits(spark, str(tmp_path / "c.json")).first()["parents"] == ["p"]
    files = tables.read_file_changes(spark, str(tmp_path / "f.json"))
    assert files.select(F.size("deleted")).first()[0] == 1 and "project_url" in files.columns
    assert "project_url" not in tables.read_file_changes(spark, str(tmp_path / "f.json"), by_project=False).columns


def test_stored_reports_are_found_by_id(spark, tmp_path):
    from patchlens.operators.reports import lookup_report

    ids = [f"{i:x}{'ab' * 4}" for i in range(16)] + ["0e12", "1e5"]
    rows = [(i, "r", 1, "s", "a.java", [(1, "error", "m", "Checkstyle")], "code") for i in ids]
    tables.write_reports(spark.createDataFrame(rows, schemas.REPORTS), str(tmp_path / "reports"))
    stored = tables.read_reports(spark, str(tmp_path / "reports"))
    assert sorted(r["report_id"] for r in stored.collect()) == sorted(ids)
    for wanted in ids:
        assert [r["report_id"] for r in lookup_report(stored, wanted).collect()] == [wanted]
    assert lookup_report(stored, "feed").count() == 0
    plan = lookup_report(stored, "1e5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_prefix" in plan and "EqualTo(report_id,1e5)" in plan


def test_large_project_is_spread_over_files(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 9, "big").otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("project"),
        F.md5(F.col("id").cast("string")).alias("commit_hash"),
        F.lit("a.java").alias("file_path"),
        F.sha2(F.col("id").cast("string"), 512).alias("buggy_change"),
        F.sha2((-F.col("id")).cast("string"), 512).alias("fixed_change"),
        F.lit(1.0).alias("buggy_label"),
        F.lit(0.0).alias("fixed_label"),
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        tables.write_changes(rows.repartition(16), str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "c").iterdir() if p.is_dir()}
    assert files["project=big"] > 1
    assert all(n == 1 for name, n in files.items() if name != "project=big")
    assert tables.read_changes(spark, str(tmp_path / "c")).count() == 40_000


def test_embedding_cache_grows(spark, tmp_path):
    path = str(tmp_path / "cache")
    for key in ("a", "b"):
        tables.append_embeddings(spark.createDataFrame([(key, [1.0])], schemas.EMBEDDINGS), path)
    assert tables.read_embeddings(spark, path).count() == 2


def test_bucketed_cache_is_not_shuffled(spark):
    from patchlens.operators import embeddings as E

    table = "embedding_cache_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    texts = spark.createDataFrame([(f"text {i}",) for i in range(300)], "snippet string")
    known = E.content_key(texts.limit(200), "snippet").select("key", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    try:
        for part in known.randomSplit([1.0, 1.0], 1):
            tables.write_embedding_table(part, table, buckets=8)
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            keyed = E.content_key(texts, "snippet").select("key")
            joined = E.uncached_keys(keyed, spark.table(table))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount: 8 out of 8" in plan
            assert plan.count("Exchange") == 1  # of the wanted keys
            assert joined.count() == 300 - spark.table(table).select("key").distinct().count()
            missing = E.missing_embeddings(texts, "snippet", spark.table(table))
            assert missing.count() == joined.count()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_absent_report_reads_no_rows(spark, tmp_path):
    from patchlens.operators import reports as R

    ids = F.sha2(F.col("id").cast("string"), 256)
    one = spark.range(20_000).select(
        ids.alias("report_id"), F.lit("o/r").alias("repo"), F.lit(1).cast("long").alias("pr"), F.lit("s").alias("head_sha"),
        F.lit("a.java").alias("filename"), F.array().cast(schemas.REPORTS["issues"].dataType).alias("issues"), F.lit("code").alias("code"),
    )
    path = str(tmp_path / "reports")
    tables.write_reports(one, path)
    stored = tables.read_reports(spark, path)
    known = stored.orderBy("report_id").first()["report_id"]

    def rows_read(wanted):
        found = R.lookup_report(stored, wanted)
        count = len(found.collect())
        plan, scans = found._jdf.queryExecution().executedPlan(), []

        def visit(node):
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                node = node.executedPlan()
            if "Scan" in node.nodeName():
                scans.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            for i in range(children.size()):
                visit(children.apply(i))

        visit(plan)
        return count, sum(scans)

    assert rows_read(known)[0] == 1 and rows_read(known)[1] >= 1
    absent = [hashlib.sha256(f"absent {i}".encode()).hexdigest() for i in range(20)]
    read = [rows_read(a) for a in absent]
    assert all(count == 0 for count, _ in read)
    assert sum(rows == 0 for _, rows in read) >= 18  # within the ids of their folder, but not in the filter


def test_export_names_the_project_of_each_change(spark, tmp_path):
    """The named file changes are those joined with their commits, and an export is compressed."""
    rows = [(i, f"a {i}\nb\nc", "en", f"s{i % 3}") for i in range(9)] + [(None, "x", "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    named = views.file_changes(spark, str(tmp_path), named=True).filter("commit_hash IS NOT NULL")
    commits = views.commits(spark, str(tmp_path))
    joined = commits.select("commit_hash", "project_url").join(views.file_changes(spark, str(tmp_path)), "commit_hash")
    assert sorted(named.collect()) == sorted(joined.collect()) and named.count() == 5
    tables.write_export(named, f"{tmp_path}/files")
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "files").glob("part-*"))
    back = tables.read_file_changes(spark, f"{tmp_path}/files").select(*named.columns)
    key = lambda r: r["commit_hash"]
    assert sorted(back.collect(), key=key) == sorted(named.collect(), key=key)
