"""Event streams: filtering, rejects, repeated deliveries, replayed files."""

from __future__ import annotations

import datetime
import glob
import os
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.operators import models as L
from patchlens.operators import review as W
from patchlens.streaming import events as SE
from patchlens.streaming import review as SR

SECRET = "k"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def body(action="opened", pr=1, sha="s1", repo="o/r"):
    return json.dumps({"action": action, "pull_request": {"number": pr, "head": {"sha": sha}}, "repository": {"full_name": repo}})


def event(i, text, kind="pull_request", signature=None):
    right = "sha256=" + hmac.new(SECRET.encode(), text.encode(), hashlib.sha256).hexdigest()
    return (i, START + datetime.timedelta(minutes=i), kind, text, right if signature is None else signature)


EVENTS = [
    event(0, body()),
    event(1, body("synchronize", sha="s2")),
    event(2, body("closed")),
    event(3, body(), kind="push"),
    event(4, body(), signature="sha256=bad"),
    (5, START, "pull_request", body(), None),
    event(6, "{broken"),
    event(7, '{"action": "opened", "pull_request": {"number": 2}, "repository": {"full_name": "o/r"}}'),
    event(8, body("reopened")),
    event(9, "[]"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.WEBHOOK_EVENTS)


def test_requests_and_rejects(spark):
    df = frame(spark, EVENTS)
    assert sorted(r["event_id"] for r in SE.review_requests(df, SECRET).collect()) == [0, 1, 8]
    rejects = {r["event_id"]: r["reason"] for r in SE.rejected_events(df, SECRET).collect()}
    assert rejects == {4: "unauthorized", 5: "unauthorized", 6: "unreadable body", 7: "incomplete body", 9: "unreadable body"}
    assert SE.review_requests(df, None).count() == 0


@pytest.fixture()
def tables(spark):
    diff = "diff --git a/a.java b/a.java\n+x == null\ndiff --git a/b.py b/b.py\n+null\ndiff --git a/c.java b/c.java\n+calm"
    diffs = spark.createDataFrame([("o/r", 1, diff), ("o/r", 2, diff)], "repo string, pr long, diff_text string")
    files = spark.createDataFrame(
        [("o/r", p, s, "null") for p in ("a.java", "b.py", "c.java") for s in ("s1", "s2")],
        "repo string, path string, ref string, code string",
    )
    return diffs, files


def scorer(snippets):
    return L.triage(snippets.withColumn("prediction", F.contains("content", F.lit("null")).cast("int")))


def source(spark, folder):
    return spark.readStream.schema(schemas.WEBHOOK_EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, base, tables):
    query = SR.review_stream(
        source(spark, folder), *tables, scorer, [W.rule_analyzer()], SECRET, f"{base}/out", f"{base}/state"
    )
    query.awaitTermination()
    return SR.read_stream_reports(spark, f"{base}/out")


def test_review_stream(spark, tmp_path, tables):
    folder = str(tmp_path / "in")
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    got = run(spark, folder, tmp_path, tables)
    assert sorted((r["pr"], r["head_sha"], r["filename"], len(r["issues"])) for r in got.collect()) == [
        (1, "s1", "a.java", 1), (1, "s2", "a.java", 1)
    ]
    before = {r["report_id"] for r in got.collect()}
    # the same deliveries again, in a second file, and one new change
    again = [(i + 100, t, k, b, s) for i, t, k, b, s in EVENTS]
    frame(spark, [*again, event(200, body(pr=2, sha="s1"))]).coalesce(1).write.mode("append").parquet(folder)
    after = run(spark, folder, tmp_path, tables)
    assert after.count() == 3 and before < {r["report_id"] for r in after.collect()}
    raw = spark.read.parquet(f"{tmp_path}/out")
    assert raw.count() == 5  # new deliveries for s1 and s2 are reviewed again


def test_handled_deliveries_are_left_out(spark, tmp_path, tables):
    folder = str(tmp_path / "in")
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    run(spark, folder, tmp_path, tables)
    frame(spark, [*EVENTS, event(200, body(pr=2, sha="s1"))]).coalesce(1).write.mode("append").parquet(folder)
    assert run(spark, folder, tmp_path, tables).count() == 3
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_late_and_future_events_are_reviewed(spark, tmp_path, tables):
    folder = str(tmp_path / "in")
    for i, days in enumerate((0, 4000, -300, 10)):
        row = event(i, body(pr=1 + i % 2, sha=f"s{1 + i // 2}"))
        row = (row[0], START + datetime.timedelta(days=days), *row[2:])
        frame(spark, [row]).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, folder, tmp_path, tables)
    assert sorted((r["pr"], r["head_sha"]) for r in got.collect()) == [(1, "s1"), (1, "s2"), (2, "s1"), (2, "s2")]


def test_diffs_belong_to_their_head(spark, tables):
    diffs, files = tables
    one, two = (f"diff --git a/{n}.java b/{n}.java\n+null" for n in "ac")
    by_head = spark.createDataFrame([("o/r", 1, "s1", one), ("o/r", 1, "s2", two)], "repo string, pr long, head_sha string, diff_text string")
    wanted = spark.createDataFrame([("o/r", 1, "s1"), ("o/r", 1, "s2")], "repo string, pr long, head_sha string")
    got = SR.review_batch(wanted, by_head, files, scorer, [W.rule_analyzer()])
    assert sorted((r["head_sha"], r["filename"]) for r in got.collect()) == [("s1", "a.java"), ("s2", "c.java")]


def test_repeated_batch_replaces_its_folder(spark, tmp_path, tables):
    folder = str(tmp_path / "in")
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    run(spark, folder, tmp_path, tables)
    # a lost state folder makes the stream start over and write batch 0 once more
    query = SR.review_stream(
        source(spark, folder), *tables, scorer, [W.rule_analyzer()], SECRET, f"{tmp_path}/out", f"{tmp_path}/new-state"
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_a_failing_file_is_listed_and_the_stream_goes_on(spark, tmp_path, tables):
    diffs, files = tables
    files = files.withColumn("code", F.when(F.col("ref") == "s2", "poison").otherwise(F.col("code")))

    def own(code):
        if "poison" in code:
            raise ValueError("no such luck")
        return [(1, "major", "own")]

    folder, out = str(tmp_path / "in"), f"{tmp_path}/out"
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    SR.review_stream(
        source(spark, folder), diffs, files, scorer, [W.text_analyzer(own, "own")], SECRET, out, f"{tmp_path}/state"
    ).awaitTermination()
    stored = SR.read_stream_reports(spark, out)
    assert [(r["head_sha"], r["id_prefix"]) for r in stored.collect()] == [("s1", r["report_id"][0]) for r in stored.collect()]
    failed = spark.read.parquet(f"{out}-failed").collect()
    assert [(r["head_sha"], "no such luck" in r["failures"][0]) for r in failed] == [("s2", True)]


def test_hot_change_is_reviewed_once(spark, tmp_path, tables):
    folder = str(tmp_path / "in")
    frame(spark, [event(i, body()) for i in range(300)]).coalesce(1).write.parquet(folder)
    assert run(spark, folder, tmp_path, tables).count() == 1


def test_model_in_the_stream(spark, tmp_path, tables):
    rows = [(f"{i}", "null if\n" * (i % 9 + 3) if i % 2 else "calm", float(i % 2)) for i in range(60)]
    from patchlens.operators import features as X

    train = X.text_features(spark.createDataFrame(rows, "sample_id string, snippet string, label double"), "snippet")
    model = L.train(train, X.BASIC_FEATURES, kind="rf", numTrees=5, maxDepth=3)
    folder = str(tmp_path / "in")
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    query = SR.review_stream(
        source(spark, folder), *tables, lambda s: L.triage(L.score_snippets(s, model)), [W.rule_analyzer()], SECRET,
        f"{tmp_path}/out", f"{tmp_path}/state",
    )
    query.awaitTermination()
    stored = SR.read_stream_reports(spark, f"{tmp_path}/out")  # no risky section leaves no file
    scored = L.triage(L.score_snippets(spark.createDataFrame([("x == null",), ("calm",)], "content string"), model))
    risky = {r["content"] for r in scored.filter("risky = 1").collect()}
    expected = [name for name, text in (("a.java", "x == null"), ("c.java", "calm")) if text in risky]
    assert sorted({r["filename"] for r in stored.collect()}) == expected


def test_plain_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    frame(spark, EVENTS).coalesce(1).write.parquet(folder)
    SR.request_stream(source(spark, folder), SECRET, f"{tmp_path}/a", f"{tmp_path}/sa").awaitTermination()
    SR.reject_stream(source(spark, folder), SECRET, f"{tmp_path}/b", f"{tmp_path}/sb").awaitTermination()
    SR.request_stream(source(spark, folder), SECRET, f"{tmp_path}/a", f"{tmp_path}/sa").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3
    assert spark.read.parquet(f"{tmp_path}/b").count() == 5


def test_ledger_segments_cover_every_batch_once():
    for n in [*range(300), 4095, 4096, 4097, 70_000]:
        spans = [(i * SR.FAN**level, (i + 1) * SR.FAN**level) for level, i in SR.ledger_segments(n)]
        covered = sorted(spans)
        assert [s for s, _ in covered] == [0, *[e for _, e in covered[:-1]]][: len(covered)]
        assert (covered[-1][1] if covered else 0) == n
    assert len(SR.ledger_segments(10**6)) < SR.FAN * 6


def test_ledger_is_compacted_and_forgets_nothing(spark, tmp_path, tables, monkeypatch):
    monkeypatch.setattr(SR, "FAN_BITS", 1)
    monkeypatch.setattr(SR, "FAN", 2)
    folder, opened = str(tmp_path / "in"), []
    segments = SR.ledger_segments
    monkeypatch.setattr(SR, "ledger_segments", lambda n: opened.append(len(segments(n))) or segments(n))
    for i in range(9):  # one file is one batch; each repeats the first delivery and an old one
        rows = [event(0, body(sha="s1")), event(i, body(sha="s1")), event(i // 2, body(sha="s1")), event(50 + i, body(pr=2, sha="s2"))]
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, tmp_path, tables)
    assert max(opened) <= 4 < 8  # segments, of up to eight earlier batches
    # every id was handled once
    ledger = f"{tmp_path}/state-handled"
    ids = [r["event_id"] for level, i in segments(9) for r in spark.read.schema(SR._LEDGER).parquet(SR._segment(ledger, level, i)).collect()]
    assert set(ids) == {*range(9), *range(50, 59)}
    handled = [spark.read.parquet(p).count() for p in sorted(glob.glob(f"{ledger}/level-0/*"))]
    assert len(handled) == 9 and os.path.isdir(f"{ledger}/level-3/segment-0")
    reports = spark.read.parquet(f"{tmp_path}/out")
    # one report a batch for each change with a delivery not handled before
    assert reports.filter("pr = 2").count() == 9 and reports.filter("pr = 1").count() == 9


def flaky(folder, always=()):
    """A review that fails the first time it sees a text, and always for some."""

    def review(code):
        if any(a in code for a in always):
            raise RuntimeError("no such luck")
        mark = os.path.join(folder, hashlib.sha256(code.encode()).hexdigest())
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("quota")
        return [(1, "minor", "looked at")]

    return W.text_analyzer(review, "flaky")


def test_failed_files_are_tried_again_and_end(spark, tmp_path):
    diff = "diff --git a/a.java b/a.java\n+x == null\ndiff --git a/b.java b/b.java\n+null\ndiff --git a/c.java b/c.java\n+null"
    diffs = spark.createDataFrame([("o/r", 1, diff)], "repo string, pr long, diff_text string")
    texts = {"a.java": "null a", "b.java": "null never", "c.java": "null c"}
    files = spark.createDataFrame([("o/r", p, "s1", t) for p, t in texts.items()], "repo string, path string, ref string, code string")
    marks = str(tmp_path / "marks")
    os.mkdir(marks)
    analyzers = [W.rule_analyzer(), flaky(marks, ["never"])]
    folder, out = str(tmp_path / "in"), f"{tmp_path}/out"
    frame(spark, [event(0, body(sha="s1"))]).coalesce(1).write.parquet(folder)
    SR.review_stream(source(spark, folder), diffs, files, scorer, analyzers, SECRET, out, f"{tmp_path}/state").awaitTermination()

    def issues():
        return {r["filename"]: sorted(i["source"] for i in r["issues"]) for r in SR.read_stream_reports(spark, out, retried=True).collect()}

    def again(later=files):
        SR.retry_stream(spark, later, analyzers, out, f"{tmp_path}/retry", attempts=3).awaitTermination()

    def dead():
        return [(r["filename"], r["attempt"], r["gone"]) for r in spark.read.parquet(f"{out}-dead").collect()]

    again(files.filter("path != 'c.java'"))
    first = issues()
    assert "flaky" in first["a.java"] and "flaky" not in first.get("b.java", []) and "flaky" not in first.get("c.java", [])
    assert dead() == [("c.java", 1, True)]
    again()
    assert dead() == [("c.java", 1, True)]
    again()
    assert sorted(dead()) == [("b.java", 3, False), ("c.java", 1, True)]
    again()
    assert len(dead()) == 2 and issues() == first
