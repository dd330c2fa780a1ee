"""Findings, responses, reports, vectors and the TF-IDF score."""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.functions.signing import hmac_sha256, is_authentic
from patchlens.operators import embeddings as E
from patchlens.operators import reports as R
from patchlens.operators import review as W
from patchlens.operators.textstats import tfidf_risk

ONE = '[{"line": 3, "severity": "major", "message": "m"}]'


@pytest.mark.parametrize(
    "response, lines",
    [
        (ONE, [3]),
        (f"Sure:\n```json\n{ONE}\n```\nbye", [3]),
        ("[]", []),
        ("", []),
        (None, []),
        (f"see [1] then {ONE}", []),
        (f"{ONE} and [2]", []),
        ('[{"line": 4, "severity"', []),
        ('[{"line": "12"}, {"message": "no line"}]', [12, None]),
        ('[{"line": "about 5", "severity": "critical"}]', [None]),
        ('[1, {"line": 2}]', []),
        ("[null]", []),
        ("[{'line': 1}]", []),
        ('{"line": 1}', []),
        ("nothing to report", []),
    ],
)
def test_parse_response(spark, response, lines):
    df = spark.createDataFrame([(response,)], "r string")
    found = df.select(W.parse_response(F.col("r")).alias("f")).first()["f"]
    assert [f["line"] for f in found] == lines
    assert all(f["source"] == "LLM" for f in found)


def test_lint_findings(spark):
    code = "x == null\nok\n// TODO print(a)\r\nprint(\n)"
    df = spark.createDataFrame([("f", code), ("g", ""), ("h", None)], "file_id string, code string")
    rows = [(r["file_id"], r["line"], r["message"]) for r in W.lint_lines(df).collect()]
    assert rows == [
        ("f", 1, "matches null"), ("f", 1, "matches =="), ("f", 3, "matches TODO"),
        ("f", 3, r"matches print\([^\n]*\)"),
    ]


def test_analyzers_are_combined_in_order(spark):
    files = spark.createDataFrame([("a", "null"), ("b", "ok"), ("c", "ok")], "file_id string, code string")
    answers = spark.createDataFrame([("a", ONE), ("b", ONE), ("zzz", ONE)], "file_id string, response string")

    def custom(frame):
        def batches(parts):
            for part in parts:
                yield part[["file_id"]].assign(findings=[[{"line": 9, "severity": "info", "message": "x", "source": "own"}]] * len(part))

        return frame.mapInPandas(batches, f"file_id string, findings {W.FINDINGS_DDL}")

    found = W.run_analyzers(files, [W.rule_analyzer(), W.response_analyzer(answers), custom])
    rows = {r["file_id"]: [(f["source"], f["line"]) for f in r["findings"]] for r in found.collect()}
    assert rows == {
        "a": [("Checkstyle", 1), ("LLM", 3), ("own", 9)], "b": [("LLM", 3), ("own", 9)], "c": [("own", 9)],
    }


def test_a_failing_file_stops_no_other(spark):
    def length_rule(code):
        if "poison" in code:
            raise ValueError("no such luck")
        return [(len(code), "major", "length")]

    files = spark.createDataFrame([("a", "x"), ("b", "poison"), ("c", None)], "file_id string, code string")
    found = {r["file_id"]: r for r in W.text_analyzer(length_rule, "own")(files).collect()}
    assert [tuple(f) for f in found["a"]["findings"]] == [(1, "major", "length", "own")]
    assert found["b"]["findings"] == [] and "no such luck" in found["b"]["failure"]
    assert found["c"]["findings"][0]["line"] == 0 and found["c"]["failure"] is None
    both = W.run_analyzers(files, [W.text_analyzer(length_rule, "own"), W.rule_analyzer()])
    assert {r["file_id"]: len(r["findings"]) for r in both.collect()} == {"a": 1, "b": 0, "c": 1}


def test_two_rows_for_a_file_are_an_error(spark):
    files = spark.createDataFrame([("a", "x")], "file_id string, code string")
    twice = lambda f: W.rule_analyzer()(f).union(W.rule_analyzer()(f))
    with pytest.raises(Exception, match="two rows"):
        W.run_analyzers(files, [twice]).collect()


def test_reports_move_no_text(spark):
    flags = spark.createDataFrame([("r", 1, "s", 0, "a.java")], "repo string, pr long, head_sha string, pos int, filename string")
    files = spark.createDataFrame([("r", "a.java", "s", "null")], "repo string, path string, ref string, code string")
    rid = flags.select(R.report_id(*[F.col(k) for k in R.FLAG_KEYS])).first()[0]
    answers = spark.createDataFrame([(rid, ONE)], "file_id string, response string")
    built = R.build_reports(flags, files, [W.rule_analyzer(), W.response_analyzer(answers)])
    assert [(i["source"], i["line"]) for i in built.first()["issues"]] == [("Checkstyle", 1), ("LLM", 3)]
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_severities(spark):
    values = ["error", "fatal", "warning", None, "critical", "major", "minor"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    rows = df.select(W.map_severity(F.col("s")), W.normalized_severity(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["major", "major", "minor", "minor", "minor", "minor", "minor"]
    assert [r[1] for r in rows] == ["major", "major", "minor", "minor", "critical", "major", "minor"]


def test_prompt_holds_the_whole_code(spark):
    code = "x" * 9000 + " {code} \\1 $0"
    prompt = W.review_prompts(spark.createDataFrame([(code,)], "code string")).first()["prompt"]
    assert code in prompt and prompt.startswith(W.REVIEW_TEMPLATE.split("{code}")[0])


def reports(spark, limit):
    triaged = spark.createDataFrame(
        [("r", 1, "s", 0, "a.java", 1), ("r", 1, "s", 1, "b.java", 1), ("r", 1, "s", 2, "c.java", 0),
         ("r", 1, "s", 3, "gone.java", 1), ("r", 1, "s", 4, "void.java", 1), ("r", 1, "s", 5, "a.java", 1)],
        "repo string, pr long, head_sha string, pos int, filename string, risky int",
    )
    files = spark.createDataFrame(
        [("r", "a.java", "s", "x == null"), ("r", "b.java", "s", "fine"), ("r", "c.java", "s", "null"),
         ("r", "void.java", "s", ""), ("r", "a.java", "old", "null null")],
        "repo string, path string, ref string, code string",
    )
    return R.build_reports(R.flagged(triaged), files, [W.rule_analyzer()], limit)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_reports(spark, limit):
    built = reports(spark, limit)
    rows = sorted(built.collect(), key=lambda r: r["pos"])
    assert [(r["filename"], r["pos"], len(r["issues"]), r["code"]) for r in rows] == [
        ("a.java", 0, 2, "x == null"), ("a.java", 5, 2, "x == null")
    ]
    assert len({r["report_id"] for r in rows}) == 2
    again = {r["report_id"] for r in reports(spark, limit).collect()}
    assert again == {r["report_id"] for r in rows}
    wanted = rows[0]["report_id"]
    assert R.lookup_report(built, wanted).count() == 1 and R.lookup_report(built, "none").count() == 0
    summary = {r["report_id"]: r for r in R.report_summary(built, "https://h").collect()}[wanted]
    assert summary["n_issues"] == 2 and f"https://h/report/{wanted}" in summary["summary"]
    counts = R.severity_counts(built).first()
    assert (counts["critical"], counts["major"], counts["minor"]) == (0, 0, 2)
    assert tuple(R.source_counts(built).first())[1:] == (2, 0)


@pytest.mark.parametrize("secret", ["s", "test-secret", "k" * 64, "long key " * 20, "schlüssel"])
def test_hmac(spark, secret):
    bodies = ["", "{}", '{"a": "é"}', "x" * 500]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r[0] for r in df.select(hmac_sha256(secret, F.col("body"))).collect()]
    assert got == [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_authentic_needs_secret_and_header(spark):
    df = spark.createDataFrame([("b", None), ("b", "sha256=00"), ("b", "sha256=" + hmac.new(b"k", b"b", "sha256").hexdigest())], "body string, sig string")
    assert [r[0] for r in df.select(is_authentic("k", F.col("body"), F.col("sig"))).collect()] == [False, False, True]
    assert not any(r[0] for r in df.select(is_authentic(None, F.col("body"), F.col("sig"))).collect())


def test_tfidf_risk(spark):
    texts = ["null catch x1 x1", "Exception thread words", "no risk here", "", "a b c", "synchronized null NULL words"]
    vocabulary = 7
    docs = [Counter(re.findall(r"(?u)\b\w\w+\b", t.lower())) for t in texts]
    total = sum(docs, Counter())
    kept = sorted(total, key=lambda t: (-total[t], t))[:vocabulary]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in kept}
    raw = []
    for d in docs:
        row = {t: d[t] * idf[t] for t in kept if d[t]}
        norm = math.sqrt(sum(v * v for v in row.values()))
        raw.append(sum(row.get(t, 0) for t in ("null", "catch", "synchronized", "thread", "exception")) / norm if norm else 0.0)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = tfidf_risk(df, "id", "t", vocabulary=vocabulary).orderBy("id").collect()
    assert [r["score"] for r in rows] == pytest.approx([x / max(raw) for x in raw])
    assert [r["label"] for r in rows] == [int(x / max(raw) > 0.5) for x in raw]


def test_tfidf_without_risky_words(spark):
    df = spark.createDataFrame([(1, "calm words"), (2, "more words")], "id int, t string")
    assert all(math.isnan(r["score"]) and r["label"] == 0 for r in tfidf_risk(df, "id", "t").collect())


def test_embeddings(spark):
    tokens = spark.createDataFrame(
        [(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 0.0])], "id int, v array<float>"
    )
    pooled = {r["id"]: r["v"] for r in E.mean_pool(tokens, "id", "v").collect()}
    assert pooled == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    other = spark.createDataFrame([(1, [2.0]), (2, [0.0])], "id int, v array<double>")
    both = {r["id"]: r["v"] for r in E.combine_embeddings([E.mean_pool(tokens, "id", "v"), other], "id", "v").collect()}
    assert np.linalg.norm(both[1]) == pytest.approx(1.0) and len(both[1]) == 3
    assert both[2] == [0.0, 0.0, 0.0]


def test_missing_embeddings_collapse_copies(spark):
    df = spark.createDataFrame([("same",)] * 500 + [("known",), ("new",), (None,)], "t string")
    cache = E.content_key(spark.createDataFrame([("known",)], "t string"), "t")
    missing = E.missing_embeddings(df, "t", cache)
    assert sorted(r["t"] or "" for r in missing.collect()) == ["", "new", "same"]
