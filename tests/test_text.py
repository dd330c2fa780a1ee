"""Line, keyword and word rules on edge texts and random texts."""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions import text as X

EDGE_TEXTS = [
    "", "\n", "a", "a\n", "a\r\nb", "a\n\rb", "\r\r\n", "x\n\n", "\r\n", "a\r",
    "1\x0b2\x0c3\x1c4\x1d5\x1e6\x857\u20288\u20299", "a\x1fb\x00c", "\u2028", "\u00e9\u2029", "x\u00a0(y)",
    "throws finally entry", "elselse throwsthrow", "null == null", "System.exit(1); print(a) print(b)",
    "// only a comment", "/* a */ x", "if (x) { foo (y); }", "größe(x) + имя (y)", "a\u00a0(b)", "a \x1c (b)",
    "print(\r)", "print(\n)", "IF Else TRY", "one two one", "same same same", "café naïve",
]


def python_features(text):
    lines, low = text.splitlines(), text.lower()

    def count(words):
        return sum(low.count(w) for w in words)

    lengths = [len(line) for line in lines]
    words = re.findall(r"\w+", text)
    shares = [n / len(words) for n in Counter(words).values()]
    comments = sum("//" in line or "/*" in line for line in lines)
    return {
        "num_lines": len(lines),
        "num_chars": len(text),
        "keyword_count": count(K.EXTENDED_KEYWORDS),
        "control_count": count(K.CONTROL_WORDS),
        "exception_count": count(K.EXCEPTION_WORDS),
        "method_calls": len(re.findall(r"\w+\s*\(", text)),
        "comment_ratio": comments / (len(lines) + 1e-5),
        "suspicious_count": count(K.SUSPICIOUS_WORDS),
        "line_stddev": 0.0 if not lengths else statistics.stdev(lengths) if len(lengths) > 1 else None,
        "buggy_api_count": count(K.RISKY_API_WORDS),
        "entropy": -sum(p * math.log2(p) for p in shares) + 0.0,
    }


def spark_rows(spark, texts, columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()


def assert_same(texts, rows):
    for text, row in zip(texts, rows, strict=True):
        for name, want in python_features(text).items():
            got = row[name]
            assert got == want or got == pytest.approx(want, abs=1e-9), (text, name, got, want)


def test_rich_features_on_edge_texts(spark):
    assert_same(EDGE_TEXTS, spark_rows(spark, EDGE_TEXTS, X.rich_features(F.col("t"))))


code_text = st.lists(
    st.sampled_from(
        ["if", "else", "throws", "finally", "null", "==", "//", "/*", "(", " ", "\n", "\r\n", "\r", "\x0b", "\x85",
         "\u2028", "\u00a0", "\u2029", "é", "ж", "٣", "_", "x1", "System.exit", "\t", "entry", "INPUTSTREAM"]
    ),
    max_size=30,
).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(code_text, min_size=20, max_size=40))
def test_rich_features_on_random_texts(spark, texts):
    assert_same(texts, spark_rows(spark, texts, X.rich_features(F.col("t"))))


def test_split_lines_is_splitlines(spark):
    rows = spark_rows(spark, EDGE_TEXTS, {"lines": X.split_lines(F.col("t")), "n": X.line_count(F.col("t"))})
    for text, row in zip(EDGE_TEXTS, rows, strict=True):
        assert row["lines"] == text.splitlines(), repr(text)
        assert row["n"] == len(text.splitlines())


def test_null_snippet_gives_zeros(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in X.basic_features(F.col("t")).items()]).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (0, 0, 0)]


def test_lint_counts_follow_python(spark):
    patterns = [r"TODO", r"FIXME", r"null", r"==", r"System\.exit", r"print\(.*\)"]
    texts = [*EDGE_TEXTS, "print(a\r)\nTODO null==null", "print(x) y print(z)\nprint(\u2028)", "systemXexit System.exit"]
    rows = spark_rows(spark, texts, {"n": X.lint_count(F.col("t"))})
    assert [r["n"] for r in rows] == [sum(len(re.findall(p, t)) for p in patterns) for t in texts]


def test_term_counts(spark):
    texts = ["b a b", "", "x", "a a a b"]
    rows = spark_rows(spark, texts, {"terms": X.term_counts(X.words(F.col("t")))})
    assert [[(t["term"], t["tf"]) for t in r["terms"]] for r in rows] == [
        sorted(Counter(t.split()).items()) for t in texts
    ]


def test_very_long_text(spark):
    text = "if (x == null) { return y; }\n" * 40_000
    row = spark_rows(spark, [text], {**X.rich_features(F.col("t")), "lint": X.lint_count(F.col("t"))})[0]
    assert (row["num_lines"], row["lint"], row["method_calls"]) == (40_000, 80_000, 40_000)


def test_metadata(spark):
    df = spark.createDataFrame([("ab", "a/b\\c.java", "Fix it"), ("", None, None)], "s string, p string, m string")
    columns = X.metadata_features(F.col("s"), F.col("p"), F.col("m"))
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [tuple(r) for r in rows] == [(6, 1, 2, 2), (0, 0, 0, 0)]


@pytest.mark.parametrize(
    "url, name",
    [("https://h/o/kit.git", "kit"), ("https://h/o/kit", "kit"), ("kit.git", "kit"), ("https://h/o/a.gitb.git", "ab")],
)
def test_project_name(spark, url, name):
    assert url.split("/")[-1].replace(".git", "") == name
    assert spark.createDataFrame([(url,)], "u string").select(X.project_name(F.col("u"))).first()[0] == name
