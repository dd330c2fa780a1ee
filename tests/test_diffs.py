"""Diff parsing, labels and line differences."""

from __future__ import annotations

import random
import re
from collections import Counter

from patchlens.operators import diffs as D


def expected_sections(text):
    """The contract, section by section."""
    lines = text.splitlines()
    starts = [i for i, line in enumerate(lines) if line.startswith(D.HEADER)]
    found, name = [], ""
    for start, end in zip(starts, [*starts[1:], len(lines)]):
        words = lines[start].split(" ")
        name = words[2][2:] if len(words) > 3 else name
        added = [line.removeprefix("+") for line in lines[start + 1 : end] if re.match(r"\+(?!\+\+)", line)]
        if name and added:
            found.append((name, "\n".join(added)))
    return found


EDGE_DIFFS = {
    "empty": "",
    "no header": "+a\n+b",
    "before header": "+lost\ndiff --git a/x.java b/x.java\n+kept",
    "short header": "diff --git a/x b/x\n+one\ndiff --git broken\n+two\ndiff --git a/y b/y\n+three",
    "only short header": "diff --git x\n+one",
    "blank in path": "diff --git a/my file.java b/my file.java\n+x",
    "nothing added": "diff --git a/x b/x\n-gone\n same",
    "one empty added line": "diff --git a/x b/x\n+",
    "added pluses": "diff --git a/x b/x\n+++i;\n+++ b/x\n+ok",
    "added index": "diff --git a/x b/x\nindex 1..2\n+index here\nindex lost",
    "rename": "diff --git a/old.java b/new.java\nrename from old.java\n+x",
    "crlf": "diff --git a/x b/x\r\n+one\r\n+two\r\ndiff --git a/y b/y\r\n+three\r\n",
    "odd breaks": "diff --git a/x b/x\x0b+one\u2028+two\x85diff --git a/y b/y\x1c+three",
    "empty name": "diff --git a/ b/\n+x\ndiff --git oops\n+y",
    "header text inside": "diff --git a/x b/x\n+ diff --git a/z b/z\n+y\n diff --git q",
    "short name": "diff --git a b c\n+x",
    "two shorts": "diff --git a/x b/x\n+1\ndiff --git\n+2\ndiff --git\n+3",
}


def parsed(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id string, diff_text string")
    out = {key: [] for key in texts}
    for row in D.parse_diffs(df).orderBy("id", "pos").collect():
        out[row["id"]].append((row["filename"], row["content"]))
    return out


def test_parse_edges(spark):
    assert parsed(spark, EDGE_DIFFS) == {k: expected_sections(v) for k, v in EDGE_DIFFS.items()}


def test_parse_random(spark):
    rng = random.Random(7)
    pieces = ["diff --git a/x.java b/x.java", "diff --git", "diff --git a/q r b/q r", "+a", "+", "+++b", "-c", " d",
              "index", "--- a/x", "", "+ diff --git a/n b/n"]
    texts = {
        str(i): "".join(rng.choice(pieces) + rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 25)))
        for i in range(300)
    }
    assert parsed(spark, texts) == {k: expected_sections(v) for k, v in texts.items()}


def test_null_diff(spark):
    df = spark.createDataFrame([("a", None)], "id string, diff_text string")
    assert D.parse_diffs(df).count() == 0


def test_stats_and_labels(spark):
    texts = {**EDGE_DIFFS, "long": "+" + "x" * 6000 + " TODO"}
    df = spark.createDataFrame(list(texts.items()), "id string, diff_text string")
    rows = {r["id"]: r for r in D.label_diffs(df).collect()}
    for key, text in texts.items():
        lines = text.splitlines()
        assert rows[key]["added_loc"] == sum(l.startswith("+") and not l.startswith("+++") for l in lines), key
        assert rows[key]["removed_loc"] == sum(l.startswith("-") and not l.startswith("---") for l in lines), key
    # the hit lies behind the cut but is still counted
    assert rows["long"]["label"] == 1 and len(rows["long"]["diff_text"]) == 5000


def test_line_diff(spark):
    versions = [
        ("moved", "a\nb\nc", "c\nb\na"),
        ("repeated", "x\nx\ny", "x\nz\nz"),
        ("created", None, "n"),
        ("emptied", "o\no", ""),
    ]
    df = spark.createDataFrame(versions, "id string, before string, after string")
    got = {(r["id"], r["op"], r["line"]): r["n"] for r in D.line_diff(df, ["id"], "before", "after").collect()}
    want = {}
    for key, before, after in versions:
        b, a = Counter((before or "").splitlines()), Counter((after or "").splitlines())
        want.update({(key, "removed", l): n for l, n in (b - a).items()})
        want.update({(key, "added", l): n for l, n in (a - b).items()})
    assert got == want


def test_line_diff_stays_in_its_row(spark):
    rows = [(1, "a\nb\nb\n5:c\n", "b\na\nd\nd\n5:c"), (2, None, "x"), (3, "x\nx", ""), (4, "same\nlines", "lines\nsame"), (5, None, None)]
    df = spark.createDataFrame(rows, "k long, before string, after string")
    found = D.line_diff(df, ["k"], "before", "after")
    assert sorted(map(tuple, found.collect())) == [(1, "b", "removed", 1), (1, "d", "added", 2), (2, "x", "added", 1), (3, "x", "removed", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
