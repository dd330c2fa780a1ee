"""Lexical code metrics on small texts with known counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patchlens.functions import code as C
from patchlens.operators import features as X

JAVA = '''package a.b;
import java.util.List;

public class Shop {
    private int total = 0; // if (not counted)
    /* while (neither) { */
    public int add(List<Item> items, int[] prices) throws IOException {
        String text = "if (quoted) { \\" }";
        for (int i = 0; i < prices.length; i++) {
            if (prices[i] > 3 && items != null) {
                total += (int) prices[i];
            } else {
                try {
                    check(items.get(i));
                } catch (Exception e) {
                    throw new RuntimeException(e);
                }
            }
        }
        do { total = total - 1; } while (total > 9);
        return total > 5 ? total : 0;
    }
}
'''


def metrics(spark, *codes):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    return X.code_metrics(df).orderBy("i").collect()


def test_counts(spark):
    m = metrics(spark, JAVA)[0]
    want = {
        "methods": 1, "ifs": 1, "loops": 2, "tries": 1, "catches": 1, "classes": 1, "return_statements": 1,
        "switch_statements": 0, "ternary_expressions": 1, "null_checks": 1, "cast_expressions": 1,
        "array_accesses": 2, "variables": 3, "assignments": 2, "method_invocations": 2, "nesting_depth": 3,
        "complexity": 7, "complexity_without_do": 6, "lines_of_code": 23, "non_empty_lines": 22,
    }
    assert {k: m[k] for k in want} == want


@pytest.mark.parametrize("code", [None, "", "  \n\t\n"])
def test_blank_code_gives_zeros(spark, code):
    m = metrics(spark, code)[0]
    assert all(m[c] == 0 for c in (*X.CODE_VECTOR_20, *X.CONSTRUCTS))


@pytest.mark.parametrize(
    "code, depth",
    [
        ("class A { void m() { x(); } }", 0),
        ("if (a) { while (b) { } }", 2),
        ("for (;;) { } for (int i = 0; i < 3; i++) { if (x) { } }", 2),
        ("} } if (a) { } }", 1),
        ("if (a) x(); { { } }", 0),
        ("try { } finally { switch (x) { } }", 2),
        ("int[] a = { 1, 2 }; if (b) { }", 1),
    ],
)
def test_nesting(spark, code, depth):
    assert metrics(spark, code)[0]["nesting_depth"] == depth


def test_literals_and_comments_are_blank(spark):
    quoted, unclosed = metrics(spark, 'x = "a \\" if (b) {"; // if\n\'"\'; if (c) { }', "if (a) { } /* if (b) { }")
    assert (quoted["ifs"], unclosed["ifs"]) == (1, 1)


def test_halstead(spark):
    m = metrics(spark, "a = b + c * b; foo(a);")[0]
    assert (m["unique_operators"], m["unique_names"], m["vocabulary_size"]) == (2, 4, 6)
    assert m["halstead_volume"] == pytest.approx(6 * 2.584962500721156)


def test_one_character_a_token(spark):
    code = 'if (a != null) { B.c(9x, _d, é, ²); } ++e >>= $ "x" // f'
    df = spark.createDataFrame([(code,)], "code string")
    shape = C.shape(C.tokens(F.col("code")))
    assert df.select(shape).first()[0] == "a(xEp){x.x(0,x,x,0);}OxSz"


def test_metrics_of_random_tokens(spark):
    """Counts over the tokens themselves."""
    rng = random.Random(3)
    some = [*C.SINGLE, *[item for items in C.KINDS.values() for item in items], "x", "_y", "9z", "é", "²", "@", "new", "class", ".", "null", "=="]
    texts = [[rng.choice(some) for _ in range(rng.choice((1, 5, 60)))] for _ in range(300)]
    texts = [[t for t in text if t != "/"] for text in texts]  # two of them are a comment
    for text, m in zip(texts, metrics(spark, *(" ".join(t) for t in texts)), strict=True):
        near = list(zip(["", *text], text, [*text[1:], ""], strict=False))
        assert m["null_checks"] == sum(t in ("==", "!=") and "null" in (a, b) for a, t, b in near)
        assert m["classes"] == sum(t == "class" and a != "." for a, t, _ in near)
        assert m["ternary_expressions"] == sum(t == "?" and a not in ("<", ",") for a, t, _ in near)
        assert m["binary_operations"] == sum(t in C.BINARY_OPERATORS for t in text)
        assert m["complexity"] - m["ternary_expressions"] == 1 + sum(t in ("if", "for", "while", "case", "catch", "&&", "||") for t in text)
        assert m["unique_operators"] == len({t for t in text if t in C.BINARY_OPERATORS})
        assert m["unique_names"] == len({t for t in text if (t[0].isalpha() or t[0] == "_") and t not in C.RESERVED})
