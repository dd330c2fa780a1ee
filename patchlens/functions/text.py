"""Line, word and keyword features of a text column.

Everything here is local to one row: no helper adds a shuffle. Counts that can be
written as one regular-expression pass are, so that they stay in generated
code; only line-length spread and entropy walk an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions import constants as K


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count_pattern(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a regular expression."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_words(text: Column, words: Iterable[str]) -> Column:
    """Sum over the words of their non-overlapping substring counts.

    No word boundaries: "throws" counts for "throw" and for "throws". A word's count
    is what a text loses in bytes when the word is taken out.
    """

    def one(word: str) -> Column:
        lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
        return F.when(F.contains(text, F.lit(word)), lost / len(word.encode())).otherwise(F.lit(0)).cast("long")

    return reduce(add, [one(w) for w in words]).cast("long")


def _only_newlines(text: Column) -> Column:
    """No other line break than the newline occurs, as in almost all source files."""
    return ~reduce(lambda a, b: a | b, [F.contains(text, F.lit(ch)) for ch in K.BREAK_CHARS if ch != "\n"])


def split_lines(text: Column) -> Column:
    """The lines of a text; a final break adds no line, empty text has none."""
    text = or_empty(text)
    final_break = (
        F.when(F.endswith(text, F.lit("\r\n")), 2)
        .when(F.right(text, F.lit(1)).isin(*K.BREAK_CHARS), 1)
        .otherwise(0)
    )
    body = F.substring(text, F.lit(1), F.char_length(text) - final_break)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(_only_newlines(text), F.split(body, "\n", -1))
        .otherwise(F.split(body, K.LINE_BREAK, -1))
    )


def line_count(text: Column) -> Column:
    """``size(split_lines(text))`` without finding out about the last line twice."""
    text = or_empty(text)
    open_line = (text != "") & ~F.right(text, F.lit(1)).isin(*K.BREAK_CHARS)
    breaks = F.when(_only_newlines(text), (F.size(F.split(text, "\n", -1)) - 1).cast("long")).otherwise(
        count_pattern(text, K.LINE_BREAK)
    )
    return breaks + open_line.cast("long")


def lines_starting(text: Column, pattern: str) -> Column:
    """Number of lines that start with a regular expression."""
    return count_pattern(or_empty(text), rf"(?:\A|{K.LINE_BREAK})(?:{pattern})")


def count_lines(text: Column, test: Callable[[Column], Column]) -> Column:
    """Number of lines for which a test holds."""
    return F.size(F.filter(split_lines(text), lambda line: test(line))).cast("long")


def words(text: Column, min_length: int = 1) -> Column:
    """All maximal runs of word characters, in order."""
    pattern = rf"{K.WORD_CHAR}+" if min_length == 1 else rf"{K.WORD_CHAR}{{{min_length},}}"
    return F.regexp_extract_all(or_empty(text), F.lit(pattern), F.lit(0))


def _with_runs(tokens: Column, result) -> Column:
    """``result(sorted tokens, start positions of the runs of equal tokens)``.

    Sorting and measuring runs counts the words of a text in place: no shuffle,
    and n log n for very long texts. transform over a one-element array binds
    a value to a name, so that it is computed once.
    """

    def starts(a: Column) -> Column:
        at = F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(a) - 1))
        return F.filter(at, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))

    bound = F.transform(
        F.array(F.sort_array(tokens)), lambda a: F.get(F.transform(F.array(starts(a)), lambda s: result(a, s)), 0)
    )
    return F.get(bound, 0)


def _run_length(a: Column, s: Column, j: Column) -> Column:
    return (F.coalesce(F.get(s, j + 1), F.size(a)) - F.get(s, j)).cast("long")


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of tokens, in term order."""
    return _with_runs(
        tokens,
        lambda a, s: F.transform(
            s, lambda at, j: F.struct(F.get(a, at).alias("term"), _run_length(a, s, j).alias("tf"))
        ),
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the case-sensitive words; 0 without words."""

    def bits(a: Column, s: Column) -> Column:
        n = F.size(a).cast("double")
        runs = F.transform(s, lambda at, j: _run_length(a, s, j).cast("double"))
        # a word that occurs once adds nothing
        weighted = F.aggregate(
            runs, F.lit(0.0), lambda total, tf: F.when(tf > 1, total + tf * F.log2(tf)).otherwise(total)
        )
        return F.when(n > 0, F.log2(n) - weighted / n).otherwise(0.0)

    # a text of one repeated word can come out a rounding step below zero
    return F.greatest(_with_runs(words(text), bits), F.lit(0.0))


def line_stddev(text: Column) -> Column:
    """Sample deviation of the line lengths; 0 without lines, NULL for one line."""
    moments = F.transform(
        F.array(F.transform(split_lines(text), lambda l: F.char_length(l).cast("double"))),
        lambda a: F.struct(
            F.size(a).alias("n"),
            a.alias("a"),
            F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)).alias("mean"),
        ),
    )
    value = F.transform(
        moments,
        lambda m: F.when(m["n"] == 0, 0.0).when(
            m["n"] > 1,
            F.sqrt(
                F.aggregate(m["a"], F.lit(0.0), lambda s, x: s + (x - m["mean"]) * (x - m["mean"]))
                / (m["n"] - 1)
            ),
        ),
    )
    return F.get(value, 0)


def basic_features(text: Column) -> dict[str, Column]:
    """The three features of the live scoring path; NULL text gives zeros."""
    text = or_empty(text)
    return {
        "num_lines": line_count(text),
        "num_chars": F.char_length(text).cast("long"),
        "keyword_count": count_words(F.lower(text), K.KEYWORDS),
    }


def _has_comment_mark(line: Column) -> Column:
    return F.contains(line, F.lit("//")) | F.contains(line, F.lit("/*"))


def rich_features(text: Column) -> dict[str, Column]:
    """The eleven text features of the richer generations."""
    text = or_empty(text)
    low = F.lower(text)
    return {
        "num_lines": line_count(text),
        "num_chars": F.char_length(text).cast("long"),
        "keyword_count": count_words(low, K.EXTENDED_KEYWORDS),
        "control_count": count_words(low, K.CONTROL_WORDS),
        "exception_count": count_words(low, K.EXCEPTION_WORDS),
        "method_calls": count_pattern(text, rf"{K.WORD_CHAR}[{K.SPACE_CLASS}]*+\("),
        "comment_ratio": count_lines(text, _has_comment_mark) / (line_count(text) + F.lit(1e-5)),
        "suspicious_count": count_words(low, K.SUSPICIOUS_WORDS),
        "line_stddev": line_stddev(text),
        "buggy_api_count": count_words(low, K.RISKY_API_WORDS),
        "entropy": entropy(text),
    }


def metadata_features(snippet: Column, path: Column, message: Column) -> dict[str, Column]:
    """Commit message and path features; NULL inputs count as empty."""
    message, path = or_empty(message), or_empty(path)
    flagged = reduce(lambda a, b: a | b, [F.contains(F.lower(message), F.lit(w)) for w in K.MESSAGE_FLAG_WORDS])
    return {
        "msg_length": F.char_length(message).cast("long"),
        "has_bug_keyword": flagged.cast("long"),
        "path_depth": count_pattern(path, r"[/\\]"),
        "snippet_length": F.char_length(or_empty(snippet)).cast("long"),
    }


def project_name(url: Column) -> Column:
    """Last path segment of a repository address without ".git"."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".git"), F.lit(""))


def mentions_any(text: Column, needles: Iterable[str]) -> Column:
    """Lower-cased text contains any of the words (substrings: "prefix" has "fix")."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in needles])


def has_suffix(path: Column, suffixes: Iterable[str] = K.LANGUAGE_SUFFIXES) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(path, F.lit(s)) for s in suffixes])


def lint_count(text: Column, patterns: Iterable[str] = K.LINT_PATTERNS) -> Column:
    """Lint hits over the whole text, context and removed lines included."""
    return reduce(add, [count_pattern(or_empty(text), p) for p in patterns])


def added_loc(diff: Column) -> Column:
    return lines_starting(diff, r"\+(?!\+\+)")


def removed_loc(diff: Column) -> Column:
    return lines_starting(diff, r"-(?!--)")
