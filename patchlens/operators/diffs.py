"""Unified diffs: parsing, statistics, weak labels, and line differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import added_loc, lint_count, or_empty, removed_loc, split_lines, term_counts

HEADER = "diff --git"


def _sections(diff: Column) -> Column:
    """A diff cut before every header line, as (name, added lines) per section.

    The name is the third blank-separated part of the header without its first
    two characters; a header with fewer parts gives NULL.
    """

    def split_section(lines: Column) -> Column:
        # three leading pluses are dropped even when they are added text
        return F.struct(
            F.coalesce(F.get(lines, 0), F.lit("")).alias("head"),
            F.filter(lines, lambda l: F.startswith(l, F.lit("+")) & ~F.startswith(l, F.lit("+++"))).alias("added"),
        )

    def parse(section: Column) -> Column:
        path = F.get(F.split(section["head"], " ", -1), 2)
        named = F.startswith(section["head"], F.lit(HEADER)) & (F.size(F.split(section["head"], " ", -1)) >= 4)
        content = F.transform(section["added"], lambda l: F.substring(l, F.lit(2), F.char_length(l)))
        return F.struct(
            F.when(named, F.substring(path, F.lit(3), F.char_length(path))).alias("name"),
            F.size(section["added"]).alias("n_added"),
            F.array_join(content, "\n").alias("content"),
        )

    texts = F.split(or_empty(diff), rf"{K.LINE_BREAK}(?={HEADER})", -1)
    # one transform per step, so that each step's result is computed once
    return F.transform(F.transform(F.transform(texts, split_lines), split_section), parse)


def parse_diffs(diffs: DataFrame, text_col: str = "diff_text") -> DataFrame:
    """One row (pos, filename, content) per file section with added lines.

    A section without a usable name takes the last name before it; what comes
    before the first name is dropped. The diff text itself is not carried on.
    Local to each diff: no shuffle, and order inside a diff is kept.
    """
    keys = [c for c in diffs.columns if c != text_col]
    sections = diffs.select(*keys, _sections(F.col(text_col)).alias("_s"))
    inherited = F.transform(
        "_s",
        lambda s, i: s.withField(
            "name",
            F.try_element_at(
                F.filter(F.slice("_s", F.lit(1), i + 1), lambda p: p["name"].isNotNull()), F.lit(-1)
            )["name"],
        ),
    )
    first_nameless = F.exists(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), lambda s: s["name"].isNull())
    # only a diff with a nameless header pays for looking back
    filled = sections.withColumn("_s", F.when(first_nameless, inherited).otherwise(F.col("_s")))
    return (
        filled.select(*keys, F.posexplode_outer("_s").alias("pos", "_f"))
        .filter((F.col("_f.n_added") > 0) & (F.col("_f.name") != ""))
        .select(*keys, "pos", F.col("_f.name").alias("filename"), F.col("_f.content").alias("content"))
    )


def diff_stats(diffs: DataFrame, text_col: str = "diff_text") -> DataFrame:
    text = F.col(text_col)
    return diffs.withColumns({"added_loc": added_loc(text), "removed_loc": removed_loc(text)})


def label_diffs(
    diffs: DataFrame,
    text_col: str = "diff_text",
    patterns: Sequence[str] = K.LINT_PATTERNS,
    max_chars: int = K.MAX_DIFF_CHARS,
) -> DataFrame:
    """Line counts, lint hits and the weak label of each diff.

    Counts use the whole text; only the text that is stored gets shortened.
    """
    text = F.col(text_col)
    counted = diffs.withColumns(
        {
            "added_loc": added_loc(text).cast("int"),
            "removed_loc": removed_loc(text).cast("int"),
            "lint_warnings": lint_count(text, patterns).cast("int"),
        }
    )
    return counted.withColumns(
        {
            "label": (F.col("lint_warnings") > 0).cast("int"),
            text_col: F.substring(text, 1, max_chars),
        }
    )


def line_diff(files: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Lines removed and added between two versions, as a multiset difference.

    The lines of each version are sorted and counted in their row; every copy of a line gets
    its number, and copies that the other version has too cancel out. Lines that only
    moved are no difference. Nothing is shuffled.
    """

    def copies(col: str) -> Column:
        counts = term_counts(split_lines(F.col(col)))
        return F.flatten(F.transform(counts, lambda c: F.transform(F.sequence(F.lit(1), c["tf"].cast("int")), lambda i: F.concat(i.cast("string"), F.lit(":"), c["term"]))))

    def net(left: str, right: str, op: str) -> Column:
        lines = F.transform(F.array_except(left, right), lambda x: F.substr(x, F.instr(x, ":") + 1))
        return F.transform(term_counts(lines), lambda c: F.struct(c["term"].alias("line"), F.lit(op).alias("op"), c["tf"].cast("long").alias("n")))

    sides = files.select(*keys, copies(before).alias("_before"), copies(after).alias("_after"))
    found = F.concat(net("_before", "_after", "removed"), net("_after", "_before", "added"))
    # the outer form keeps Spark from computing the lists a second time to test for empty ones
    return sides.select(*keys, F.inline_outer(found)).filter(F.col("n").isNotNull())
