"""Passages repeated across documents: found by line hashes, aligned by patience diff, deleted."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import free_name
from patchlens.session import materialize

MIN_WORDS = 20  # of a common block that is deleted
SEED = 42


def line_hashes(data: bytes) -> tuple[list[int], list[int], list[int]]:
    """Hash, number of words and line number of every line of a text that is not blank."""
    hashes, words, numbers = [], [], []
    for number, line in enumerate(data.split(b"\n")):
        parts = line.split()
        if parts:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(parts), SEED) - (1 << 63))
            words.append(len(parts))
            numbers.append(number)
    return hashes, words, numbers


def shortest_runs(words: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest run of lines from each line on that has ``min_words`` words."""
    end = held = 0
    for start, own in enumerate(words):
        while end < len(words) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            return
        yield start, end
        held -= own


def run_hashes(hashes: list[int], words: list[int], min_words: int = MIN_WORDS) -> set[int]:
    """Hashes of the shortest runs of lines with ``min_words`` words."""
    raw = np.array(hashes, np.int64).tobytes()
    runs = shortest_runs(words, min_words)
    return {xxhash.xxh64_intdigest(raw[8 * s : 8 * e], SEED) - (1 << 63) for s, e in runs}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that ascends in both places; ``pairs`` ascend in the first."""
    tails, places, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at:
            back[i] = places[at - 1]
        if at == len(tails):
            tails.append(b)
            places.append(i)
        else:
            tails[at], places[at] = b, i
    chain, i = [], places[-1] if places else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of the aligned lines of two texts.

    Lines that stand once in either text are anchors; the longest chain of them that keeps its
    order splits both texts, equal lines beside an anchor are aligned with it, and what is left
    between is treated alike. Where no line is unique, the first, second, ... of equal lines
    are taken for each other.
    """
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        if not unique:
            out += _by_occurrence(a, a0, a1, b, b0, b1)
            continue
        before = (a0, b0)
        for i, j in [*_increasing(unique), (a1, b1)]:
            work.append((before[0], i, before[1], j))
            before = (i, j)  # the anchor itself is the equal head of the next part
    return sorted(out)


def _by_occurrence(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    seen: Counter = Counter()
    where = {}
    for j in range(b0, b1):
        where[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen, pairs = Counter(), []
    for i in range(a0, a1):
        if (a[i], seen[a[i]]) in where:
            pairs.append((i, where[a[i], seen[a[i]]]))
        seen[a[i]] += 1
    return _increasing(pairs)


def common_blocks(a: list[int], words: list[int], b: list[int], min_words: int = MIN_WORDS) -> list[int]:
    """Places in ``a`` of the lines in common blocks of ``min_words`` words or more.

    Blocks are runs of aligned lines. Lines already found are taken out of ``a`` and the rest
    is aligned again; blocks in so different an order that no alignment has them are then
    looked up by their first lines.
    """
    found: set[int] = set()
    while True:
        left = [i for i in range(len(a)) if i not in found]
        pairs = [(left[i], j) for i, j in patience([a[i] for i in left], b)]
        new, block, held = set(), [], 0
        for k, (i, j) in enumerate(pairs):
            if block and (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1) != (i, j):
                block, held = [], 0
            block.append(i)
            held += words[i]
            if held >= min_words:
                new.update(block)
        if not new:
            break
        found |= new
    size = dict(zip(a, words, strict=True))
    starts = {tuple(b[s:e]): s for s, e in shortest_runs([size.get(x, 0) for x in b], min_words)}
    for s, e in shortest_runs(words, min_words):
        j = starts.get(tuple(a[s:e]))
        if j is not None and not found.issuperset(range(s, e)):
            j += e - s
            while e < len(a) and j < len(b) and a[e] == b[j]:
                e, j = e + 1, j + 1
            found.update(range(s, e))
    return sorted(found)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, lines, n_partners): the lines that each document repeats from an earlier one.

    ``mark`` is a hash of the text and tells rows with one id apart; documents are ordered by id
    and mark. Every run of lines with ``min_words`` words has a hash; such hashes are rare, as
    they stand for a passage and not for a stray line. A document is a partner of the first
    document that has one of its hashes, so a passage in any number of documents costs one
    pair for each; partners are aligned, and the aligned common blocks are the later one's
    repeated lines. Only documents with repeated lines have a row. Rows without an id have
    no place in the order and are left out; blank lines never count.
    """

    def hashed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [line_hashes(data) for data in batch.column(2).to_pylist()]
            runs = [list(run_hashes(h, w, min_words)) for h, w, _ in found]
            columns = [pa.array(c, pa.list_(t)) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array(runs, pa.list_(pa.int64()))], names)

    names = ["doc_id", "mark", "hashes", "words", "numbers", "runs"]
    schema = "doc_id long, mark long, hashes array<long>, words array<long>, numbers array<long>, runs array<long>"
    source = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("data")
    )
    lines = materialize(source.mapInArrow(hashed, schema), "line-hashes")

    runs = lines.select("doc_id", "mark", F.explode("runs").alias("run"))
    firsts = runs.groupBy("run").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = runs.join(firsts.select("run", "first"), "run")
    later = later.filter(F.col("first.doc_id") != F.col("doc_id"))
    pairs = later.groupBy("doc_id", "mark", F.col("first.doc_id").alias("f_id"), F.col("first.mark").alias("f_mark")).agg(F.lit(1).alias("one"))

    own = lines.select("doc_id", "mark", "hashes", "words", "numbers").dropDuplicates(["doc_id", "mark"])
    other = own.select(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark"), F.col("hashes").alias("f_hashes"))
    sides = pairs.join(own, ["doc_id", "mark"]).join(other, ["f_id", "f_mark"])

    def align(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = common_blocks(row["hashes"], row["words"], row["f_hashes"], min_words)
                out.append([row["numbers"][i] for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["doc_id", "mark", "lines"])

    aligned = sides.select("doc_id", "mark", "hashes", "words", "numbers", "f_hashes").mapInArrow(align, "doc_id long, mark long, lines array<long>")
    some = aligned.filter(F.size("lines") > 0)
    return some.groupBy("doc_id", "mark").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.count("*").alias("n_partners")
    )


def delete_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, length_col: str | None = None, drop_empty: bool = True
) -> DataFrame:
    """``docs`` without the blocks of lines that an earlier document has.

    Documents with nothing left are dropped if ``drop_empty``; texts without repeated lines, null
    and empty ones are returned as they are, whatever the number of equal rows, and so are rows
    with a null id. Two rows of one id are no partners of each other. ``length_col`` names a
    column that holds the number of characters and is set anew for texts that change. A very
    long text is one row of its task. Other columns may have any names.
    """
    columns = docs.columns
    key, mark, lines, changed = (free_name(columns, f"_repeated_{c}") for c in ("id", "mark", "lines", "changed"))
    found = repeated_lines(docs, id_col, text_col, min_words)
    found = found.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("lines").alias(lines))
    joined = docs.join(found, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left")
    rest = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col(lines), i.cast("long")))
    out = joined.withColumn(changed, F.col(lines).isNotNull())
    out = out.withColumn(text_col, F.when(F.col(changed), F.array_join(rest, "\n")).otherwise(F.col(text_col)))
    if length_col in columns:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(changed), length).otherwise(F.col(length_col)))
    if drop_empty:
        out = out.filter(~F.col(changed) | (F.trim(F.col(text_col)) != ""))
    return out.select(*columns)
