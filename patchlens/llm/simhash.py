"""Near-duplicate texts by SimHash, joined in the space of segment bit counts.

A 64-bit fingerprint is read as 32 segments of two bits. The number of set bits of each
segment makes a point; the Manhattan distance of two points is never more than the number
of differing bits, so a range join of the points finds every pair of close fingerprints.

The grid has the points' exact coordinates as cells. Coordinates are dealt to groups, one
for each allowed differing bit and as many again: points at distance 3 or less differ in
at most 3 of 6 groups and so share the cell of some other three. Every fingerprint stands
in one cell per choice of three groups. Inside a cell pairs are first held against the
Manhattan distance, then against the exact number of differing bits, and only a spanning
forest of the links leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm import shingles
from patchlens.llm.common import SPACED, connected_components, free_name, word_lists
from patchlens.session import materialize

SEED = 42
BITS = 64
SEGMENTS = 32  # of two bits
EVEN = 0x5555555555555555
CELL_ROWS = 32_768  # fingerprints of a cell that one task compares at once; larger cells are dealt in parts
PART = 65_536  # shingles hashed at once


def simhash(data: bytes | None, width: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number."""
    ones, total, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_lists(data or b"", SPACED):
        words = tail + words
        for at in range(0, len(words) - width + 1, PART):
            part = words[at : at + PART + width - 1]
            ones += _set_bits(map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)))
        total += max(0, len(words) - width + 1)
        tail = words[-(width - 1) :] if width > 1 else []
    if not total:
        if not tail:
            return 0
        ones, total = _set_bits([b" ".join(tail)]), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _set_bits(shingles) -> np.ndarray:
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8)
    return np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, print) of every row. A null, empty or blank text has print 0; a null id stays null."""

    def run(batches):
        for batch in batches:
            prints = [simhash(data, width) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return source.mapInArrow(run, "doc_id long, print long")


def segment_counts(value: Column) -> Column:
    """Bit counts of the two-bit segments, each written as 00, 01 or 11.

    In this form the Manhattan distance of two points is the number of differing bits.
    """
    half = F.shiftrightunsigned(value, 1)
    some = value.bitwiseOR(half).bitwiseAND(F.lit(EVEN))
    both = value.bitwiseAND(half).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _counts_of(x: np.ndarray) -> np.ndarray:
    even, half = np.uint64(EVEN), x >> np.uint64(1)
    return ((x | half) & even) | ((x & half & even) << np.uint64(1))


def cell_masks(radius: int) -> list[int]:
    """Bits of the segments in each choice of ``radius`` out of twice as many groups."""
    groups = [0] * (2 * radius)
    for segment in range(SEGMENTS):
        groups[segment * len(groups) // SEGMENTS] |= 3 << (2 * segment)
    masks = [sum(chosen) for chosen in combinations(groups, radius)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what closeness connects among distinct uint64 fingerprints.

    A pivot is linked with all that is near it, until every fingerprint is near a pivot.
    Fingerprints that are still apart are then compared with all others, in blocks.
    """
    points = _counts_of(x)
    label, ends = np.arange(len(x)), []

    def near(i, j) -> np.ndarray:
        within = np.bitwise_count(points[i] ^ points[j]) <= radius  # Manhattan distance, a lower bound
        return within & (np.bitwise_count(x[i] ^ x[j]) <= radius)

    def link(p: int, others: np.ndarray) -> None:
        fresh = others[label[others] != label[p]]
        if not len(fresh):
            return
        _, first = np.unique(label[fresh], return_index=True)
        ends.extend((p, int(o)) for o in fresh[first])
        label[np.isin(label, label[fresh])] = label[p]

    free = np.ones(len(x), bool)
    for p in range(len(x)):
        if free[p]:
            close = np.flatnonzero(near(p, slice(None)))
            free[close] = False
            link(p, close)
    if len(x) > 2 and (label != label[0]).any():
        for at in range(0, len(x), 512):
            rows = np.arange(at, min(at + 512, len(x)))
            apart = label[rows, None] != label[None, :]
            for r in rows[apart.any(axis=1)]:
                others = np.flatnonzero(label != label[r])
                link(int(r), others[near(int(r), others)])
    a, b = np.array(ends, np.int64).reshape(-1, 2).T
    return x[a], x[b]


def _scan_cells(radius: int, limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, x) sorted by key to links (key, a, b); b is null for members of cells above ``limit``."""

    def run(batches):
        key, held, count = None, [], 0  # the cell that may go on in the next batch

        def close():
            if count > 1 and held:
                yield from links(key, np.unique(np.concatenate(held)))

        def links(k, x):
            a, b = forest(x, radius)
            if len(a):
                yield batch_of(np.full(len(a), k), a, b)

        def batch_of(k, a, b):
            second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a.view(np.int64)), second], ["key", "a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            xs = batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            ends = np.append(starts[1:], len(keys))
            two = (ends - starts == 2) & (starts > 0) & (ends < len(keys))
            a, b = xs[starts[two]], xs[starts[two] + 1]
            hit = (np.bitwise_count(_counts_of(a) ^ _counts_of(b)) <= radius) & (np.bitwise_count(a ^ b) <= radius)
            hit &= a != b
            if hit.any():
                yield batch_of(keys[starts[two]][hit], a[hit], b[hit])
            alone = (ends - starts == 1) & (starts > 0) & (ends < len(keys))
            for s, e in zip(starts[~(two | alone)].tolist(), ends[~(two | alone)].tolist(), strict=True):
                if key != keys[s]:
                    yield from close()
                    key, held, count = int(keys[s]), [], 0
                held.append(xs[s:e])
                count += e - s
                if limit and count > limit:
                    members = np.concatenate(held)
                    yield batch_of(np.full(len(members), key), members, None)
                    held = []
        yield from close()

    return run


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``print``) within ``radius`` differing bits.

    Equal fingerprints count once. A cell with more than ``CELL_ROWS`` members is dealt in
    parts, and every pair of parts goes to a task of its own.
    """
    codes = prints.select("print").dropna().distinct().withColumn("code", segment_counts(F.col("print")))
    cells = [F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(m))) for i, m in enumerate(cell_masks(radius))]
    placed = codes.select(F.explode(F.array(*cells)).alias("key"), F.col("print").alias("x"))
    ordered = placed.repartition("key").sortWithinPartitions("key", "x")
    found = materialize(ordered.mapInArrow(_scan_cells(radius, CELL_ROWS), "key long, a long, b long"), "simhash-cells")

    large = found.filter("b IS NULL")
    parts = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / CELL_ROWS).alias("parts"))
    dealt = large.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = dealt.select(pair.alias("key"), F.col("a").alias("x")).repartition("key").sortWithinPartitions("key", "x")
    more = rest.mapInArrow(_scan_cells(radius, None), "key long, a long, b long")
    return found.filter("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, print, component_id) of every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable by links, the row's own included. A null or empty text has print 0
    and is linked like any other. Rows with a null id are compared as well and keep their
    null id; a group of such rows alone has a null component. Repeated rows stay repeated.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    groups = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    labels = connected_components(near_links(prints, radius)).withColumnRenamed("node", "print")
    rooted = groups.join(labels, "print", "left").withColumn("root", F.coalesce("root", "print"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, similarity: Fraction | None = None
) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays, once.

    Texts are linked by fingerprints and, with a ``similarity``, also if their sets of
    five-word runs are as similar. Rows are told apart by id and a hash of the text, so an id
    that stands for several texts loses only those that are near another; of equal rows one
    stays. Rows with a null id stay. Null, empty and blank texts have fingerprint 0 and are one
    group. A very long text is hashed in parts. An empty table gives no rows. All columns of
    ``docs`` are returned, which may have any names.
    """

    def run(batches):
        for batch in batches:
            prints = [simhash(data, width) for data in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints, pa.int64())], ["doc_id", "mark", "print"])

    key, mark = F.col(id_col).cast("long"), F.xxhash64(text_col)
    source = docs.select(key.alias("doc_id"), mark.alias("mark"), F.col(text_col).cast("binary").alias("data"))
    rows = materialize(source.mapInArrow(run, "doc_id long, mark long, print long"), "simhash-rows")
    reps = rows.groupBy("print").agg(F.min("mark").alias("rep"))
    ends = near_links(rows, radius).join(reps.select(F.col("print").alias("a"), F.col("rep").alias("u")), "a")
    ends = ends.join(reps.select(F.col("print").alias("b"), F.col("rep").alias("v")), "b")
    links = rows.join(reps, "print").select(F.col("mark").alias("a"), F.col("rep").alias("b")).filter("a != b")
    links = links.unionByName(ends.select(F.col("u").alias("a"), F.col("v").alias("b")))
    if similarity is not None:
        links = links.unionByName(shingles.similar_links(source.select("mark", "data"), similarity=similarity))
    labels = connected_components(links).withColumnRenamed("node", "mark")

    named = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    named = named.join(labels, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    firsts = named.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    found = named.join(firsts, "root").withColumn("stays", F.struct("doc_id", "mark") == F.col("first"))
    near_id, near_mark, stays = (free_name(docs.columns, f"_near_{c}") for c in ("id", "mark", "stays"))
    found = found.filter("NOT stays OR n > 1").select(F.col("doc_id").alias(near_id), F.col("mark").alias(near_mark), F.col("stays").alias(stays))
    found = materialize(found, "simhash-groups")
    same = (F.col(id_col).cast("long") == F.col(near_id)) & (F.xxhash64(text_col) == F.col(near_mark))
    kept = docs.join(found, same, "left_anti")
    once = docs.join(found.filter(F.col(stays)), same, "inner").dropDuplicates([near_id, near_mark])
    return kept.unionByName(once.select(*docs.columns))
