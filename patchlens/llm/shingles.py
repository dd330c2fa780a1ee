"""Near copies by the Jaccard similarity of their word runs: a prefix-filtered join, then an exact check.

Any order of the shingles gives the same pairs: two sets of similarity ``t`` or more share one
of the first ``size - ceil(t * size) + 1`` shingles of each. Shingles that are common in a sample
of the texts come last, so that few texts meet under a shingle.

Links are wanted that connect what similarity connects, in three rounds. In the first each
text under a shingle meets one pivot, the smallest text of about its size, and is checked against
the two that it meets most: that is linear, and gathers close families of any size. Where texts under a shingle are not connected by then, they
bring their whole sets, in the second round, to the few shingles under which most of them stand,
and all of those that are still apart are compared there. In the third round those meet that
are apart and had none of these shingles in common, under any shingle of their prefixes, if
their sizes and places allow the similarity. So no connection is lost.

Many texts have a shingle in common by chance, the more the more texts there are. A signature,
the parities of a set's shingles in ``SIGNATURE`` buckets, travels with each text: two signatures
differ in no more bits than the sets differ in shingles. Pairs that are too far apart by that are
settled without their sets, and a text leaves each shingle under which all others are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import SPACED, connected_components, word_lists
from patchlens.operators.joins import sized_join
from patchlens.session import materialize

WIDTH = 5  # words of a shingle
SIMILARITY = Fraction(4, 5)
SEED = 42
PART = 65_536  # shingles hashed at once
SIGNATURE = 512  # bits
TEXTS = 256  # whose shingles a task holds at once
GROUP = 4096  # texts under a shingle that one task pairs by signature, or in the third round; there, more are dealt in parts
CELLS = 1 << 22  # shingles of the sets that one task compares in the second round; more are dealt in parts
PIVOTS = 2  # pivots that a text is checked against in the first round
MEETINGS = 2  # shingles to which a text brings its set
SAMPLE, SHARE = 20_000, 16  # the order is counted on that many texts, or on one of SHARE if that is more
COMMON = 200_000  # shingles that are put last


def shingle_set(data: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text; a shorter text is one run, a blank one has none."""
    digest, found, tail, some = xxhash.xxh64_digest, [], [], False
    for words in word_lists(data or b"", SPACED):
        words = tail + words
        for at in range(0, len(words) - width + 1, PART):
            part = words[at : at + PART + width - 1]
            runs = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
            found.append(np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in runs]), np.int64)))
            some = True
        tail = words[-(width - 1) :] if width > 1 else []
    if not some and tail:
        found.append(np.frombuffer(digest(b" ".join(tail), SEED), np.int64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The shingles of a set of which any set as similar has one among its own; ``common`` is sorted."""
    size = len(shingles)
    late = np.zeros(size, np.int64)
    if len(common) and size:
        at = np.searchsorted(common, shingles).clip(max=len(common) - 1)
        late = np.where(common[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, late))][: size - ceil(similarity * size) + 1] if size else shingles


def signature(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each bucket, 64 buckets a long."""
    odd = np.bincount(shingles & (SIGNATURE - 1), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(similarity: Fraction, size, size_b, bits):
    """Whether sizes, and the number of bits in which signatures differ, allow the similarity."""
    up, down = similarity.numerator, similarity.denominator
    return (size + size_b - bits) * (up + down) >= (size + size_b) * (2 * up)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches without the marks that the task has had before."""
    seen: set[int] = set()
    for batch in _cut(batches):
        fresh = []
        for i, mark in enumerate(batch.column(0).to_pylist()):
            if mark not in seen:
                seen.add(mark)
                fresh.append(i)
        if fresh:
            yield batch.take(pa.array(fresh)) if len(fresh) < batch.num_rows else batch


def _may_be(similarity: Fraction, size, pos, size_b, pos_b):
    """Whether sizes, and the places of a shared shingle, allow the similarity."""
    up, down = similarity.numerator, similarity.denominator
    small, large = np.minimum(size, size_b), np.maximum(size, size_b)
    common = np.minimum(size - pos, size_b - pos_b)  # at most, if the shingle is the first shared one
    return (small * down >= large * up) & (common * (up + down) >= (size + size_b) * up)


_ROW = ["key", "size", "pos", "a", "b"]
_MEMBER = ["key", "size", "pos", "mark", "root"]
_ROW_SCHEMA = ", ".join(f"{c} long" for c in _ROW) + ", bits array<long>"


def _batch(key, size, pos, a, b, bits=None) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (key, size, pos, a, b)]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64())) if bits is None else bits], [*_ROW, "bits"])


def _first_round(similarity: Fraction):
    """Rows (key, place, mark, bits) sorted by the first three: pairs (pivot a, text b), and (key, size, pos, a) of keys with several texts.

    ``place`` holds the size of the set and the place of the key in it. One row of a text has
    its signature as ``bits``, which comes out as (size, a, bits).
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held = [np.empty(0, np.int64)] * 3  # the last text and its pivot
        for batch in batches:
            signs = batch.filter(batch.column(3).is_valid())
            if signs.num_rows:
                yield _batch(None, signs.column(1).to_numpy() >> 32, None, signs.column(2).to_numpy(), None, signs.column(3))
            rows = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns[:3], strict=True)]
            again = (rows[0][1:] == rows[0][:-1]) & (rows[2][1:] == rows[2][:-1])  # equal texts
            key, place, mark = rows = [c[np.append(True, ~again)[: len(c)]] for c in rows]
            size, pos = place >> 32, place & 0xFFFFFFFF
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            shared = np.append(False, same) | np.append(same, False)
            firsts = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(key)), 0))
            while True:  # a text too large for its pivot is the pivot of the following ones
                far = size[firsts] * similarity.denominator < size * similarity.numerator
                if not far.any():
                    break
                starts = far & np.append(True, ~(far[:-1] & (firsts[1:] == firsts[:-1])))
                firsts = np.where(far, np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0)), firsts)
            # two texts alone under a key that cannot be similar by it are of no further use
            two = np.flatnonzero(same[1:-1] & ~same[:-2] & ~same[2:]) + 1
            two = two[~_may_be(similarity, size[two], pos[two], size[two + 1], pos[two + 1])]
            shared[two] = shared[two + 1] = False
            if shared.any():
                yield _batch(key[shared], size[shared], pos[shared], mark[shared], None)
            good = (np.arange(len(key)) != firsts) & _may_be(similarity, size, pos, size[firsts], pos[firsts])
            if good.any():
                yield _batch(None, None, None, mark[firsts[good]], mark[good])
            kept = np.unique([firsts[-1], len(key) - 1])
            held = [c[kept] for c in rows]

    return run


def _with_partner(similarity: Fraction, group: int):
    """Rows (key, size, pos, mark, root, bits) sorted by key to those that may be similar to one of another root under their key.

    Of a key with more than ``group`` rows all stay.
    """

    def partners(size, pos, root, bits) -> np.ndarray:
        found = np.zeros(len(size), bool)
        for at in range(0, len(size), 256):
            rows = slice(at, at + 256)
            near = (root[rows, None] != root[None, :]) & _may_be(similarity, size[rows, None], pos[rows, None], size[None, :], pos[None, :])
            i, j = np.nonzero(near)
            for s in range(0, len(i), PART):
                x, y = i[s : s + PART] + at, j[s : s + PART]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                found[x[_signed(similarity, size[x], size[y], apart)]] = True
        return found

    def run(batches: Iterator[pa.RecordBatch]):
        held, passed = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = batch.column(5).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            rows = [*(c.to_numpy() for c in batch.columns[:5]), bits]
            rows = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            key = rows[0]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            last = int(starts[-1])
            kept = np.zeros(len(key), bool)
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                if key[s] == passed or e - s > group:
                    kept[s:e] = True
                elif e - s > 1:
                    kept[s:e] = partners(rows[1][s:e], rows[2][s:e], rows[4][s:e], rows[5][s:e])
            if key[last] == passed or len(key) - last > group:
                kept[last:], passed, held = True, key[last], None
            else:
                held = [c[last:] for c in rows]
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in rows[:5]], _MEMBER)
        if held is not None and len(held[0]) > 1:
            kept = partners(held[1], held[2], held[4], held[5])
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in held[:5]], _MEMBER)

    return run


def apart_links(marks: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts of different roots that connect all that are as similar; one for each root that they join."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flag = np.zeros(len(tokens), bool)
    label, ends = np.unique(roots, return_inverse=True)[1], []
    for p in range(len(sets)):
        if (label == label[0]).all():
            break
        own = ids[starts[p] : starts[p] + sizes[p]]
        flag[own] = True
        both = np.add.reduceat(flag[ids], starts, dtype=np.int64)
        flag[own] = False
        near = both * similarity.denominator >= (sizes + sizes[p] - both) * similarity.numerator
        others = np.flatnonzero(near & (label != label[p]))
        if len(others):
            joined, first = np.unique(label[others], return_index=True)
            ends += [(p, o) for o in others[first]]
            label[np.isin(label, joined)] = label[p]
    i, j = np.array(ends, np.int64).reshape(-1, 2).T
    return marks[i], marks[j]


def _second_round(similarity: Fraction):
    """Rows (key, mark, root, own) sorted by key to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def close():
            rows = {mark: (root, own) for mark, root, own in held}
            if len({root for root, _ in rows.values()}) > 1:
                roots, sets = zip(*rows.values(), strict=True)
                a, b = apart_links(np.array(list(rows), np.int64), np.array(roots, np.int64), list(sets), similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for i, (k, mark, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if k != key:
                    yield from close()
                    key, held = k, []
                held.append((mark, root, batch.column(3)[i].values.to_numpy()))
        yield from close()

    return run


def _across(similarity: Fraction, size, pos, mark, root, *met) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(mark), 256):
        rows = slice(at, at + 256)
        apart = (root[rows, None] != root[None, :]) & (np.arange(len(mark))[rows, None] < np.arange(len(mark))[None, :])
        apart &= _may_be(similarity, size[rows, None], pos[rows, None], size[None, :], pos[None, :])
        for x in met:
            for y in met:
                apart &= (x[rows, None] != y[None, :]) | (x[rows, None] == 0)
        i, j = np.nonzero(apart)
        if len(i):
            yield _pairs_batch(mark[i + at], mark[j])


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = np.sort(np.stack((a, b)), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _third_round(similarity: Fraction):
    """Rows (key, size, pos, mark, root, shingles met in the second round) sorted by key to pairs (a, b) to check."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            rows = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            starts = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])).tolist()
            for s, e in zip(starts, starts[1:], strict=False):
                yield from _across(similarity, *(c[s:e] for c in rows[1:]))
            held = [c[starts[-1] :] for c in rows]
        if held is not None:
            yield from _across(similarity, *held[1:])

    return run


def _dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` by (key, mark) with the keys of ``parts`` (key, parts) dealt so that each pair of parts has a key of its own."""
    dealt = rows.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("mark"), F.col("parts")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.withColumn("key", F.when(F.col("parts") > 1, pair).otherwise(F.col("key"))).drop("parts", "_own", "_other")


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and ranks, the most frequent last, of at most ``COMMON`` shingles of a sample of (mark, data)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(data, width))], ["key"])

    every = max(1, min(SHARE, texts.select("mark").count() // SAMPLE))
    sample = texts.filter(F.pmod("mark", F.lit(every)) == 0).select("data")
    counts = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    rows = counts.orderBy(F.desc("n"), "key").limit(COMMON).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def similar_links(
    texts: DataFrame, width: int = WIDTH, similarity: Fraction = SIMILARITY, group: int = GROUP, cells: int = CELLS, meetings: int = MEETINGS
) -> DataFrame:
    """Links (a, b) that connect all texts whose sets of ``width``-word runs have a Jaccard similarity of ``similarity`` or more.

    ``texts`` has the columns mark (a long that stands for the text) and data (the text's
    bytes). Every link is checked on the whole sets, so none is below ``similarity``; similar
    texts without a link of their own are connected by others. Null, empty and blank texts
    have no shingle and no link. An empty table gives no rows.
    """
    common, rank = common_shingles(texts, width)

    def placed(batches: Iterator[pa.RecordBatch]):
        for batch in _once(batches):
            sets = [shingle_set(data, width) for data in batch.column(1).to_pylist()]
            keys = [prefix(s, common, rank, similarity) for s in sets]
            n = [len(k) for k in keys]
            place = np.repeat(np.array([len(s) for s in sets], np.int64) << 32, n) + np.concatenate([np.arange(k) for k in n])
            columns = [np.concatenate(keys), place, np.repeat(batch.column(0).to_numpy(), n)]
            if len(place):
                first = np.zeros(len(place), bool)  # row of a text, which has its signature
                first[(np.cumsum(n) - n)[np.array(n) > 0]] = True
                values = np.concatenate([signature(s) for s in sets if len(s)])
                offsets = np.append(0, np.cumsum(first) * (SIGNATURE // 64)).astype(np.int32)
                bits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~first))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), bits], ["key", "place", "mark", "bits"])

    rows = texts.select("mark", "data").mapInArrow(placed, "key long, place long, mark long, bits array<long>")
    ordered = rows.repartition("key").sortWithinPartitions("key", "place", "mark")
    first = materialize(ordered.mapInArrow(_first_round(similarity), _ROW_SCHEMA), "shingle-keys")
    # A text is checked against the pivots that it has most shingles in common with.
    pairs = first.filter("key IS NULL AND a != b").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    pairs = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PIVOTS)
    tried = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "shingle-pairs")
    signs = first.filter("bits IS NOT NULL").select(F.col("a").alias("mark"), "size", "bits").dropDuplicates(["mark"])
    signs = materialize(signs, "shingle-signatures")
    near = materialize(_near_pairs(tried, signs, similarity), "shingle-near")
    links = materialize(checked_pairs(near, texts, width, similarity), "shingle-links")

    members = first.filter("key IS NOT NULL").select("key", "size", "pos", F.col("a").alias("mark")).distinct()
    members = _open_keys(members, connected_components(links), tried, "shingle-members")
    signed = members.join(signs.select("mark", "bits"), "mark").select(*_MEMBER, "bits").repartition("key").sortWithinPartitions("key")
    possible = signed.mapInArrow(_with_partner(similarity, group), ", ".join(f"{c} long" for c in _MEMBER))
    members = materialize(possible, "shingle-possible")
    if members.isEmpty():
        return links
    # The shingles with the most texts first: texts of one family mostly agree on them.
    counted = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))
    chosen = counted.groupBy("mark", "root", "size").agg(F.slice(order["key"], 1, meetings).alias("met"))
    chosen = materialize(chosen, "shingle-meetings")
    meeting = chosen.select("mark", "root", "size", F.explode("met").alias("key"))
    total = F.ceil(F.sum("size") * 2 / cells)
    parts = meeting.groupBy("key").agg(total.alias("parts"), F.sum("size").alias("all")).filter(F.col("all") > cells).drop("all")
    # Keys are dealt before the sets are there, so that sets are shuffled once.
    going = _dealt(meeting, parts).groupBy("mark", "root").agg(F.collect_set("key").alias("met"))
    sets = _sets_of(texts, materialize(going, "shingle-sent"), width, "root long, met array<long>")
    sent = sets.select(F.explode("met").alias("key"), "mark", "root", "own")
    ordered = sent.repartition("key").sortWithinPartitions("key")
    met = ordered.mapInArrow(_second_round(similarity), "a long, b long")
    links = materialize(links.unionByName(met).distinct(), "shingle-links")

    members = _open_keys(members.drop("root"), connected_components(links), tried, "shingle-members")
    if members.isEmpty():
        return links
    known = [F.coalesce(F.get("met", i), F.lit(0).cast("long")).alias(f"met{i}") for i in range(meetings)]
    rest = members.join(chosen.select("mark", *known), "mark").select("key", "size", "pos", "mark", "root", *[f"met{i}" for i in range(meetings)])
    parts = rest.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > group)
    parts = parts.select("key", F.ceil(F.col("n") * 2 / group).alias("parts"))
    ordered = _dealt(rest, parts).select(*rest.columns).repartition("key").sortWithinPartitions("key")
    untried = ordered.mapInArrow(_third_round(similarity), "a long, b long").distinct()
    untried = materialize(untried.join(tried, ["a", "b"], "left_anti"), "shingle-pairs")
    untried = materialize(_near_pairs(untried, signs, similarity), "shingle-near")
    if untried.isEmpty():
        return links
    return links.unionByName(checked_pairs(untried, texts, width, similarity))


def _near_pairs(pairs: DataFrame, signs: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) that the signatures (mark, size, bits) allow."""
    for end in ("a", "b"):
        pairs = pairs.join(signs.select(F.col("mark").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    apart = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(SIGNATURE // 64)), F.lit(0).cast("long"))
    return pairs.filter(_signed(similarity, F.col("size_a"), F.col("size_b"), apart)).select("a", "b")


def _open_keys(members: DataFrame, labels: DataFrame, tried: DataFrame, name: str) -> DataFrame:
    """``members`` with their roots, of the keys whose texts are not all connected, as a written table.

    Two texts alone under a key are left out if their pair was tried.
    """
    labels = labels.withColumnRenamed("node", "mark")
    rooted = members.join(labels, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    rooted = materialize(rooted.select("key", "size", "pos", "mark", "root"), name)
    ends = [F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b")]
    mixed = rooted.groupBy("key").agg(*ends).filter("least < most")
    known = mixed.filter("n = 2").join(tried, ["a", "b"], "left_semi").select("key")
    mixed = mixed.select("key").join(known, "key", "left_anti")
    return materialize(rooted.join(mixed, "key").select(*rooted.columns), f"{name}-open")


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int, more: str = "") -> DataFrame:
    """(mark, the further columns of ``wanted``, own): the sets of the texts in ``wanted``, a written table of distinct marks.

    Texts do not move if ``wanted`` is small enough to be sent to them. Copies of a text in
    other partitions give their set again.
    """

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in _once(batches):
            sets = pa.array([shingle_set(data, width) for data in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], sets], names)

    names = ["mark", *[c for c in wanted.columns if c != "mark"], "own"]
    found = sized_join(texts.select("mark", "data"), wanted, ["mark"], count_large=texts.select("mark"))
    schema = ", ".join(filter(None, ["mark long", more, "own array<long>"]))
    return found.select("mark", "data", *names[1:-1]).mapInArrow(whole, schema)


def checked_pairs(pairs: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of marks whose whole sets are as similar."""
    marks = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    sets = _sets_of(texts, materialize(marks, "shingle-marks"), width)
    sets = materialize(sets.dropDuplicates(["mark"]), "shingle-sets")
    sides = pairs.join(sets.select(F.col("mark").alias("a"), F.col("own").alias("x")), "a")
    sides = sides.join(sets.select(F.col("mark").alias("b"), F.col("own").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return sides.filter(both * similarity.denominator >= either * similarity.numerator).select("a", "b")
