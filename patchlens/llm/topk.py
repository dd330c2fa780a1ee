"""Exact top-k search by inner product with an impact-ordered index, score at a time.

Vectors are turned into integer components. A block of them holds two posting lists for every
component, of its positive and of its negative values, cut into segments of vectors whose
impact, the absolute value, falls into one quantised level. For a query only the lists whose
sign gives a positive product are read, all components together in descending order of query
weight times impact. What a vector has gathered, plus the largest product that each list may
still hold, is an upper bound of its score. Reading stops only when it is proved that no vector
outside a small set reaches the query's k-th best exact score so far; the vectors of that set
are then scored exactly, negative products included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.operators.joins import sized_join
from patchlens.session import materialize

K = 20
SCALE = 64
BLOCK = 8192  # vectors of a block, fewer if they are wide
CELLS = 1 << 19  # components of a block
LEAST = 64  # vectors of a block, however wide
CHUNK = 512  # queries that a task holds
SPANS = 32  # parts among which the blocks are dealt for a chunk of queries
SPAN_BLOCKS = 64  # blocks of a part at most; then there are more parts
LEVELS = 16  # impact levels of a posting list
ROUND = 1 << 15  # postings read between two looks at the bounds
SHORT = 32  # postings of a segment, on average, from which segments are copied one by one

_NAMES = ["size", "number", "ids", "rows", "kind", "code", "postings", "segments"]
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = "size int, number long, ids array<long>, rows array<long>, kind string, code binary, postings binary, segments binary"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, size, code): ``code`` is floor(scale * x) of every component x, as double.

    Vectors that are null, empty or hold a null, NaN or infinite component have no row. A value
    beyond the range of a long takes its end. ``row`` tells rows of one id apart.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above all
    rows = rows.filter((F.size("v") > 0) & finite)
    return rows.select("row", "vec_id", F.size("v").alias("size"), F.transform("v", lambda x: F.floor(x * scale)).alias("code"))


def impact_segments(x: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Postings (places in the block) and segments (component, sign, impact, start, length) of a block.

    Segments of a list follow each other by descending impact, the largest of their vectors.
    Zeros have no posting.
    """
    place, dim = np.nonzero(x)
    values = x[place, dim]
    impact = np.abs(values.astype(float))
    lists = 2 * dim + (values < 0)
    most = np.zeros(2 * x.shape[1])
    np.maximum.at(most, lists, impact)
    level = np.floor(impact * levels / (most[lists] + 1)).astype(np.int64)
    order = np.lexsort((place, -level, lists))
    lists, level, impact = lists[order], level[order], impact[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(lists) != 0) | (np.diff(level) != 0)]) if len(order) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[starts, len(order)])
    top = np.maximum.reduceat(impact, starts) if len(starts) else np.empty(0)
    sign = np.where(lists[starts] % 2, -1, 1)
    return place[order].astype(np.uint16), np.stack((lists[starts] // 2, sign, top, starts, lengths)).astype(float)


def _pack(size: int, number: int, ids: list, rows: list, x: np.ndarray, index: bool) -> list:
    kind = next(k for k in ("i1", "i2", "i4", "i8") if k == "i8" or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    postings, segments = impact_segments(x) if index else (np.empty(0), np.empty(0))
    return [size, number, ids, rows, kind, x.astype(kind).tobytes(), postings.tobytes(), segments.tobytes()]


def _gather(index: bool):
    """The vectors of a group as one row, with their segments if it is a block."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, number = (k.as_py() for k in key)
        table = table.sort_by("row")
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("code").chunks]).reshape(-1, size)
        values = _pack(size, number, table.column("vec_id").to_pylist(), table.column("row").to_pylist(), x, index)
        return pa.table([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)

    return run


class _Held:
    """Vectors of a packed row."""

    def __init__(self, row: dict):
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
        self.null = np.array([i is None for i in row["ids"]])
        self.rows = np.array(row["rows"], np.int64)
        self.x = np.frombuffer(row["code"], row["kind"]).reshape(len(self.rows), row["size"]).astype(np.int64)
        self.most = int(np.abs(self.x.astype(float)).max())
        # products and their sums of small components are exact in floats of half the size
        self.real = self.x.astype(np.float32 if self.most**2 * row["size"] < 2**24 else float)
        if row["segments"]:
            self.postings = np.frombuffer(row["postings"], np.uint16).astype(np.intp)  # as bincount takes them
            dim, sign, self.impact, start, length = np.frombuffer(row["segments"]).reshape(5, -1)
            self.dim, self.sign = dim.astype(np.int64), sign
            self.start, self.length = start.astype(np.int64), length.astype(np.int64)
            self.last = np.r_[(np.diff(self.dim) != 0) | (np.diff(sign) != 0), True]  # of its list
        else:
            self.postings = None

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond the range of a long they take its end."""
        most = self.most * float(np.abs(q.astype(float)).sum())
        if most < (2**24 if self.real.dtype == np.float32 else 2**53):  # every sum is exact
            return (self.real[at] @ q.astype(self.real.dtype)).astype(np.int64)
        if most < 2**62:
            return self.x[at] @ q
        ends = np.iinfo(np.int64)
        exact = (sum(a * b for a, b in zip(r, q.tolist(), strict=True)) for r in self.x[at].tolist())
        return np.array([min(max(s, ends.min), ends.max) for s in exact], np.int64)


class _Best:
    """The best exact scores of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null, self.row = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def floor(self) -> float:
        return float(self.score[self.k - 1]) if len(self.score) >= self.k else -np.inf

    def add(self, score: np.ndarray, block: _Held, at: np.ndarray) -> None:
        if len(score) > self.k:  # only those that are sorted which may be among the best
            least = max(np.partition(score, -self.k)[-self.k], self.score[-1] if len(self.score) >= self.k else np.iinfo(np.int64).min)
            score, at = score[score >= least], at[score >= least]
        score, ids = np.r_[self.score, score], np.r_[self.id, block.ids[at]]
        null, row = np.r_[self.null, block.null[at]], np.r_[self.row, block.rows[at]]
        order = np.lexsort((row, null, ids, ~score))[: self.k]
        self.score, self.id, self.null, self.row = score[order], ids[order], null[order], row[order]


def search_block(block: _Held, q: np.ndarray, own: int, best: _Best) -> int:
    """Takes the block's vectors that are among the best of a query into ``best``; returns the postings read.

    Row ``own`` takes no part.
    """
    weight = q[block.dim] * block.sign
    some = np.flatnonzero(weight > 0)
    product, last = weight[some] * block.impact[some], block.last[some]
    drop = product - np.where(last, 0.0, np.r_[product[1:], 0.0])  # what is still to come falls by that
    rest = float(product[np.r_[True, last[:-1]][: len(some)]].sum())
    slack = rest * 1e-9 if rest >= 2**52 else 0.0  # sums of doubles are exact below
    order = np.argsort(-product, kind="stable")
    read = np.r_[0, np.cumsum(block.length[some][order])]
    gathered, at, floor = np.zeros(len(block.rows)), 0, best.floor()
    while True:
        possible = gathered + rest + slack >= floor
        if not possible.any():
            return int(read[at])
        if at == len(order) or np.count_nonzero(possible) * len(q) <= read[-1] - read[at]:
            break
        end = max(at + 1, int(np.searchsorted(read, read[at] + ROUND, "right")) - 1)
        now = order[at:end]
        n = block.length[some[now]]
        first = block.start[some[now]]
        if n.sum() >= SHORT * len(n):
            places = np.concatenate([block.postings[s:e] for s, e in zip(first.tolist(), (first + n).tolist(), strict=True)])
        else:
            places = block.postings[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        gathered += np.bincount(places, np.repeat(product[now], n), len(gathered))
        rest = max(0.0, rest - float(drop[now].sum()))
        if not at:  # exact scores of the foremost are a first bound
            foremost = np.argpartition(-gathered, min(2 * best.k, len(gathered)) - 1)[: 2 * best.k]
            seen = np.sort(np.r_[best.score, block.scores(q, foremost[block.rows[foremost] != own])])
            if len(seen) >= best.k:
                floor = max(floor, float(seen[-best.k]))
        at = end
    members = np.flatnonzero(possible & (block.rows != own))
    best.add(block.scores(q, members), block, members)
    return int(read[at])


def _search(k: int):
    """Rows sorted by chunk and part, the chunk of queries before its blocks, to the best of every query."""

    def run(batches: Iterator[pa.RecordBatch]):
        chunk, best = None, []

        def found():
            n = [len(b.score) for b in best]
            if not sum(n):
                return
            ids = [np.concatenate([getattr(b, name) for b in best]) for name in ("id", "null", "score")]
            asked = pa.array(np.repeat(chunk.ids, n), mask=np.repeat(chunk.null, n))
            columns = [pa.array(np.repeat(chunk.rows, n)), asked, pa.array(ids[0], mask=ids[1]), pa.array(ids[2])]
            yield pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                held = _Held(batch.slice(i, 1).to_pylist()[0])
                if held.postings is None:
                    if chunk is not None:
                        yield from found()
                    chunk, best = held, [_Best(k) for _ in held.rows]
                    continue
                for q, own, b in zip(chunk.x, chunk.rows.tolist(), best, strict=True):
                    search_block(held, q, own, b)
        if chunk is not None:
            yield from found()

    return run


def _grouped(codes: DataFrame, counts: DataFrame, rows: Column, index: bool) -> DataFrame:
    """``codes`` in packed rows of about ``rows`` vectors, dealt at random."""
    parts = F.ceil(F.col("n") / rows)
    named = sized_join(codes, counts, ["size"]).withColumn("number", F.pmod(F.xxhash64("row"), parts))
    return named.groupBy("size", "number").applyInArrow(_gather(index), _SCHEMA)


def search(
    vectors: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): the ``k`` best vectors for every vector where ``query`` holds.

    ``query`` is a condition on the column ``vec_id``. The score is the inner product of the
    components floor(``scale`` * x); vectors of different sizes do not meet, and a query does not
    meet its own row. Equal scores go by the smaller id, a null id last. Vectors that are null,
    empty or hold a null or non-finite component take no part. A query with fewer than ``k``
    others gets all of them, one with none has no row. Rows that repeat an id are queries and
    candidates of their own, told apart by ``query_row``. An empty table gives no rows. Other
    columns are not read.

    Chunks of queries go through the blocks of the index in ``SPANS`` parts or more, and the
    best of each part are ranked; no task holds more than a chunk and a block.
    """
    codes = materialize(integer_vectors(vectors, id_col, vector_col, scale), "integer-vectors")
    asked = codes.filter(query)
    wide = F.greatest(F.lit(LEAST), F.least(F.lit(block), F.floor(F.lit(CELLS) / F.col("size"))))
    per_size = materialize(codes.groupBy("size").agg(F.count("*").alias("n")), "vector-sizes")
    per_query = materialize(asked.groupBy("size").agg(F.count("*").alias("n")), "query-sizes")
    index = materialize(_grouped(codes, per_size, wide, True), "impact-index")
    chunks = _grouped(asked, per_query, F.lit(CHUNK), False)

    n_blocks = F.ceil(F.col("b.n") / wide)
    parts = F.greatest(F.least(n_blocks, F.lit(SPANS)), F.ceil(n_blocks / SPAN_BLOCKS))
    sizes = per_size.alias("b").join(per_query.alias("q"), "size")
    sizes = sizes.select("size", parts.alias("parts"), F.ceil(F.col("q.n") / CHUNK).alias("chunks"))
    zero = F.lit(0).cast("long")
    ahead = sized_join(chunks, sizes, ["size"]).withColumn("chunk", F.col("number"))
    ahead = ahead.withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    blocks = sized_join(index, sizes, ["size"]).withColumn("part", F.pmod("number", "parts"))
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    tasks = sizes.agg(F.sum(F.col("parts") * F.col("chunks"))).first()[0] or 1
    order = ["size", "chunk", "part"]
    sent = ahead.unionByName(blocks).repartition(tasks, *order).sortWithinPartitions(*order, F.length("segments") > 0, "number")
    found = sent.select(*_NAMES).mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")
