"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import connected_components
from patchlens.session import materialize

THRESHOLD = 0.95
BLOCK = 4096  # vectors of a sequence interval that is shuffled as one row
LEAF = 512  # vectors of an interval that is compared in full
LEADING = 16  # principal dimensions of the boxes
GRID = 4  # principal dimensions of the grid order
FAN = 8  # intervals under one of the next level
SPAN = 32  # blocks that a task compares with its own
MAX_WIDTH = 4096  # components for which principal axes are computed; wider vectors keep their own axes
BLOCK_CELLS = 1 << 22  # components of a block of wide vectors


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, size, unit): vectors of length 1 in double precision.

    Null, empty and zero vectors, and those with a null, NaN or infinite component, have none.
    Components are divided by the largest one first, so that no square over- or underflows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            some = sizes > 0
            if not some.any():
                continue
            starts = (np.cumsum(sizes) - sizes)[some]
            with np.errstate(all="ignore"):
                largest = np.maximum.reduceat(np.abs(flat), starts)  # NaN if there is one
                flat = flat / np.repeat(largest, sizes[some])
                norm = np.sqrt(np.add.reduceat(flat * flat, starts))
                flat = flat / np.repeat(norm, sizes[some])
            good = np.isfinite(largest) & (largest > 0)
            values = pa.array(flat[np.repeat(good, sizes[some])])
            ids, sizes = pa.compute.filter(batch.column(0), pa.array(some)), sizes[some][good]
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            columns = [pa.compute.filter(ids, pa.array(good)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "size", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "vec_id long, size int, unit array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter lists are filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : e - s] = flat[s:e]
    return out


def principal_axes(units: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes (width x width), the direction of the largest variance first.

    Every task sends the sums of its rows and of their products, one row per dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        total, products, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total, products, n = total + x.sum(axis=0), products + x.T @ x, n + len(x)
        if n:
            lists = pa.FixedSizeListArray.from_arrays(pa.array(products.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(total), lists], ["dim", "n", "total", "products"])

    sums = units.select("unit").mapInArrow(run, "dim long, n long, total double, products array<double>")
    cells = sums.select("dim", "n", "total", F.posexplode("products").alias("other", "p"))
    rows = cells.groupBy("dim", "other").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    products, mean = np.zeros((width, width)), np.zeros(width)
    products[rows["dim"], rows["other"]] = rows["p"] / rows["n"]
    mean[rows["dim"]] = rows["total"] / rows["n"]
    _, axes = np.linalg.eigh(products - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance of boxes; no points in them are nearer."""
    between = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (between * between).sum(axis=-1)


def grid_blocks(units: DataFrame, width: int, axes: np.ndarray | None, threshold: float, block: int) -> DataFrame:
    """(number, ids, sizes, data, low, high): the vectors in epsilon grid order, in numbered blocks.

    Vectors are turned to the principal ``axes``, if given, and sorted by their cells on the leading ones;
    ``low`` and ``high`` bound a block there. A range partition gives chunks of at most ``LEAF``
    vectors, and the chunks of the whole sequence are gathered to blocks of about ``block``.
    """
    lead = min(LEADING, width)
    side = np.sqrt(2 - 2 * threshold) / 2

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = _matrix(batch.column(2), width)
            x = x if axes is None else x @ axes
            cells = np.floor(x[:, : min(GRID, width)] / side).astype(np.int32)
            columns = [pa.array(cells[:, i]) if i < cells.shape[1] else pa.array(np.zeros(len(x), np.int32)) for i in range(GRID)]
            data = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, *columns], names)

    def chunks(batches: Iterator[pa.RecordBatch]):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, LEAF):
                some = batch.slice(at, LEAF)
                ids, sizes, data = (some.column(i).to_pylist() for i in range(3))
                values = [part, before, len(ids), ids, sizes, b"".join(data)]
                before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], chunk_names)

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()
        data = b"".join(r["data"] for r in rows)
        x = np.frombuffer(data).reshape(-1, width)[:, :lead]
        ids, sizes = [i for r in rows for i in r["ids"]], [i for r in rows for i in r["sizes"]]
        values = [key[0].as_py(), ids, sizes, data, x.min(axis=0).tolist(), x.max(axis=0).tolist()]
        return pa.table([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES, strict=True)], _BLOCK_NAMES)

    grid = [f"g{i}" for i in range(GRID)]
    names, chunk_names = ["vec_id", "size", "data", *grid], ["part", "before", "n", "ids", "sizes", "data"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    placed = units.mapInArrow(place, "vec_id long, size int, data binary, " + ", ".join(f"{g} int" for g in grid))
    parts = max(1, ceil(units.count() / block))
    ordered = placed.repartitionByRange(parts, *grid, "data", "vec_id").sortWithinPartitions(*grid, "data", "vec_id")
    schema = "part int, before long, n long, ids array<long>, sizes array<int>, data binary"
    found = materialize(ordered.select("vec_id", "size", "data").mapInArrow(chunks, schema), "vector-chunks")
    # One count per range partition, whatever the number of vectors.
    counts = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n").alias("n")).collect())
    firsts = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    firsts = found.sparkSession.createDataFrame(firsts, "part int, first long")
    numbered = found.join(F.broadcast(firsts), "part").withColumn("start", F.col("first") + F.col("before"))
    numbered = numbered.withColumn("number", F.floor(F.col("start") / block).cast("long"))
    schema = "number long, ids array<long>, sizes array<int>, data binary, low array<double>, high array<double>"
    return numbered.select("number", "start", "ids", "sizes", "data").groupBy("number").applyInArrow(gather, schema)


_BLOCK_NAMES = ["number", "ids", "sizes", "data", "low", "high"]
_BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]


def near_blocks(boxes: DataFrame, count: int, reach: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks (number, low, high) whose boxes are within ``reach``.

    The sequence is a tree of intervals of ``FAN`` intervals each. Beginning with the whole
    sequence and itself, only pairs of intervals that are not provably distant are opened.
    """
    levels = max(0, ceil(log(max(count, 1), FAN) - 1e-9))

    def bounds(level: int) -> DataFrame:
        number = F.floor(F.col("number") / FAN**level).cast("long")
        if not level:
            return boxes.select("number", "low", "high")
        values = boxes.select(number.alias("number"), F.posexplode(F.arrays_zip("low", "high")).alias("d", "v"))
        ends = values.groupBy("number", "d").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high"))
        rows = ends.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("d", "low", "high"))).alias("v"))
        return rows.select("number", F.col("v.low").alias("low"), F.col("v.high").alias("high"))

    def gap(x, y):
        sides = F.zip_with(
            F.arrays_zip(x.low.alias("low"), x.high.alias("high")),
            F.arrays_zip(y.low.alias("low"), y.high.alias("high")),
            lambda p, q: F.greatest(F.lit(0.0), p["low"] - q["high"], q["low"] - p["high"]),
        )
        return F.aggregate(sides, F.lit(0.0), lambda s, d: s + d * d)

    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        under = bounds(level).withColumn("up", F.floor(F.col("number") / FAN).cast("long"))
        left = under.select(F.col("up").alias("a"), F.struct("number", "low", "high").alias("x"))
        right = under.select(F.col("up").alias("b"), F.struct("number", "low", "high").alias("y"))
        opened = pairs.join(left, "a").join(right, "b").filter("x.number <= y.number")
        opened = opened.filter(gap(F.col("x"), F.col("y")) <= reach)
        pairs = materialize(opened.select(F.col("x.number").alias("a"), F.col("y.number").alias("b")), "block-pairs")
    return pairs


class _Block:
    def __init__(self, ids, sizes, data, width):
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int32)
        self.x = np.frombuffer(data).reshape(len(self.ids), width)
        self.lead = min(LEADING, width)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, s: int, e: int):
        if (s, e) not in self.boxes:
            part = self.x[s:e, : self.lead]
            self.boxes[s, e] = part.min(axis=0), part.max(axis=0)
        return self.boxes[s, e]


def join_intervals(a: _Block, b: _Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the linked vectors of two blocks, i < j within one block.

    Intervals are halved until they are provably distant or small enough to be compared.
    """
    reach = 2 - 2 * threshold + 1e-9
    work = [(0, len(a.ids), 0, len(b.ids))]
    while work:
        s, e, t, f = work.pop()
        if same and f <= s or s == e or t == f:
            continue
        if _gap(*a.box(s, e), *b.box(t, f)) > reach:
            continue
        if e - s <= LEAF and f - t <= LEAF:
            near = a.x[s:e] @ b.x[t:f].T >= threshold
            i, j = np.nonzero(near)
            i, j = i + s, j + t
            keep = a.sizes[i] == b.sizes[j]
            if same:
                keep &= i < j
            if keep.any():
                yield i[keep], j[keep]
            continue
        rows = [(s, e)] if e - s <= LEAF else [(s, (s + e) // 2), ((s + e) // 2, e)]
        columns = [(t, f)] if f - t <= LEAF else [(t, (t + f) // 2), ((t + f) // 2, f)]
        work += [(*r, *c) for r in rows for c in columns]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places by links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], least)
        np.minimum.at(after, label[j], least)
        after = np.minimum(after, after[after])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def linked_blocks(blocks: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(vec_id, links, root) for vectors with links in a pair of blocks: their number, and a vector that they reach.

    Tasks get a block and the blocks it is paired with; links are counted and reduced to a
    star for each group of linked vectors before they leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["pair"]:
                    own = _Block(row["ids"], row["sizes"], row["data"], width)
                    continue
                same = row["a"] == row["b"]
                other = own if same else _Block(row["ids"], row["sizes"], row["data"], width)
                ids = own.ids if same else np.concatenate((own.ids, other.ids))
                shift = 0 if same else len(own.ids)
                label, counts = np.arange(len(ids)), np.zeros(len(ids), np.int64)
                for i, j in join_intervals(own, other, same, threshold):
                    j = j + shift
                    counts += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                    label = _roots(len(ids), np.concatenate((i, np.arange(len(ids)))), np.concatenate((j, label)))
                some = np.flatnonzero(counts)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(counts[some]), pa.array(ids[label[some]])], ["vec_id", "links", "root"])

    # A task gets a block and then, at most SPAN at a time, the blocks that it is paired with.
    dealt = pairs.withColumn("deal", F.floor((F.col("b") - F.col("a")) / SPAN).cast("long")).withColumn("pair", F.lit(True))
    owns = dealt.select("a", F.col("a").alias("b"), "deal").distinct().withColumn("pair", F.lit(False))
    held = blocks.select(F.col("number").alias("b"), "ids", "sizes", "data")
    sent = dealt.unionByName(owns).join(held, "b")
    tasks = max(1, owns.count())
    sent = sent.repartition(tasks, "a", "deal").sortWithinPartitions("a", "deal", "pair", "b")
    return sent.select("a", "b", "pair", "ids", "sizes", "data").mapInArrow(run, "vec_id long, links long, root long")


def _linked(units: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """What :func:`linked_blocks` gives for vectors of one size, as a written table."""
    axes = principal_axes(units, width) if width <= MAX_WIDTH else None
    block = max(16, min(block, BLOCK_CELLS // width))
    blocks = materialize(grid_blocks(units, width, axes, threshold, block), "vector-blocks")
    last = blocks.agg(F.max("number")).first()[0]
    pairs = near_blocks(blocks.select("number", "low", "high"), last + 1, 2 - 2 * threshold + 1e-9)
    return materialize(linked_blocks(blocks, pairs, width, threshold), "vector-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors with a cosine of ``threshold`` or more, in double precision, are linked; vectors of
    different sizes never are (each size is joined by itself), nor those that are null, empty, zero or hold null or non-finite
    components. ``n_links`` counts the other vectors linked directly, ``component_id`` is the
    smallest id reachable, itself included, and ``kept`` tells whether that is the vector's own.
    Ids are expected to be unique: rows that repeat an id are vectors of their own when links
    are counted, and each of them is returned with the sum. A row with a null id has no
    links and a null component. An empty table gives no rows. Other columns are not read.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    units = materialize(unit_vectors(vectors, id_col, vector_col), "unit-vectors")
    widths = [r["size"] for r in units.groupBy("size").count().filter("count > 1").orderBy("size").collect()]
    parts = [_linked(units.filter(F.col("size") == w), w, threshold, block) for w in widths]
    if not parts:
        links = every.limit(0).withColumn("links", F.lit(0).cast("long"))
        labels = every.limit(0).withColumn("root", F.col("vec_id"))
    else:
        linked = reduce(DataFrame.unionByName, parts)
        links = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))
        edges = linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).filter("a != b").distinct()
        labels = connected_components(edges).withColumnRenamed("node", "vec_id")
    joined = every.join(links, "vec_id", "left").join(labels, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
