"""Data selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import WORDED, word_lists
from patchlens.operators.joins import sized_join
from patchlens.session import materialize

BUCKETS = 1 << 18
SMOOTHING = 30.0  # n-grams of the raw text that every bucket is given in both models
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the words and word pairs of a text, with repeats, a part at a time."""
    last = np.empty(0, np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for words in word_lists(data, WORDED):
        if not words:
            continue
        codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        both = np.concatenate((last, codes))
        pairs = (both[:-1] * _MIX + both[1:] + np.uint64(1)) * _MIX
        yield (np.concatenate((codes * _MIX, pairs)) >> shift).astype(np.int64)
        last = codes[-1:]


def ngram_models(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket of the target rows and of all rows of (text, target), over all documents.

    Every task adds up its rows before the shuffle; what comes back has ``buckets`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in bucket_counts(data or b"", buckets):
                    bucket, n = np.unique(found, return_counts=True)
                    raw[bucket] += n
                    if wanted:
                        target[bucket] += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    source = docs.select(F.col("text").cast("binary").alias("data"), "target")
    rows = source.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket")
    found = rows.agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    target[found["bucket"]], raw[found["bucket"]] = found["target"], found["raw"]
    return target, raw


def log_weight(data: bytes | None, is_target: bool, target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> float:
    """Sum over a text's n-grams of the log ratio of target to raw probability.

    The text itself is taken out of both counts, else the rows that the target model was
    counted on would all look like the target. Both models are smoothed by ``smoothing``
    n-grams of raw text in every bucket, so that a rare n-gram says little.
    """
    parts = list(bucket_counts(data or b"", len(raw)))
    if not parts:
        return 0.0
    bucket, n = np.unique(np.concatenate(parts), return_counts=True)
    total = n.sum()
    own = total if is_target else 0
    all_target, all_raw = max(target.sum() - own, 1.0), max(raw.sum() - total, 1.0)
    share = all_target / all_raw
    ratio = (target[bucket] - (n if is_target else 0) + smoothing * share) / (raw[bucket] - n + smoothing)
    return float((n * np.log(ratio / share)).sum())


def weighted(text: Column, is_target: Column, target: np.ndarray, raw: np.ndarray) -> Column:
    """Log importance weight of a text; 0 for a text without words."""

    @F.arrow_udf("double")
    def run(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        rows = zip(texts, wanted.to_pylist(), strict=True)
        return pa.array([log_weight(t.as_py(), w, target, raw) for t, w in rows], pa.float64())

    return run(text.cast("binary"), is_target)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def smallest_of_top(keys: DataFrame, key: str, k: int, parts: int = 4096, rounds: int = 64) -> float | None:
    """The ``k``-th largest value of a column, or None when it has no more than ``k`` rows.

    The range of the values is cut into ``parts`` and counted, and the part that holds the
    ``k``-th one is cut again, until it holds a single value; a round returns a few thousand
    numbers at most.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return None
    if k < 1:
        return float("inf")
    above = 0
    for _ in range(rounds):
        if low == high:
            return low
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            break
        inside = keys.filter(F.col(key).between(low, high))
        part = F.least(F.floor((F.col(key) - low) / width), F.lit(parts - 1)).cast("long")
        found = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for row in sorted(found.collect(), key=lambda r: -r["part"]):
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    values = keys.filter(F.col(key).between(low, high)).groupBy(key).count().collect()  # neighbouring doubles
    for row in sorted(values, key=lambda r: -r[key]):
        above += row["count"]
        if above >= k:
            return row[key]
    return low


def resample(
    docs: DataFrame, target_ids: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(doc_id, is_target, log_weight, key, selected) of every row of ``docs``.

    Two models of hashed words and word pairs are counted, one on the rows whose id is in
    ``target_ids`` (column ``doc_id``) and one on all rows. A row's key is its log importance
    weight plus Gumbel noise, and the ``share`` of all rows with the largest keys is selected,
    which is a draw without replacement in proportion to the weights. Equal keys at the border
    are all selected. Texts without words have weight 0; a null id is drawn like an id of its
    own. Equal rows get equal keys. An empty table gives no rows.
    """
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    wanted = materialize(wanted.withColumn("target", F.lit(True)), "target-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = sized_join(rows, wanted, ["doc_id"], "left", count_large=rows.select("doc_id"))
    marked = marked.withColumn("target", F.coalesce("target", F.lit(False)))
    models = ngram_models(marked, buckets)
    weight = weighted(F.col("text"), F.col("target"), *models)
    scored = marked.select("doc_id", F.col("target").alias("is_target"), weight.alias("log_weight"))
    scored = materialize(scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)), "importance")
    least = smallest_of_top(scored, "key", round(share * scored.count()))
    return scored.withColumn("selected", F.lit(True) if least is None else F.col("key") >= F.lit(least))


def target_share(labels: DataFrame) -> tuple[DataFrame, float]:
    """Ids of the labelled rows of target quality, and their share of the labelled ids.

    An id is a target if all its labels are of quality 1 and none is toxic; a null label
    counts against it.
    """
    by_id = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")
    )
    counted = by_id.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    return by_id.filter("good").select("doc_id"), (counted["good"] / counted["n"] if counted["n"] else 0.0)
