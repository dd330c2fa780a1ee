"""Stored embedding vectors: cache, pooling, normalisation, combination."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions.vectors import concat_vectors, l2_normalize
from patchlens.operators.joins import sized_join
from patchlens.session import materialize


def content_key(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def uncached_keys(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct keys that the cache does not have.

    A cache that is a bucketed table (``tables.write_embedding_table``) is read bucket by bucket and stays in
    place; only the keys move.
    """
    return keys.select("key").join(cache.select("key"), "key", "left_anti").distinct()


def missing_embeddings(df: DataFrame, text_col: str, cache: DataFrame) -> DataFrame:
    """Distinct texts (key, text) that have no cached embedding yet.

    Keyed by content, so the order or choice of rows cannot mix up vectors. The
    missing keys are found without the texts and written down; only texts with a
    missing key are moved, and their copies collapse before that.
    """
    keyed = content_key(df, text_col).select("key", text_col)
    missing = materialize(uncached_keys(keyed, cache), "missing-keys")
    return sized_join(keyed, missing, ["key"], count_large=keyed.select("key")).dropDuplicates(["key"])


def normalize_embeddings(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return df.withColumn(vector_col, l2_normalize(F.col(vector_col)))


def mean_pool(token_vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One vector per id: the element-wise mean of its token vectors.

    A vector aggregate with partial means, so a long text is summed up where its
    rows are and dimensions are never exploded.
    """
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    return (
        token_vectors.groupBy(id_col)
        .agg(Summarizer.mean(vector).alias("_mean"))
        .select(id_col, vector_to_array("_mean").alias(vector_col))
    )


def combine_embeddings(families: Sequence[DataFrame], id_col: str, vector_col: str = "embedding") -> DataFrame:
    """Vectors of several families side by side, then brought to unit length."""
    joined = families[0].select(id_col, F.col(vector_col).alias("_v0"))
    for i, family in enumerate(families[1:], 1):
        joined = joined.join(family.select(id_col, F.col(vector_col).alias(f"_v{i}")), id_col)
    stacked = concat_vectors(*[F.col(f"_v{i}") for i in range(len(families))])
    return joined.select(id_col, stacked.alias("_v")).select(id_col, l2_normalize(F.col("_v")).alias(vector_col))
