"""Array-typed vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy as ``array<double>``; an all-zero vector stays zero."""
    doubles = vector.cast("array<double>")
    scaled = F.transform(
        F.array(F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))),
        lambda norm: F.transform(doubles, lambda x: F.when(norm == 0, x).otherwise(x / norm)),
    )
    return F.get(scaled, 0)


def concat_vectors(*vectors: Column) -> Column:
    return F.concat(*[v.cast("array<double>") for v in vectors])
