"""Joins that hold when one key owns a large share of the rows or a side grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 64 * 1024 * 1024  # bytes of JSON text of the rows
BROADCAST_ROWS = 100_000  # of a table limited to that many short rows
PRUNE_VALUES = 1000  # of a key, sent to a scan as a filter
SALTS = 32
# A key is hot when it owns more than this share of the rows, so there are at
# most 1 / HOT_SHARE hot keys, whatever the size of the table.
HOT_SHARE = 0.005
HOT_ROWS = 1_000_000


def _key(on: Sequence[str]) -> Column:
    return F.xxhash64(*on)  # keys of one hash are spread together, which changes no result


def _splits_skew(df: DataFrame) -> bool:
    """Whether Spark itself splits the skewed partitions of a join."""
    conf = df.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{name}").lower() == "true" for name in ("enabled", "skewJoin.enabled"))


def _hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int) -> Column:
    """Array of the hot keys (as hashes) of a table; reads the key columns only."""
    counts = df.select(_key(on).alias("_key")).groupBy("_key").count()
    least = counts.agg(F.greatest(F.sum("count") * HOT_SHARE, F.lit(float(hot_rows)))).scalar()
    return counts.filter(F.col("count") >= least).agg(F.collect_list("_key")).scalar()


def _is_hot(on: Sequence[str], hot: Column) -> Column:
    # without hot keys no row pays for its hash
    return (F.size(hot) > 0) & F.array_contains(hot, _key(on))


def _spread(df: DataFrame, on: Sequence[str], hot: Column, by: Sequence[str] | None, salts: int) -> Column:
    by = by or [c for c in df.columns if c not in on] or on
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    return F.coalesce(F.when(_is_hot(on, hot), salt), F.lit(0))


def _repeat(on: Sequence[str], hot: Column, salts: int) -> Column:
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return F.explode_outer(F.when(_is_hot(on, hot), every).otherwise(F.array(F.lit(0))))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    count_left: DataFrame | None = None,
    both_sides: bool = False,
    left_by: Sequence[str] | None = None,
    right_by: Sequence[str] | None = None,
    salted: bool | None = None,
) -> DataFrame:
    """Equi-join in which the hot keys of ``left`` are spread over ``salts`` tasks.

    Where adaptive execution splits skewed partitions, that is what spreads them, and the keys
    are not counted; ``salted`` asks for one way or the other.

    The matching rows of ``right`` are repeated once per salt; rows of all other
    keys take salt 0. ``both_sides`` does the same for hot keys of ``right``.
    ``count_left`` is a cheaper table with the same keys to count; ``left_by`` and
    ``right_by`` name short columns that tell the rows of one key apart (default:
    all columns). ``how`` is "inner", or "left" when only the left side is spread.
    """
    if how != "inner" and (how != "left" or both_sides):
        raise ValueError("salted_join does inner joins, and left joins with a spread left side")
    if not (not _splits_skew(left) if salted is None else salted):
        return left.join(right, list(on), how)
    hot = _hot_keys(left if count_left is None else count_left, on, hot_rows)
    spread = left.withColumn("_ls", _spread(left, on, hot, left_by, salts))
    repeated = right.withColumn("_ls", _repeat(on, hot, salts))
    keys = [*on, "_ls"]
    if both_sides:
        hot = _hot_keys(right, on, hot_rows)
        spread = spread.withColumn("_rs", _repeat(on, hot, salts))
        repeated = repeated.withColumn("_rs", _spread(right, on, hot, right_by, salts))
        keys.append("_rs")
    return spread.join(repeated, keys, how).drop("_ls", "_rs")


def limited_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table cut to ``rows`` short rows, when that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def measured_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text, from one pass that returns one number."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))
    return df.agg(size.alias("bytes")).first()["bytes"] or 0


def _pruned(large: DataFrame, small: DataFrame, key: str) -> DataFrame:
    found = small.select(key).distinct().limit(PRUNE_VALUES + 1).collect()
    return large.filter(F.col(key).isin([r[0] for r in found])) if len(found) <= PRUNE_VALUES else large


def sized_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_LIMIT,
    count_large: DataFrame | None = None,
    prune_by: str | None = None,
) -> DataFrame:
    """Broadcast ``small`` when its measured size allows it, else join by salted keys.

    ``small`` is read more than once, so pass a table that is written down
    already. ``count_large`` is a cheaper table with the keys of ``large``.
    ``prune_by`` is a key that ``large`` may be partitioned or sorted by: when
    ``small`` has few values of it, the scan of an inner join gets them as a filter.
    """
    if measured_bytes(small) <= limit:
        if prune_by and how == "inner":
            large = _pruned(large, small, prune_by)
        return large.join(F.broadcast(small), list(on), how)
    return salted_join(large, small, on, how, count_left=count_large, both_sides=how == "inner")
