"""What several operators share: words of a text, shipping the package, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.session import materialize, ship

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Words between white space, and words of digits, letters and everything beyond ASCII.
SPACED = bytes(32 if 9 <= b <= 13 else _LOWER[b] for b in range(256))
WORDED = bytes(
    _LOWER[b] if b >= 128 or 48 <= b <= 57 or 97 <= _LOWER[b] <= 122 else 32 for b in range(256)
)
TEXT_PART = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the package sent to the executors that will read it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name that begins with ``name`` and is none of ``taken``, whatever the case of letters."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def word_lists(data: bytes, table: bytes, size: int = TEXT_PART) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes of text each.

    ``table`` lower-cases A-Z and turns every separator into a blank.
    """
    text = data.translate(table)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size) if len(text) - start > size else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root): the smallest node reachable from each node.

    Roots themselves have no row. Alternates the large-star and small-star steps, in
    which every node hands the smallest neighbour to the others, until the edges are
    stars. Each round is written to the shared folder; a node of any degree is only
    aggregated and joined, never gathered. Null and equal ends are no edges.
    """
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(pairs.distinct(), "components")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select("e.u", F.col("e.m").alias("v")).filter("u != v")
        now = materialize(small.distinct(), "components")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
