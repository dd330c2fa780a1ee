"""Corpus statistics of words: the TF-IDF risk score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.functions import constants as K
from patchlens.functions.text import term_counts, words
from patchlens.session import materialize

TERM_LENGTH = 256  # characters of a term in the maps
SLOTS = 512  # maps of the vocabulary


def tfidf_risk(
    df: DataFrame,
    id_col: str,
    text_col: str,
    risky_tokens: Sequence[str] = K.RISKY_TOKENS,
    vocabulary: int = K.VOCABULARY_SIZE,
    threshold: float = K.RISK_THRESHOLD,
) -> DataFrame:
    """Rows (id, score, label): risky share of the TF-IDF row, scaled by the largest.

    Words are lower-cased runs of two or more word characters; the vocabulary is
    the most frequent terms of the corpus (ties by term); idf is smoothed and
    rows have unit length. A corpus without any risky word scores NaN, label 0.

    Each text is counted in place, once, and the counts are written down. The vocabulary is
    one aggregation by term over them. It comes back to the rows as one value, the maps of at most
    ``vocabulary`` terms, so a score needs no grouping; a term of more than ``TERM_LENGTH``
    characters stands there as its hash. Rows that repeat an id are texts of their own.
    """
    counted = df.select(id_col, term_counts(words(F.lower(F.col(text_col)), 2)).alias("_terms"))
    counted = materialize(counted, "term-counts")
    n_docs = counted.select(F.count("*").alias("n")).scalar()
    terms = (
        counted.select(F.explode("_terms").alias("_t"))
        .groupBy(F.col("_t.term").alias("term"))
        .agg(F.sum("_t.tf").alias("corpus_tf"), F.count("*").alias("doc_freq"))
        .orderBy(F.desc("corpus_tf"), "term")
        .limit(vocabulary)
        .select("term", (F.log((1 + n_docs) / (1 + F.col("doc_freq"))) + 1).alias("idf"))
    )
    weights = _slots(terms).scalar()
    marked = F.array(*[F.lit(t.lower()) for t in risky_tokens])

    def added(total, t):
        known = F.get(F.col("_idf"), _slot(t["term"]))
        weight = F.coalesce(t["tf"] * F.try_element_at(known, _map_key(t["term"])), F.lit(0.0))
        risky = F.when(F.array_contains(marked, t["term"]), weight).otherwise(0.0)
        return F.struct((total["norm"] + weight * weight).alias("norm"), (total["risky"] + risky).alias("risky"))

    zero = F.struct(F.lit(0.0).alias("norm"), F.lit(0.0).alias("risky"))
    summed = counted.withColumn("_idf", weights).select(id_col, F.aggregate(F.coalesce("_terms", F.array()), zero, added).alias("_s"))
    raw = F.coalesce(F.try_divide("_s.risky", F.sqrt("_s.norm")), F.lit(0.0))
    scores = materialize(summed.select(id_col, raw.alias("_raw")), "tfidf-scores")  # the division needs the largest one first
    largest = scores.agg(F.max("_raw")).scalar()
    scored = scores.withColumn("_max", largest)
    score = F.when(F.col("_max") > 0, F.least(F.try_divide("_raw", "_max"), F.lit(1.0))).otherwise(
        F.lit(float("nan"))
    )
    return scored.select(id_col, score.alias("score")).withColumn(
        "label", (~F.isnan("score") & (F.col("score") > threshold)).cast("int")
    )


def _slot(term):
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def _slots(terms: DataFrame) -> DataFrame:
    """One row with an array of ``SLOTS`` small maps of (term, idf), as a map is searched entry by entry."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(_map_key(F.col("term")).alias("term"), "idf"))))
    maps = materialize(terms.groupBy(_slot(F.col("term")).alias("slot")).agg(entries.alias("idf")), "vocabulary")
    every = terms.sparkSession.range(SLOTS).withColumn("slot", F.col("id").cast("int")).join(F.broadcast(maps), "slot", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("slot", "idf")), lambda a, b: a["slot"] - b["slot"])["idf"].alias("idf"))


def _map_key(term):
    """A term, or for a long one a hash that no term can be mistaken for."""
    return F.when(F.char_length(term) <= TERM_LENGTH, term).otherwise(F.concat(F.lit("#"), F.sha2(term, 256)))
