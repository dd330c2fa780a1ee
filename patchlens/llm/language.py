"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300  # most frequent n-grams of a language or text
LARGEST = 3  # characters of an n-gram
BLANK = 32
WIDTH = 21  # bits of a code point
TEXT_PART = 1 << 18  # characters whose n-grams are sorted at once
MAX_PROFILE_ROWS = 1_000_000  # languages times PROFILE that are sent to the executors
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased words, with one blank before, between and after them; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, BLANK)
    points = np.concatenate(([BLANK], points, [BLANK]))
    keep = points != BLANK
    if not keep.any():
        return points[:0].astype(np.int64)
    keep[:-1] |= keep[1:]  # the blank before a word
    keep[-1] = True
    out = points[keep].astype(np.int64)
    return out[np.append(True, (out[1:] != BLANK) | (out[:-1] != BLANK))]


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of 1 to ``LARGEST`` characters, and their counts.

    A blank stands only at the start or end of an n-gram, and never alone. An n-gram is a
    number of 21 bits a character, so that shorter ones sort first.
    """
    alphabet, small = np.unique(points, return_inverse=True)
    base = len(alphabet) + 1
    small = small.astype(np.int32 if base**LARGEST < 2**31 else np.int64) + 1
    blank = points == BLANK
    kinds = [small[~blank]]
    pairs = small[:-1] * base + small[1:]
    kinds.append(pairs)
    if len(small) > 2:
        kinds.append((pairs[:-1] * base + small[2:])[~blank[1:-1]])
    codes = np.concatenate(kinds)
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(first, len(codes)))
    return _spread(codes[first].astype(np.int64), alphabet, base), counts


def _spread(codes: np.ndarray, alphabet: np.ndarray, base: int) -> np.ndarray:
    points = np.concatenate(([0], alphabet)).astype(np.int64)
    last, rest = points[codes % base], codes // base
    middle, front = points[rest % base], points[rest // base]
    return (front << (2 * WIDTH)) | (middle << WIDTH) | last


def most_frequent(codes: np.ndarray, counts: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The ``top`` most frequent n-grams, the smaller of equals first."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = PROFILE) -> DataFrame:
    """(lang, rank, code): the ``top`` n-grams of each language, counted over all rows of ``docs``.

    Rows without a language or a letter add nothing. Every task adds up its counts per language
    before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                for at in range(0, len(text), TEXT_PART):
                    part = letters(text[at : at + TEXT_PART])
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= TEXT_PART:
                        total[lang] = _added(total.get(lang), held.pop(lang))
                        sizes[lang] = 0
            for lang, parts in held.items():
                total[lang] = _added(total.get(lang), parts)
        for lang, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = known.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(by_count) - 1).filter(F.col("rank") < top)
    return ranked.select("lang", "rank", "code")


def _added(total, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    points = np.concatenate(parts)
    if not len(points):
        return total or (np.empty(0, np.int64), np.empty(0, np.int64))
    codes, counts = ngrams(points[np.append(True, (points[1:] != BLANK) | (points[:-1] != BLANK))])
    if total is None or not len(total[0]):
        return codes, counts
    both, where = np.unique(np.concatenate((total[0], codes)), return_inverse=True)
    return both, np.bincount(where, np.concatenate((total[1], counts)), len(both)).astype(np.int64)


class Profiles:
    """Ranks of the n-grams of every language, ready for comparison."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = PROFILE):
        self.top, self.langs = top, sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([code for _, _, code in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        line = {lang: i for i, lang in enumerate(self.langs)}
        for lang, rank, code in rows:
            self.ranks[line[lang], np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest out-of-place distance, and its share of agreement.

        An n-gram is out of place by the difference of its ranks, or by the profile length if the
        language does not have it. The score is 1 less the distance's share of the largest
        possible one. Of equally near languages the first by name is given.
        """
        points = letters(text) if text else np.empty(0, np.int64)
        if not len(points) or not self.langs:
            return UNKNOWN, 0.0
        found = most_frequent(*ngrams(points), self.top)
        at = np.searchsorted(self.codes, found).clip(max=len(self.codes) - 1)
        ranks = self.ranks[:, at]
        here = (self.codes[at] == found) & (ranks >= 0)
        out = np.where(here, np.abs(ranks - np.arange(len(found))), self.top).sum(axis=1)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (self.top * len(found)))


def load(profiles: DataFrame, top: int = PROFILE) -> Profiles:
    """Profiles of at most ``MAX_PROFILE_ROWS`` rows, which are sent to every task."""
    rows = profiles.limit(MAX_PROFILE_ROWS + 1).collect()
    if len(rows) > MAX_PROFILE_ROWS:
        raise ValueError(f"more than {MAX_PROFILE_ROWS} profile rows; the language column holds something else")
    return Profiles([tuple(r) for r in rows], top)


def predicted(text: Column, profiles: Profiles) -> Column:
    """A struct of ``lang_pred`` and ``score`` of a text; ``und`` and 0 for a null text or one without a letter."""

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        found = (profiles.predict(t.as_py()) for t in texts)
        return pa.array([{"lang_pred": lang, "score": score} for lang, score in found], kind)

    return run.asNondeterministic()(text)  # evaluated once for both fields


def held_out(id_col: str = "doc_id", share: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning, by a checksum of its id; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % share == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    Profiles are learned from the rows with an id and a language that are not held out. Only
    the text decides a prediction. Equal texts get equal answers; an empty table gives no
    rows. Other columns are not read.
    """
    known = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    profiles = load(learn(known, text_col, lang_col))
    answered = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predicted(F.col(text_col), profiles).alias("p")
    )
    return answered.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with more than ``min_score``."""
    known = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    profiles = load(learn(known, text_col, lang_col))
    return docs.filter(predicted(F.col(text_col), profiles)["score"] > min_score)
