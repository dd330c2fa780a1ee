"""Periodic runs of words: stretches that repeat a block two or more times.

The suffix automaton of a stretch of words has one state for all substrings with the same
ends, and its suffix links make a tree in which the path from the root to the state of a
prefix holds all suffixes of that prefix. Words are appended one at a time. Every state
carries as colour the last end of its substrings, and the states of one colour form a
vertical path; a link-cut tree keeps these paths. Appending word ``i`` recolours the path of
its prefix. Each old colour ``e`` met there says: the suffix of length ``L`` (the longest of
that colour) stood last at ``e``, at a distance of ``i - e`` words. If the distance is at most
``L``, a square ends at ``i``, its period is the smallest one, and it reaches back to
``e - L + 1``. Comparing words to the right makes it a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import TEXT_PART

MIN_LENGTH = 12  # words of a run
SPACES = r"[\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Lengths and suffix links of the states, and the state of every prefix; 1 is the root, 0 is none."""
    length, link, step, ends = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for size, code in enumerate(codes, 1):
        new = len(length)
        length.append(size)
        link.append(1)
        step.append({})
        at = last
        while at and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at:
            to = step[at][code]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                step.append(step[to].copy())
                link[to] = link[new] = copy
                while at and step[at].get(code) == to:
                    step[at][code] = copy
                    at = link[at]
        last = new
        ends.append(new)
    return length, link, ends


class LastEnds:
    """A link-cut tree over the suffix links; every preferred path has one colour, the last end of its states."""

    def __init__(self, length: list[int], link: list[int]):
        self.length = length
        self.up = link[:]  # parent in the splay tree, or of the path's top
        self.left, self.right = [0] * len(link), [0] * len(link)
        self.colour = [-1] * len(link)  # held by the root of a splay tree

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                break
            g = up[p]
            if left[g] == p or right[g] == p:
                if (left[g] == p) == on_left:
                    self._rotate(p)
                else:
                    self._rotate(x)
                top = g
            else:
                top = p
            self._rotate(x)
        if top != x:
            self.colour[x] = self.colour[top]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[x], up[p] = g, x
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Gives the path of a state the colour ``end``; the old colours met, each with its longest length."""
        met, x, below = [], state, 0
        while x:
            self._splay(x)
            colour, deeper = self.colour[x], self.right[x]
            if colour >= 0:
                met.append((colour, self.length[x]))
            if deeper:
                self.colour[deeper] = colour  # what the new path leaves of the old one
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = end
        return met


def runs_of_stretch(codes: list[int], min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of ``min_length`` words or more, and of two periods or more, by start and period."""
    length, link, states = suffix_automaton(codes)
    tree, found, known = LastEnds(length, link), [], {}
    n = len(codes)
    for i, state in enumerate(states):
        for end, size in tree.access(state, i):
            period = i - end
            if period > size or known.get(period, -1) >= i:
                continue
            stop = i + 1
            while stop < n and codes[stop] == codes[stop - period]:
                stop += 1
            known[period] = stop - 1
            start = end - size + 1
            if stop - start >= min_length:
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(codes: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside which no run of ``min_length`` words has a word.

    A run of two periods holds every word in a group of ``min_length / 2`` words that stands
    in it twice. Words outside such groups cut the text; a piece is cut again until nothing changes.
    """
    width = max(1, min_length // 2)
    done, work = [], [(0, len(codes))]
    while work:
        start, end = work.pop()
        if end - start < min_length:
            continue
        part = codes[start:end].astype(np.uint64)
        marks = np.zeros(len(part) - width + 1, np.uint64)
        for i in range(width):
            marks = (marks + part[i : len(part) - width + 1 + i] + np.uint64(1)) * _MIX
            marks ^= marks >> np.uint64(29)
        ordered = np.sort(marks)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(again):
            continue
        twice = again[np.searchsorted(again, marks).clip(max=len(again) - 1)] == marks
        at = np.flatnonzero(twice)
        change = np.zeros(len(part) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        inside = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
        starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        if len(starts) == 1 and ends[0] - starts[0] == len(part):
            done.append((start, end))
        else:
            work += [(start + int(s), start + int(e)) for s, e in zip(starts, ends, strict=True)]
    return sorted(done)


def word_codes(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a text and the distinct words; a part of the text is split at a time."""
    number: dict[bytes, int] = {}
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + TEXT_PART)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[start:end].split()
        for word in dict.fromkeys(words):
            number.setdefault(word, len(number))
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32), list(number)


def runs_of_text(codes: np.ndarray, min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of a text, by start and period."""
    found = []
    for start, end in repeated_stretches(codes, min_length):
        found += [(start + s, n, p) for s, n, p in runs_of_stretch(codes[start:end].tolist(), min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(codes: np.ndarray, words: list[bytes], runs: list[Run]) -> bytes:
    """The words that stay, joined by a blank: of every run its first period, unless another run drops it."""
    keep = np.ones(len(codes), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[c] for c in codes[keep].tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    ``runs`` holds (start, length, period) of every stretch of consecutive words, split at
    ASCII white space, whose smallest period goes into it twice or more, that has
    ``min_length`` words or more, and that no neighbouring word extends; ordered by start,
    then period. ``collapsed`` is the text without the repetitions, words joined by one blank.
    A null, empty or blank text has no words and no runs, and an empty ``collapsed``. Null
    ids and repeated rows are rows like any other. A very long text is worked on in one
    task, with memory in proportion to the text. An empty table gives no rows. Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            counts, runs, texts = [], [], []
            for data in batch.column(1):
                codes, words = word_codes(data.as_py() or b"")
                found = runs_of_text(codes, min_length)
                counts.append(len(codes))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(collapsed(codes, words, found))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*columns[:3], columns[3].cast(pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return source.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equals the one with the smallest start, then period. Null without runs."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(keyed)


def loop_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 10) -> DataFrame:
    """(doc_id, text) with a looping end in about one of ``share`` texts, as degenerate generation leaves it.

    With h = crc32(decimal id), g = floor(h / 10) and n words: if h % ``share`` is 0, the words
    from a = g % n on repeat the first p = 1 + floor((n - a) / (3 + g % 8)) of them. Such
    texts are joined by single blanks, all others stay as they are, also those without words
    or with a null id. Plain SQL functions.
    """
    ids, text = F.col(id_col).cast("long"), F.col(text_col)
    h = F.crc32(ids.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, SPACES), "")
    rows = docs.select(ids.alias("doc_id"), text.alias("text"), F.when(h % share == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w"))  # -1 or null for the others
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))
