"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import WORDED, free_name, word_lists
from patchlens.session import materialize

WINDOW = 10
MAX_COVERAGE = 0.5
ITEM_BYTES = 8 << 20  # text of the items that one automaton holds; more items take more passes
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """All runs of words of the items, in states that end at the same places.

    The automaton is built item by item from the root, so that no run crosses items. A state
    knows the items that hold its runs, and which short items end with it.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}  # state to the short items that are its longest run
        shortest = window
        pairs = set()
        for item, words in items:
            if not words:
                continue
            shortest = min(shortest, len(words))
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            pairs.update(zip(ids, ids[1:], strict=False))
            state = 0
            for word in ids:
                state = self._extend(state, word, owners)
                owners[state].add(item)
            if len(words) < window:
                whole.setdefault(self._find(ids), set()).add(item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for state in order:
            owners[self.link[state]] |= owners[state]
        # Of each state: the length of the longest window that ends with its runs, and the items of all such windows.
        self.long: dict[int, frozenset[int]] = {}
        for state in order:
            if self.length[self.link[state]] < window <= self.length[state]:
                self.long[state] = frozenset(owners[state])
        self.shorts: list[tuple[tuple[int, int, frozenset[int]], ...]] = [()] * len(self.link)
        for state in reversed(order):
            own = tuple((len_, state, frozenset(found)) for len_, found in self._own_shorts(state, whole, items))
            self.shorts[state] = self.shorts[self.link[state]] + own
        self.shortest = shortest
        size = len(self.words)
        self.pairs = np.sort(np.array([a * size + b for a, b in pairs], np.int64))

    def _own_shorts(self, state, whole, items):
        if state in whole:
            lengths = {}
            for item, words in items:
                if item in whole[state]:
                    lengths.setdefault(len(words), set()).add(item)
            yield from lengths.items()

    def _extend(self, last: int, word: int, owners: list[set[int]]) -> int:
        found = self.next[last].get(word)
        if found is not None:
            if self.length[found] == self.length[last] + 1:
                return found
            return self._clone(last, word, found, owners)
        state = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        owners.append(set())
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            found = self.next[at][word]
            exact = self.length[found] == self.length[at] + 1
            self.link[state] = found if exact else self._clone(at, word, found, owners)
        return state

    def _clone(self, at: int, word: int, found: int, owners: list[set[int]]) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[found]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[found])
        owners.append(set())
        self.link[found] = copy
        while at >= 0 and self.next[at].get(word) == found:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _find(self, ids: list[int]) -> int:
        state = 0
        for word in ids:
            state = self.next[state][word]
        return state

    def scan(self, ids: list[int], start: int) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(start, end, items) of the windows in a run of known words; ``start`` is its place in the text."""
        state = length = 0
        following, link, lengths, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(ids, start + 1):
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word in following[state]:
                state, length = following[state][word], length + 1
            for short, owner, items in self.shorts[state]:
                if owner != state or length >= short:
                    yield at - short, at, items
            if length >= window:
                top = state
                while lengths[link[top]] >= window:
                    top = link[top]
                yield at - window, at, self.long[top]

    def matches(self, data: bytes) -> tuple[int, list[tuple[int, int, frozenset[int]]]]:
        """Number of words of a text, and the windows in it.

        Only runs of words in which every two neighbours are neighbours in an item can hold a
        window; the automaton reads those runs.
        """
        if not self.words:
            return sum(map(len, word_lists(data, WORDED))), []
        found, total, before = [], 0, np.empty(0, np.int64)
        size, unknown, get = len(self.words), -1, self.words.get
        lists = word_lists(data, WORDED)
        words = next(lists, None)
        while words is not None:
            after = next(lists, None)
            ids = np.fromiter(map(get, words, repeat(unknown)), np.int64, len(words))
            ids = np.concatenate((before, ids))
            if not len(ids):
                words = after
                continue
            base = total - len(before)
            joined = np.zeros(max(0, len(ids) - 1), bool)
            known = (ids[:-1] >= 0) & (ids[1:] >= 0)
            if known.any():
                keys = ids[:-1][known] * size + ids[1:][known]
                if len(self.pairs):
                    at = np.searchsorted(self.pairs, keys).clip(max=len(self.pairs) - 1)
                    joined[known] = self.pairs[at] == keys
            breaks = np.flatnonzero(~joined) + 1
            starts, ends = np.concatenate(([0], breaks)), np.append(breaks, len(ids))
            keep = 0
            if after is not None and ids[-1] >= 0:  # the last run may go on
                keep = len(ids) - int(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            good = (ends - starts >= self.shortest) & (ids[starts] >= 0)
            for s, e in zip(starts[good].tolist(), ends[good].tolist(), strict=True):
                found += self.scan(ids[s:e].tolist(), base + s)
            total += len(words)
            before = ids[len(ids) - keep :] if keep else ids[:0]
            words = after
        return total, found


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[int, bytes], ...], window: int) -> Automaton:
    return Automaton([(item, [w for part in word_lists(data, WORDED) for w in part]) for item, data in items], window)


def _covered(windows) -> list[tuple[int, int]]:
    """Disjoint (start, end) spans that the windows cover, in order."""
    spans: list[list[int]] = []
    for s, e in sorted({(s, e) for s, e, _ in windows}):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [tuple(s) for s in spans]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> tuple[int, Iterator[tuple]]:
    """The items in blocks of about ``size`` bytes of text (a longer item alone): their number, and each in turn."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).dropna()
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = total // size + 1

    def read():
        for block in range(blocks):
            part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else items
            yield tuple(sorted((r["i"], bytes(r["t"])) for r in part.collect()))

    return blocks, read()


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    into: str = "hits",
    cut: bool = False,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, the hit spans (in words) and the items found.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not
    none, is one window. A null text has no words. Items with a null id or text are left out;
    several texts under one id are one item. The benchmark is read in blocks of about
    ``item_bytes``; with more than one, every block is a written pass of the documents, so
    that driver and tasks hold one block at a time. With ``cut`` the struct also has ``rest``,
    the text without the hit words, null where there are none.
    """
    count, blocks = _blocks(benchmark, item_col, "text", item_bytes)
    for n, items in enumerate(blocks, 1):
        before = F.col(into) if n > 1 else None
        docs = docs.withColumn(into, _hits(F.col(text_col), items, window, before, cut and n == count))
        if n < count:
            docs = materialize(docs, "benchmark-pass")
    return docs


def _hits(text, items, window, before, cut):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("spans", spans_type), ("items", pa.list_(pa.int64())), ("rest", pa.string())])

    def one(automaton, data, known):
        n, windows = automaton.matches(data or b"")
        found = set().union(*(w[2] for w in windows))
        if known:
            windows = [*windows, *((s["start"], s["end"], None) for s in known["spans"])]
            found.update(known["items"])
        spans = _covered(windows)
        rest = without_words(data, spans).decode("utf-8", "replace") if cut and spans else None
        return {"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(found), "rest": rest}

    @F.arrow_udf("n_words long, spans array<struct<start:long,end:long>>, items array<long>, rest string")
    def run(texts: pa.Array, known: pa.Array) -> pa.Array:
        automaton = _automaton(items, window)
        return pa.array([one(automaton, t.as_py(), k.as_py()) for t, k in zip(texts, known, strict=True)], kind)

    known = before if before is not None else F.lit(None).cast("struct<spans:array<struct<start:long,end:long>>,items:array<long>>")
    return run.asNondeterministic()(text.cast("binary"), known)  # evaluated once, not again in each filter


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) of every row of ``docs``, which may have any ids and repeats.

    Other columns are not read; an empty table gives no rows, an empty benchmark no hits.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_windows(narrow, benchmark, window).select("doc_id", "hits.*")
    return found.select(
        "doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans"
    )


def digest_of_items(items):
    """Lowercase hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def without_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A UTF-8 text without the words in ``spans`` and what stands between them."""
    out, start, inside = [], 0, iter(spans)
    span = next(inside, None)
    lowered = data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    for i, word in enumerate(_WORD.finditer(lowered)):
        if span is None:
            break
        if i == span[0]:
            out.append(data[start : word.start()])
        if i == span[1] - 1:
            start, span = word.end(), next(inside, None)
    out.append(data[start:])
    return b"".join(out)


def remove_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    max_coverage: float = MAX_COVERAGE,
    window: int = WINDOW,
    text_col: str = "text",
    length_col: str | None = None,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``docs`` without the words that repeat benchmark windows.

    A span of hit words, ``window`` or longer, is cut out of its text; a row in which the
    hit words are more than ``max_coverage`` of all words goes. Rows without a hit, null and
    empty texts among them, are returned as they are, whatever their number. ``length_col``
    names a column that holds the number of characters and is set anew for texts that change.
    A text is held by its task as a whole. Columns of ``docs`` may have any names.
    """
    columns, into = docs.columns, free_name(docs.columns, "_hits")
    found = find_windows(docs, benchmark, window, text_col, into=into, cut=True, item_bytes=item_bytes)
    spans, n_words, rest = (F.col(into)[c] for c in ("spans", "n_words", "rest"))
    kept = found.filter(hit_words(spans) <= n_words * max_coverage)
    out = kept.withColumn(text_col, F.coalesce(rest, F.col(text_col)))
    if length_col in columns:
        length = F.length(text_col).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(rest.isNotNull(), length).otherwise(F.col(length_col)))
    return out.select(*columns)
