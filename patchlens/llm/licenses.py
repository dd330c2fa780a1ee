"""License scans: phrases, and an exact set-similarity join of word windows with templates."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import WORDED, word_lists

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Statements of common licenses; labels of the set-similarity join.
TEMPLATES = {
    "agpl-3.0": "Licensed under the GNU Affero General Public License version 3",
    "apache-2.0": "Licensed under the Apache License Version 2.0",
    "bsd-3-clause": "Use of this source code is governed by a BSD 3-Clause license",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "Released under the CC0 1.0 Universal public domain dedication",
    "gpl-3.0": "This work is licensed under the GNU General Public License version 3",
    "lgpl-3.0": "Licensed under the GNU Lesser General Public License version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
CONTAINMENT = Fraction(4, 5)
MAX_TEMPLATE_BYTES = 8 << 20


def words_of(text: str | bytes) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    return [w for part in word_lists(data, WORDED) for w in part]


class Join:
    """Templates ready to be joined with windows of words.

    A window is as long as the template divided by the threshold, wherever lines break.
    Words of the templates are ordered by how many lines of the corpus hold them, the rarest
    first. A block that shares ``need`` words of a template must hold one of its first
    ``size - need + 1`` words, be long enough, and at the first shared word still have enough
    words to come on both sides; what passes is counted in full.
    """

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: Fraction = CONTAINMENT):
        self.order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sets, self.prefix, self.widths = {}, {}, {}
        for label, text in sorted(templates.items()):
            words = words_of(text)
            ranks = sorted(self.order[w] for w in set(words))
            if not ranks:
                continue
            need = max(1, ceil(threshold * len(ranks)))
            self.sets[label] = (ranks, need)
            self.widths[label] = ceil(len(words) / threshold)
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(rank, []).append((label, place))
        names = {i: w for w, i in self.order.items()}
        self.openers = frozenset(names[r] for r in self.prefix)
        self.reach = {r: max(self.widths[label] for label, _ in own) for r, own in self.prefix.items()}

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Containment of each template that a block holds to the threshold or more."""
        return self._held({self.order[w] for w in words if w in self.order})

    def _held(self, ranks: set[int]) -> dict[str, float]:
        block = sorted(ranks)
        held, tried, found = set(block), set(), {}
        for place, rank in enumerate(block):
            for label, at in self.prefix.get(rank, ()):
                if label in tried:
                    continue
                tried.add(label)  # the first shared word; it bounds what is left on both sides
                ranks, need = self.sets[label]
                if len(block) < need or min(len(ranks) - at, len(block) - place) < need:
                    continue
                shared = sum(r in held for r in ranks)
                if shared >= need:
                    found[label] = shared / len(ranks)
        return found

    def passages(self, places: list[int], ranks: list[int]) -> list[tuple[int, str, float]]:
        """(place, label, containment) of the passages that hold a template to the threshold or more.

        ``places`` ascend and are those of the templates' words in a text. Every such window has a
        prefix word, so only the surroundings of these are filtered, and windows counted there;
        windows that overlap are one passage with the largest containment.
        """
        near: list[list[int]] = []
        for place, rank in zip(places, ranks, strict=True):
            if rank in self.reach:
                start, end = place - self.reach[rank] + 1, place + self.reach[rank] - 1
                if near and start <= near[-1][1]:
                    near[-1] = [min(start, near[-1][0]), max(end, near[-1][1])]
                else:
                    near.append([start, end])
        found = []
        for start, end in near:
            low, high = bisect_left(places, start), bisect_right(places, end)
            for label in self._held(set(ranks[low:high])):
                found += self._windows(label, places[low:high], ranks[low:high])
        return sorted(found)

    def _windows(self, label: str, places: list[int], ranks: list[int]) -> list[tuple[int, str, float]]:
        (words, need), width = self.sets[label], self.widths[label]
        wanted, held, found = set(words), {}, []
        own = [(p, r) for p, r in zip(places, ranks, strict=True) if r in wanted]
        first, until = 0, -1
        for place, rank in own:
            held[rank] = held.get(rank, 0) + 1
            while place - own[first][0] >= width:
                gone = own[first][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            if len(held) >= need:
                share = len(held) / len(words)
                if own[first][0] <= until:
                    found[-1] = (found[-1][0], label, max(share, found[-1][2]))
                else:
                    found.append((own[first][0], label, share))
                until = place
        return found


def _line_starts(data: bytes) -> list[int]:
    """The place of the first word of every line, counted in words of the text."""
    starts, total = [], 0
    for line in data.split(b"\n"):
        starts.append(total)
        total += sum(map(len, word_lists(line, WORDED)))
    return starts


def block_frequencies(docs: DataFrame, templates: dict[str, str], text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of all documents each word of the templates stands; it decides their order alone."""
    vocabulary = frozenset(w for text in templates.values() for w in words_of(text))

    def run(batches: Iterator[pa.RecordBatch]):
        count = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for line in data.translate(_LINES).split(b"\n"):
                    for word in vocabulary.intersection(line.split()):
                        count[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    source = docs.select(F.col(text_col).cast("binary").alias("data")).dropna()
    counts = source.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in counts.collect()}


_LINES = bytes(10 if b == 10 else WORDED[b] for b in range(256))


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Places (in words) of a phrase in a text of words between single blanks."""
    places, sought, at, words, seen = [], b" " + phrase + b" ", 0, 0, 0
    while (at := joined.find(sought, at)) >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        places.append(words)
        at += 1
    return places


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    threshold: Fraction = CONTAINMENT,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of every row.

    ``n_base`` counts all places of the phrases. A block is a window of words, as long as the
    template divided by the ``threshold``, across line breaks; ``labels`` adds to the phrases'
    labels those of every template of which some block holds the ``threshold`` or more of the
    distinct words, ``blocks`` lists them as (line, label, containment) with the line in which
    the passage begins; overlapping blocks of a template are one. ``score`` is 1
    with a phrase, else the largest containment found, else 0. A null or empty text has no
    words and no labels. Rows may repeat and ids be null; other columns are not read.
    The templates are sent to every task, so their size is limited.
    """
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are too large to be held by every task")
    join = Join(templates, block_frequencies(docs, templates, text_col), threshold)
    sought = [(b" ".join(words_of(p)), label) for p, label in phrases.items()]
    kind = pa.struct([(n, t) for n, t in _SCANNED])

    @F.arrow_udf(_SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_scan_text(data or b"", sought, join) for data in texts.to_pylist()], kind)

    found = docs.select(F.col(id_col).alias("doc_id"), run.asNondeterministic()(F.col(text_col).cast("binary")).alias("f"))
    return found.select("doc_id", "f.*")


_SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<line:long,label:string,containment:double>>"
)
_SCANNED = [
    ("n_words", pa.int64()),
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
]


def _scan_text(data: bytes, sought: list[tuple[bytes, str]], join: Join) -> dict:
    total, places, base, opened, tail = 0, set(), set(), False, []
    at, ranks, order = [], [], join.order
    n_base, longest = 0, max((p.count(b" ") for p, _ in sought), default=0)
    for words in word_lists(data, WORDED):
        opened = opened or not join.openers.isdisjoint(words)
        for place, word in enumerate(words, total):
            if word in order:
                at.append(place)
                ranks.append(order[word])
        words = tail + words
        start = total - len(tail)
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in sought:
            own = phrase.count(b" ")
            new = [start + p for p in phrase_places(joined, phrase) if start + p + own >= total] if phrase else []
            if new:
                base.add(label)
                n_base += len(new)
                places.update((new[0], new[-1]))
        total = start + len(words)
        tail = words[len(words) - longest :] if longest else []
    passages = join.passages(at, ranks) if opened else []
    starts = _line_starts(data) if passages else []
    blocks = [{"line": bisect_right(starts, p) - 1, "label": k, "containment": v} for p, k, v in passages]
    score = 1.0 if base else max((b["containment"] for b in blocks), default=0.0)
    return {
        "n_words": total,
        "n_base": n_base,
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {b["label"] for b in blocks})),
        "score": score,
        "blocks": blocks,
    }
