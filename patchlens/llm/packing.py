"""Token pieces of documents, packed into sequences by vector best-fit."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CONTEXT = 1024
GROUP_PIECES = 16_384  # pieces that one group packs
TEXT_PART = 1 << 21  # characters tokenized at once
# Fixed value: how byte-level BPE splits a text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORD_GAP = re.compile(r"(?<=\S) (?=\S)")


class TextTokenizer:
    """Ids of a byte-level BPE vocabulary file.

    The merges of the file are applied by tiktoken, which gives the same ids in a quarter of
    the time. Texts it refuses (white space without end), and vocabularies that are not plain
    byte-level BPE with merges in order of ids, go through the tokenizers library.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.fast = _byte_level(json.load(file))

    @cached_property
    def slow(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.path)
        slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return slow

    def encode(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except ValueError:
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_long(self, text: str, part: int = TEXT_PART) -> np.ndarray:
        """The ids of a text of any length, a part at a time.

        Parts end before a single blank between two words, where byte-level
        pre-tokenization always cuts.
        """
        ids, start = [], 0
        while self.fast and len(text) - start > part and (gap := _WORD_GAP.search(text, start + part)):
            ids.append(self.encode(text[start : gap.start()]))
            start = gap.start()
        return np.concatenate([*ids, self.encode(text[start:])])


def _byte_level(setting: dict):
    """A tiktoken encoding of a tokenizer file, or None if the file is of another kind."""
    before, model = setting.get("pre_tokenizer") or {}, setting["model"]
    plain = model.get("type") in (None, "BPE") and "merges" in model and setting.get("normalizer") is None
    plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space", True):
        return None
    special = {token["content"] for token in setting.get("added_tokens", [])}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if order != sorted(order):
        return None
    import tiktoken

    # Bytes without a printable character of their own stand as the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> TextTokenizer:
    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return TextTokenizer(vocabulary)


def cut(n: int, context: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids: whole contexts, the first piece may be shorter."""
    first = n % context or context
    ends = range(first, n + 1, context)
    return [(max(0, e - context) if i else 0, e) for i, e in enumerate(ends)]


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    context: int = CONTEXT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row[, ids]): the token pieces of every row of ``docs``.

    A null or empty text has the end id alone. Repeated rows and null ids are documents like
    any other; ``row`` tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = tokenizer(vocabulary)
        for batch in batches:
            row, doc_id, text = (batch.column(i) for i in range(3))
            for some in _portions(text):
                rows = [[] for _ in names]
                for i in some:
                    ids = np.append(encoder.encode_long(text[i].as_py()), np.array([end_id], "<u4"))
                    for piece, (s, e) in enumerate(cut(len(ids), context)):
                        part = ids[s:e]
                        values = (doc_id[i].as_py(), piece, s, e - s, zlib.crc32(part.tobytes()), row[i].as_py(), part)
                        for column, value in zip(rows, values, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=False)], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<long>" * with_ids
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return source.mapInArrow(run, schema)


def _portions(texts: pa.Array, size: int = TEXT_PART) -> Iterator[range]:
    """Runs of rows with about ``size`` bytes of text, at least one row."""
    start, held = 0, 0
    sizes = pa.compute.binary_length(texts).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and held + n > size:
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield range(start, len(sizes))


def best_fit(
    lengths: np.ndarray,
    context: int = CONTEXT,
    max_docs: int = CONTEXT,
    max_attention: int = CONTEXT * CONTEXT,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` come in the order in which they are placed.

    A piece asks for its tokens, one document place and an attention cost of its squared
    length. Of the open bins that can hold all three, it goes to the one with the smallest
    weighted norm of what stays free ("norm"), or the largest weighted product of demand and
    free capacity ("dot"); to the oldest of equals. Without such a bin it opens one.
    """
    full = np.array([context, max_docs, max_attention], float)
    scale = np.sqrt(np.array(weights, float)) / full
    free, number = np.empty((3, len(lengths))), np.empty(len(lengths), np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = np.minimum.accumulate(lengths[::-1])[::-1]
    open_bins = made = 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty bin")
        room = free[:, :open_bins]
        fits = (room[0] >= need[0]) & (room[1] >= 1) & (room[2] >= need[2])
        at = -1
        if fits.any():
            some = np.flatnonzero(fits)
            if rule == "norm":
                rest = (room[:, some] - need[:, None]) * scale[:, None]
                at = some[np.argmin((rest * rest).sum(axis=0))]
            else:
                at = some[np.argmax(((room[:, some] * scale[:, None]) * (need * scale)[:, None]).sum(axis=0))]
        else:
            at, open_bins, made = open_bins, open_bins + 1, made + 1
            free[:, at], number[at] = full, made - 1
        bins[i], offsets[i] = number[at], context - free[0, at]
        free[:, at] -= need
        if i + 1 < len(lengths) and (free[0, at] < smallest[i + 1] or free[1, at] < 1 or free[2, at] < smallest[i + 1] ** 2):
            open_bins -= 1  # nothing to come fits in
            free[:, at:open_bins], number[at:open_bins] = free[:, at + 1 : open_bins + 1].copy(), number[at + 1 : open_bins + 1].copy()
    return bins, offsets


def pack(pieces: DataFrame, context: int = CONTEXT, **limits) -> DataFrame:
    """Adds (sequence_id, offset) to ``pieces``, which must be a written table.

    Pieces are dealt at random, by a hash of their row, to groups of about ``GROUP_PIECES``;
    a group packs its pieces from the longest to the shortest. A group leaves at most a few
    bins half empty, whatever the size of the table. No pieces give no rows.
    """
    groups = max(1, round(pieces.count() / GROUP_PIECES))
    named = pieces.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("row", "ascending"), ("piece", "ascending")]
        table = table.sort_by(keys)
        bins, offsets = best_fit(table.column("length").to_numpy(), context, **limits)
        base = key[0].as_py() << 32
        table = table.drop_columns(["_group"]).append_column("sequence_id", pa.array(base + bins))
        return table.append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return named.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, context: int = CONTEXT, with_ids: bool = False, limits: dict | None = None, **source) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all pieces of ``docs``.

    ``source`` goes to ``token_pieces``, ``limits`` to ``best_fit``. Other columns of
    ``docs`` are not read.
    """
    pieces = materialize(token_pieces(docs, context=context, with_ids=with_ids, **source), "token-pieces")
    return pack(pieces, context, **(limits or {})).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed ids of each sequence, in order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("p"))  # at most a context of ids
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
