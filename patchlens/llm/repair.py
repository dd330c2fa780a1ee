"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is a row of turns, each with a role and perhaps a fault. Edits keep a turn, give
it the other role, delete it or insert an empty one, so that the roles read: perhaps a system
turn, then pairs of user and assistant, or nothing at all. Of the cheapest edits those whose
initials come first in ASCII are taken.

The search goes over nodes (turns used, place in the pattern) with a stack of its own, initials
in ASCII order. The cheapest completion of every node, whatever its initials, bounds what is
still to come; a prefix is left if its cost and bound exceed the incumbent, or equal it with
later initials, and if its node was reached by a prefix as good. What is still on the
stack when it runs out of such prefixes is nothing, and the incumbent is proved. Long conversations
are searched in parts of ``PART`` turns, from every place to every place, and the parts are joined:
two prefixes of one node and one cost never start with each other, so the better one
stays better whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.session import materialize

PART = 256  # turns searched at once
PREFIX = 64  # characters of a text that order turns before a hash of the text does
# Places in the pattern and where each role leads from there; a conversation may end at the start or after a pair.
START, OPENED, PAIRED, ASKED = range(4)
STEP = {START: {"s": OPENED, "u": ASKED}, OPENED: {"u": ASKED}, PAIRED: {"u": ASKED}, ASKED: {"a": PAIRED}}
FINAL = (START, PAIRED)
# The costs of edits, and of a truncated turn that stays.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
NEVER = 1 << 40
BLANKS = " \t\n\v\f\r"

Best = tuple[int, str]  # cost and initials


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) % 20 gives a row.

    0 drops it, 1 empties the text, 2 takes its end marks away, 3 repeats it, 4 makes it the
    user's. Nulls of role and text become one blank, and so do those of the two ids inside the
    key. Equal rows get equal faults. Plain SQL functions.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    fault = F.crc32(key.cast("binary")) % 20
    hit = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault != 0")
    emptied = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    named = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return hit.select("conv_id", "turn", named.alias("role"), emptied.alias("text"), F.explode(copies)).drop("col")


def _edits(code: str, place: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, turns used, next place) of the edits at a turn, in ASCII order; "" is the end.

    A code is an initial of a role, in upper case for a truncated turn, or "x" for one that has to go.
    """
    if code:
        yield "D", DELETE, 1, place
    for role, to in STEP[place].items():
        if role != "s":
            yield "I", INSERT, 0, to
    if code and code != "x":
        extra = TRUNCATED if code.isupper() else 0
        if code.lower() in STEP[place]:
            yield "K", KEEP + extra, 1, STEP[place][code.lower()]
        for role, to in STEP[place].items():
            if role != "s":
                yield "R", REROLE + extra, 1, to


_EDITS = {(c, p): tuple(_edits(c, p)) for c in ("", *"suaoSUAOx") for p in range(4)}


def suffix_bounds(codes: str, ends: tuple[int, ...]) -> list[list[int]]:
    """The least cost from (turns used, place) to the end at one of ``ends``, whatever the initials."""
    bounds = []
    for code in ("", *reversed(codes)):
        after = bounds[-1] if bounds else None
        now = [NEVER] * 4
        for place in range(4):
            if after is None:
                now[place] = 0 if place in ends else NEVER
            else:
                now[place] = min((c + after[to] for _, c, used, to in _EDITS[code, place] if used), default=NEVER)
        for _ in range(3):  # inserted turns lead from place to place
            for place in range(4):
                for _, cost, used, to in _EDITS[code, place]:
                    if not used and cost + now[to] < now[place]:
                        now[place] = cost + now[to]
        bounds.append(now)
    return bounds[::-1]


@lru_cache(maxsize=1 << 14)
def cheapest(codes: str, start: int = START, ends: tuple[int, ...] = FINAL) -> Best | None:
    """Cost and initials of the best edits that lead ``codes`` from a place to one of ``ends``; None if nothing does."""
    bounds = suffix_bounds(codes, ends)
    if bounds[0][start] >= NEVER:
        return None
    n, incumbent = len(codes), _dive(codes, start, ends, bounds)
    reached: list[list[Best | None]] = [[None] * 4 for _ in range(n + 1)]
    stack = [(0, start, 0, "")]
    while stack:
        used, place, cost, audit = stack.pop()
        if (cost + bounds[used][place], audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        held = reached[used][place]
        if held is not None and held <= (cost, audit):
            continue
        reached[used][place] = cost, audit
        if used == n and place in ends:
            incumbent = min(incumbent, (cost, audit))
        code = codes[used] if used < n else ""
        for initial, extra, uses, to in reversed(_EDITS[code, place]):
            if cost + extra + bounds[used + uses][to] <= incumbent[0]:
                stack.append((used + uses, to, cost + extra, audit + initial))
    return incumbent


def _dive(codes: str, place: int, ends: tuple[int, ...], bounds: list[list[int]]) -> Best:
    """A first incumbent: always the edit with the least cost and bound."""
    used, cost, audit = 0, 0, []
    while used < len(codes) or place not in ends:
        code = codes[used] if used < len(codes) else ""
        options = ((extra + bounds[used + uses][to], initial, extra, uses, to) for initial, extra, uses, to in _EDITS[code, place])
        _, initial, extra, uses, place = min(options)
        audit.append(initial)
        used, cost = used + uses, cost + extra
    return cost, "".join(audit)


class Search:
    """The best edits of a conversation whose turns come one after the other."""

    def __init__(self):
        self.codes, self.heads = [], {START: (0, "")}

    def add(self, code: str) -> None:
        self.codes.append(code)
        if len(self.codes) > PART:
            self._join("".join(self.codes[:-1]), [(p,) for p in range(4)])
            del self.codes[:-1]

    def _join(self, codes: str, ends: list[tuple[int, ...]]) -> None:
        heads: dict[int, Best] = {}
        for start, (cost, audit) in self.heads.items():
            for end in ends:
                if part := cheapest(codes, start, end):
                    found = cost + part[0], audit + part[1]
                    heads[end[0]] = min(heads.get(end[0], found), found)
        self.heads = heads

    def close(self) -> Best:
        self._join("".join(self.codes), [FINAL])
        return self.heads[FINAL[0]]


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, position): the turns in order, as a written table.

    Turns go by conversation and turn, nulls first, then by role and text (their first ``PREFIX``
    characters, then a hash); ``position`` grows in that order over the whole table. Range
    partitions divide a conversation of any size, also one of equal rows.
    """
    conv, turn = F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    given = rows.select(conv, turn, role.alias("role"), text.alias("text"), F.rand(0).alias("tie"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn")]
    keys += [F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX), F.xxhash64("role", "text"), F.col("tie")]
    ordered = given.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("position")), "turns")


def marks(turns: DataFrame) -> DataFrame:
    """(position, conv_id, turn, initial, code, fault) of ``turns``, as a written table without texts.

    ``fault`` is the first of blank, duplicate (role and text stood before in the conversation)
    and truncated, else null; ``code`` is what :func:`cheapest` reads.
    """
    text = F.rtrim("text", F.lit(BLANKS))
    whole = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)
    narrow = turns.select(
        "position", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), whole.alias("digest"),
        (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    firsts = narrow.groupBy("digest").agg(F.min("position").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = narrow.select("position", "digest").join(firsts, "digest").filter("position > first")
    found = narrow.join(again.select("position", F.lit(True).alias("again")), "position", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("truncated"), "truncated")
    found = found.withColumn("fault", fault)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return materialize(found.select("position", "conv_id", "turn", "initial", code.alias("code"), "fault"), "turn-marks")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
LEGAL = ("su", "ua", "au")


def summaries(marked: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every id of ``convs``.

    ``marked`` is what :func:`marks` gives. A conversation is one sorted stream of
    a few bytes a turn; memory is that of its initials.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        conv, state = None, None

        def closed():
            first, last, distinct, counts, _, search = state
            gaps = last - first + 1 - distinct if distinct else 0
            cost, audit = search.close()
            values = [conv, gaps, *(counts[k] for k in _COUNTS[1:5]), cost, audit]
            return values

        for batch in batches:
            out = []
            for at, turn, initial, code, fault, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        out.append(closed())
                    conv, state = key, [None, None, 0, dict.fromkeys(_COUNTS, 0), None, Search()]
                if at is None:  # the id alone
                    continue
                if turn is not None:
                    state[0] = turn if state[0] is None else state[0]
                    state[2] += turn != state[1]
                    state[1] = turn
                if fault:
                    state[3][fault] += 1
                if state[4] is not None and state[4] + initial not in LEGAL:
                    state[3]["illegal"] += 1
                state[4] = initial
                state[5].add(code)
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([closed()])

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["conv_id", *_COUNTS, "audit"]
    columns = ["position", "turn", "initial", "code", "fault", "conv_id"]
    alone = convs.select("conv_id").distinct().select(
        F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in columns[2:5]], "conv_id"
    )
    rows = marked.select(*columns).unionByName(alone).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", audit string")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns after the edits of ``found``, those put in included.

    A conversation is one sorted stream in which its initials come first.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        conv, audit, at, place, size = None, "", 0, START, 0

        def emit(out: list, edit: str, turn, role: str, text: str) -> None:
            nonlocal place, size
            place = STEP[place][role[:1]]
            out.append((conv, size, edit, turn, role, text))
            size += 1

        def inserted(out: list) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(out, "I", None, "assistant" if place == ASKED else "user", "")
                at += 1

        for batch in batches:
            out = []
            for key, _, turn, role, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if edits is not None:
                    conv, audit, at, place, size = key, edits, 0, START, 0
                    inserted(out)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    other = "assistant" if place == ASKED else "user"
                    emit(out, edit, turn, role if edit == "K" else other, text)
                inserted(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    null = F.lit(None)
    heads = found.select(
        "conv_id", null.cast("long").alias("position"), null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), "audit"
    )
    rows = turns.select("conv_id", "position", "turn", "role", "text", null.cast("string").alias("audit")).unionByName(heads)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def repair(
    rows: DataFrame, convs: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The repaired turns, see :func:`repaired`, and what was found and done, see :func:`summaries`.

    ``convs`` has the ids (``conv_id``) that get a summary also without turns, by default those of
    ``rows``. Null roles and texts count as one blank; a blank text has to go. A null id is a
    conversation like any other, null turns come first and do not count for gaps. Equal rows are
    duplicates. Empty tables give no rows. Other columns are not read. Results are written tables.
    """
    turns = ordered_turns(rows, conv_col, turn_col, role_col, text_col)
    convs = rows.select(F.col(conv_col).cast("long").alias("conv_id")) if convs is None else convs
    found = materialize(summaries(marks(turns), convs), "conversation-edits")
    return repaired(turns, found), found


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of `role:text` of the repaired turns, joined by newlines, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]):
        conv, state = None, None
        for batch in batches:
            out = []
            for key, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not place:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role + b":" + text)
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([(conv, state.hexdigest())])

    def batch_of(rows: list) -> pa.RecordBatch:
        conv, digest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest)], ["conv_id", "repaired_sha256"])

    rows = turns.select("conv_id", "place", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, "conv_id long, repaired_sha256 string")
