"""Top-k search, periodic runs and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest

from patchlens.llm import repair, runs, topk
from patchlens.llm.queries import QUERIES

# --- top-k search ---


def plain_topk(rows, is_query, k=20):
    """{(query id, ...) -> best} of (id, vector) rows, every row for itself."""
    code = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            code.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(code):
        if i is None or not is_query(i):
            continue
        scored = [(-sum(x * y for x, y in zip(q, c)), j is None, j or 0) for b, (j, c) in enumerate(code) if b != a and len(c) == len(q)]
        out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, score string")
    found = topk.search(df, topk.F.col("vec_id") % 5 == 0, k, **options)
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()], key=repr)


def test_topk_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.9]) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.25, -0.25, 0.25, 0.0]) for i in range(200, 260)]  # ties beyond the k-th place
    rows += [(5, [0.3, 0.3, 0.3, 0.3]), (5, [0.3, 0.3, 0.3, 0.3]), (None, [0.9, 0.9, 0.9, 0.9]), (-10, [0.1, 0.0, 0.0, 0.0])]
    rows += [(300, None), (305, []), (310, [0.1, None, 0.1, 0.1]), (315, [float("nan")] * 4), (320, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(325, [0.5]), (330, [0.5, 0.5]), (331, [-0.5, 0.5]), (335, [0.0, 0.0, 0.0, 0.0])]
    want = plain_topk(rows, lambda i: i % 5 == 0)
    given = [(*r, "x", None) for r in rows]
    assert search(spark, given) == want
    assert search(spark, given, block=7) == want
    assert search(spark, [], block=7) == []


def test_topk_wide_values_and_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 6, 12]) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 0.1) for _ in range(700)]) for i in range(30)]
    found = search(spark, [(*r, "", "") for r in rows], 7)
    ends = (-(1 << 63), (1 << 63) - 1)
    want = []
    for i, r, j, s in plain_topk(rows, lambda i: i % 5 == 0, 7):
        want.append((i, r, j, min(max(s, ends[0]), ends[1])))
    exact = {(i, r) for i, r, j, s in want if ends[0] < s < ends[1]}
    assert [f for f in found if f[:2] in exact] == [w for w in want if w[:2] in exact]
    assert [f[3] for f in found] == [w[3] for w in want]


def test_blocks_stop_early_and_only_with_proof(monkeypatch):
    monkeypatch.setattr(topk, "ROUND", 1024)
    rng = np.random.default_rng(7)
    base = rng.integers(-30, 31, (5, 32))
    x = np.concatenate([base[rng.integers(5, size=900)] + rng.integers(-1, 2, (900, 32)), rng.integers(-30, 31, (1100, 32))])
    block = topk._Held(dict(zip(topk._NAMES, topk._pack(32, 0, list(range(2000)), list(range(2000)), x, True))))
    for q, share in ((0, 0.35), (3, 0.35), (950, 0.5), (1500, 0.5)):
        best = topk._Best(20)
        read = topk.search_block(block, x[q], q, best)
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:20]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want
        assert 0 < read < x.size * share + 1500  # half of the products are positive
        # a second block of distant vectors is left without reading
        far = topk._Held(dict(zip(topk._NAMES, topk._pack(32, 1, [5000], [5000], -x[q : q + 1], True))))
        assert topk.search_block(far, x[q], q, best) == 0


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 27])
def test_scores_are_exact_at_every_size(scale):
    """In doubles, longs and Python's integers; equal scores go by the smaller id, also across blocks."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 24)) * scale + rng.integers(0, 2, (300, 24))
    parts = [(list(range(0, 300, 2)), x[::2]), (list(range(1, 300, 2)), x[1::2])]
    blocks = [topk._Held(dict(zip(topk._NAMES, topk._pack(24, i, ids, ids, rows, True)))) for i, (ids, rows) in enumerate(parts)]
    for q in (0, 7, 150):
        best = topk._Best(20)
        for block in blocks:
            topk.search_block(block, x[q], q, best)
        exact = [sum(a * b for a, b in zip(r, x[q].tolist())) for r in x.tolist()]
        want = sorted((-s, i) for i, s in enumerate(exact) if i != q)[:20]
        assert list(zip((-best.score).tolist(), best.id.tolist())) == want


def test_few_of_many_scores_are_sorted(monkeypatch):
    """What cannot be among the best is left out before the sort by score and id."""
    x = np.random.default_rng(6).integers(-40, 40, (4000, 8))
    block = topk._Held(dict(zip(topk._NAMES, topk._pack(8, 0, list(range(4000)), list(range(4000)), x, True))))
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    best = topk._Best(5)
    best.add(block.scores(x[0], np.arange(4000)), block, np.arange(4000))
    assert best.score.tolist() == sorted((x @ x[0]).tolist(), reverse=True)[:5] and max(sorted_rows) < 100


# --- periodic runs ---


def plain_runs(words, least=12):
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, 2 * p):
                part = words[i : i + n]
                if next(q for q in range(1, n + 1) if part[q:] == part[: n - q]) == p:
                    found.append((i, n, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_op12(doc_id, text, loops=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if loops and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in found), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
        digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


COLUMNS12 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(60), rng.choice([1, 2, 2, 3, 4])
        words = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            a, p = rng.randrange(n - 6), 1 + rng.randrange(6)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        least = rng.choice([2, 4, 5, 12])
        assert runs.runs_of_text(np.array(words, np.int32), least) == plain_runs(words, least)


def test_runs_query(spark, sf_dir):
    """Against the plain version on every document of at most 1,500 words, and on all for the counts."""
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS12) for r in QUERIES["op12_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        if len((r["text"] or "").split()) <= 1500:
            assert found[r["doc_id"]] == plain_op12(r["doc_id"], r["text"])
    assert sum(f[1] > 0 for f in found.values()) >= 10


def test_runs_edge_cases(spark):
    long = " ".join(str(i) for i in range(30_000))
    loop = " ".join("a b c d e f g h".split() * 5)
    texts = [None, "", " \t\n", "one", "x " * 11, "x " * 12, "A a " * 6, "  " * 20, long, f"{long} {loop} {long}", loop, loop]
    texts += ["a b\x0bc\x0cd\re\tf\ng " * 2, "a b c d e f " * 2, "word\x1cword " * 12]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, loop, "x", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int")
    found = runs.find_runs(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["n_words"] in (0, 40)
            continue
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", texts[r["doc_id"]] or "") if w]
        short = words if len(words) < 1000 else None
        got = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert r["n_words"] == len(words)
        if short is not None:
            assert got == plain_runs(short)
        else:
            assert got == ([(30_000, 40, 8)] if "a b c" in texts[r["doc_id"]] else [])
    looped = {r["doc_id"]: r["text"] for r in runs.loop_tails(df.filter("doc_id IS NOT NULL")).collect()}
    assert all(looped[i] is None or len(looped[i].split()) == len((texts[i] or "").split()) for i in looped)
    assert runs.find_runs(df.limit(0)).count() == runs.loop_tails(df.limit(0)).count() == 0


def test_looping_texts(spark, tmp_path):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(i % 90))) for i in range(400)] + [(1000, None), (1001, " "), (-3, "a b\tc " * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op12_runs"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS12) for r in found} == {i: plain_op12(i, t) for i, t in texts}


# --- conversation repair ---


def plain_edits(codes):
    """Shortest path over (cost, initials)."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, used, place = heapq.heappop(heap)
        if (used, place) in seen:
            continue
        seen.add((used, place))
        if used == len(codes) and place in (0, 2):
            return cost, audit
        code = codes[used] if used < len(codes) else None
        legal = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 3}, 3: {"a": 2}}[place]
        steps = [("I", 2, 0, legal[r]) for r in legal if r != "s"]
        if code:
            role, must, cut = code
            steps.append(("D", 3, 1, place))
            if not must:
                steps += [("R", 2 + cut, 1, legal[r]) for r in legal if r != "s"]
                steps += [("K", cut, 1, legal[role])] if role in legal else []
        for initial, extra, uses, to in steps:
            heapq.heappush(heap, (cost + extra, audit + initial, used + uses, to))


BLANK = " \t\n\v\f\r"


def plain_op13(rows):
    """Rows (conv_id, turn, role, text) to the results of the query."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, seen, codes = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in after:
            core = text.rstrip(BLANK)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_edits(codes)
        place, at, lines = 0, 0, []
        for e in audit:
            role, text = ("assistant" if place == 3 else "user"), ""
            if e != "I":
                if e == "K":
                    role = after[at][1]
                text, at = after[at][2], at + 1
            if e != "D":
                place = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 3}, 3: {"a": 2}}[place][role[:1]]
                lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


COLUMNS13 = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conv(df):
    rows = df.collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS13) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_repair_query(spark, folder):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert by_conv(QUERIES["op13_repair"](spark, folder)) == plain_op13(rows)


def test_repair_edge_cases(spark, tmp_path):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "Uber", "ally"], ["Yes.", "No", None, "", " \n", "Why? ", "End!\v", "…", "é."]
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 60)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    rows += [(500, i, rng.choice(["user", "assistant", "user"]), f"t{i}.") for i in range(900)]  # more than one part
    rows += [(501, 3, "user", "same.")] * 40 + [(502, None, "user", "a.")] * 3 + [(503, None, None, None)]
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "a.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, position int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = by_conv(QUERIES["op13_repair"](spark, str(tmp_path)))
    assert found == plain_op13(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_an_empty_table(spark):
    turns, found = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert turns.count() == found.count() == repair.digests(turns).count() == 0


def test_repaired_turns_keep_to_the_pattern(spark, sf_dir):
    turns, _ = repair.repair(repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    convs: dict = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["place"])):
        convs.setdefault(r["conv_id"], []).append(r["role"][0])
    assert convs and all(re.fullmatch("s?(ua)+", "".join(c)) for c in convs.values())


def test_search_in_parts_is_the_same(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        codes = "".join(rng.choice("suaoSUAxua") for _ in range(rng.randrange(14)))
        want = plain_edits([(c.lower(), c == "x", int(c.isupper())) for c in codes])
        assert repair.cheapest(codes) == want
        monkeypatch.setattr(repair, "PART", rng.choice([1, 2, 5]))
        whole = repair.Search()
        for c in codes:
            whole.add(c)
        assert whole.close() == want
