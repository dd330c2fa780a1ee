"""The training-data operators against plain versions, on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlens.llm import chat, common, decontaminate, importance, language, licenses, linedup, packing, simhash, vectors, warc

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hits string, component_id long"
ODD = [
    (1, "The same text, the same text again and again.", "en"),
    (2, "The same text, the same text again and again.", "en"),
    (2, "The same text, the same text again and again.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "de"),
    (None, "Ein Text ohne Nummer.", "de"),
    (None, None, None),
    (6, "word " * 40_000, "en"),
    (7, "x" * 100_000, None),
    (8, "日本語 テキスト <|endoftext|> é\x00\x1f", "ja"),
]


def table(spark, rows=ODD):
    return spark.createDataFrame([(i, t, la, "s", 0, "own", -1) for i, t, la in rows], DOCS)


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


# components


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    edges = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in common.connected_components(edges).collect()}
    want = groups({x for e in links for x in e}, links)
    assert {i: found.get(i, i) for i in want} == want
    assert not {i for i in found if found[i] == i}


def test_word_lists_of_parts():
    data = "Ab c\n é-9 xyz ".encode() * 50
    assert [w for p in common.word_lists(data, common.SPACED, 16) for w in p] == data.lower().split()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower())
    assert [w for p in common.word_lists(data, common.WORDED, 16) for w in p] == words


# 1 SimHash


def test_simhash_parts(monkeypatch):
    text = " ".join(f"w{i % 97}{i}" for i in range(3000))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "PART", 7)
    monkeypatch.setattr(simhash, "word_lists", lambda d, t: common.word_lists(d, t, 64))
    assert simhash.simhash(text.encode()) == whole
    assert whole % (1 << 64) == plain_print(text)


@pytest.mark.parametrize("limit", [simhash.CELL_ROWS, 4])
def test_simhash_groups(spark, sf_dir, monkeypatch, limit):
    """All links are found, also when cells are larger than one task takes."""
    monkeypatch.setattr(simhash, "CELL_ROWS", limit)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60).tolist()
    near = [b ^ (1 << int(x)) ^ (1 << int(y)) for b in base[:6] for x, y in rng.integers(0, 62, (30, 2))]
    prints = sorted({*base, *near, 0, 7, 15})
    links = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = simhash.near_links(df).collect()
    assert {(r["a"] ^ r["b"]).bit_count() <= 3 for r in found} <= {True}
    assert groups(prints, [tuple(r) for r in found]) == groups(prints, links)


def test_simhash_query(spark, sf_dir):
    from patchlens.llm.queries import op1_simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = groups(prints, links)
    found = {tuple(r) for r in op1_simhash(spark, sf_dir).collect()}
    assert found == {(i, f"{prints[i]:016x}", group[i]) for i in prints}


def test_simhash_odd_rows(spark):
    found = simhash.near_duplicates(table(spark)).collect()
    assert len(found) == len(ODD)
    empty = {r["component_id"] for r in found if r["print"] == 0}
    assert empty == {3}
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.keep_first(table(spark))
    assert kept.columns == table(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 6, 7, 8]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_one_row_of_repeats_stays(spark):
    rows = [(1, "a b c d", "en")] * 3 + [(2, "e f g h i", "en")]
    assert sorted(r["doc_id"] for r in simhash.keep_first(table(spark, rows)).collect()) == [1, 2]


def test_texts_of_one_id_are_told_apart(spark):
    """Only the text that is near another goes, and unrelated texts of one id stay."""
    rows = [(1, "a b c d", "en"), (2, "A B c d", "en"), (2, "one unique clean text", "en"), (3, "p q r s t", "en"), (3, "u v w x y", "en")]
    kept = simhash.keep_first(table(spark, [*rows, rows[3]])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((i, t) for i, t, _ in rows if t != "A B c d")


def test_near_copies_by_similarity(spark):
    """Copies of 0.8 or more in five-word runs go, whatever their fingerprints; those below stay."""
    rng = np.random.default_rng(4)
    words = [[f"w{x}" for x in rng.integers(0, 10**6, 200)] for _ in range(40)]
    rows, near = [], {}
    for i, own in enumerate(words):
        rows.append((i, " ".join(own), "en"))
        for j, n in enumerate((1, 3, 4, 5, 6, 20)):
            copy = list(own)
            for at in rng.choice(np.arange(2, 198, 5), n, replace=False):
                copy[at] = "other"
            rows.append((1000 + 10 * i + j, " ".join(copy), "en"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    prints = {i: plain_print(t) for i, t, _ in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    group = groups(sets, near + links)
    assert groups(sets, links) != group != {i: i for i in sets}
    kept = simhash.keep_first(table(spark, rows), similarity=Fraction(4, 5))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, g in group.items() if i == g)


def test_shingle_sets_over_parts(monkeypatch):
    from patchlens.llm import shingles

    text = " ".join(f"w{i % 97}" for i in range(400)).encode()
    whole = shingles.shingle_set(text).tolist()
    monkeypatch.setattr(shingles, "PART", 7)
    monkeypatch.setattr(shingles, "word_lists", lambda d, t: common.word_lists(d, t, 64))
    assert shingles.shingle_set(text).tolist() == whole and len(whole) == 97
    assert len(shingles.shingle_set(b"two words")) == 1 and len(shingles.shingle_set(b" \n")) == 0


# 2 packing


def test_tokens_are_those_of_the_library():
    encoder = packing.tokenizer(packing.VOCABULARY)
    assert encoder.fast
    texts = ["", " a  b", "It's 12 o'clock\n\n  x", "日本 é\x1c", "<|endoftext|>", " " * 3000 + "x"]
    for text in texts:
        want = encoder.slow.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want
        assert encoder.encode_long(text, 3).tolist() == want


@given(st.text(alphabet=" \n\tab'sé1.日", max_size=60), st.integers(1, 9))
def test_parts_give_the_same_tokens(text, part):
    encoder = packing.tokenizer(packing.VOCABULARY)
    assert encoder.encode_long(text, part).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 5000), st.integers(1, 1024))
def test_cut(n, context):
    pieces = packing.cut(n, context)
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    assert all(e - s == context for s, e in pieces[1:]) and pieces[0][1] <= context
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(1, 5), st.sampled_from(["norm", "dot"]), st.integers(64, 4096))
def test_best_fit_respects_every_capacity(lengths, max_docs, rule, attention):
    lengths = sorted((n for n in lengths if n * n <= attention), reverse=True) or [1]
    bins, offsets = packing.best_fit(np.array(lengths), 64, max_docs, attention, rule, (1.0, 0.5, 0.5))
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, at in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if at == b)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 64 and len(own) <= max_docs and sum(n * n for _, n in own) <= attention


def test_packing_query(spark, sf_dir):
    from patchlens.llm.queries import op2_packing

    rows = op2_packing(spark, sf_dir).collect()
    encoder = packing.tokenizer(packing.VOCABULARY)
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(encoder.slow.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (s, e) in enumerate(packing.cut(len(ids), 1024)):
            want[r["doc_id"], piece] = (s, e - s, zlib.crc32(ids[s:e].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    assert len(held) <= sum(r["length"] for r in rows) / 1024 * 1.01 + 2


def test_packing_odd_rows(spark):
    packed = packing.pack_documents(table(spark), with_ids=True)
    rows = packed.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _, _ in ODD)
    assert [r["ids"] for r in rows if r["doc_id"] == 3] == [[2]]
    assert all(len(r["ids"]) <= 1024 for r in packing.sequences(packed).collect())
    assert packing.pack_documents(table(spark, [])).count() == 0


# 3 chat


@given(st.text(alphabet="<>[]/\\SYINTROLEs ", max_size=40))
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), st.text(alphabet="<>[]/\\SYINTROLEs x", max_size=20)), max_size=6))
def test_turns_read_back(turns):
    text, spans = chat.Template(chat.TEMPLATE).render([{"role": r, "text": t} for r, t in turns])
    assert [(r, t) for r, t, _ in chat.parse_turns(text, spans)] == turns
    assert [chat.unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    render = lambda source, **names: "".join(_rendered(source, names))

    def _rendered(source, names):
        sink = chat.Sink()
        chat.compile_nodes(chat.fold(chat.parse(source)))(names, sink)
        return sink.parts

    assert render("{{ 1 + 2 * 3 }}{{ 'a' ~ 2 }}{# no #}") == "7a2"
    assert render("a {%- if x.y == 'z' or not x -%} b {%- else -%} c {%- endif %}", x={"y": "z"}) == "ab"
    assert render("{% for m in ms %}{{ loop.index }}{{ m['k'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}]) == "1A,2B"
    assert render("{% set n = 3 %}{{ 'odd' if n % 2 == 1 else 'even' }}{{ 2 not in n2 }}", n2=[1]) == "oddTrue"
    tree = chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if 1 > 2 %}{{ x }}{% endif %}"))
    assert tree == [chat.Output(chat.Const("abc"))]
    for bad in ("{% if x %}", "{{ x.__class__ }}", "{{ x | nope }}", "{% endfor %}", "{{ 1 + }}", "{{ 'a' * 9 }}"):
        with pytest.raises(chat.TemplateError):
            chat.fold(chat.parse(bad))
    assert render("{{ x.mro }}{{ x.a }}", x=str) == ""


def test_chat_odd_rows(spark):
    rows = [(1, 1, "user", None), (1, None, "system", "s"), (1, 1, "user", None), (None, 0, None, "[INST]"), (2, 5, "assistant", "x" * 50_000), (3, 0, "user", "")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: v["n_turns"] for k, v in found.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\n\nuser\n\n").hexdigest()
    assert found[None]["turns_sha256"] == hashlib.sha256(b"\n[INST]\n").hexdigest()
    assert found[2]["loss_chars"] == 50_000 and found[3]["loss_chars"] == 0
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(df, "{{ messages[0].text }}")


# 4 importance


def test_importance_query(spark, sf_dir):
    from patchlens.llm.queries import op4_importance

    found = op4_importance(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    good = set(labels.doc_id[(labels.quality == 1) & (labels.toxic == 0)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    target, raw, buckets = Counter(), Counter(), {}
    mix, mask, drop = 0x9E3779B97F4A7C15, (1 << 64) - 1, 64 - 18
    for r in docs.itertuples():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(TABLE))
        codes = [zlib.crc32(w.encode()) for w in words]
        some = [c * mix & mask for c in codes] + [((a * mix + b + 1) & mask) * mix & mask for a, b in zip(codes, codes[1:], strict=False)]
        buckets[r.doc_id] = Counter(c >> drop for c in some)
        raw.update(buckets[r.doc_id])
        if r.doc_id in good:
            target.update(buckets[r.doc_id])
    weight = found.set_index("doc_id").log_weight
    for i, own in buckets.items():
        n_target = sum(target.values()) - (sum(own.values()) if i in good else 0)
        share = n_target / (sum(raw.values()) - sum(own.values()))
        want = 0.0
        for b, n in own.items():
            t = target[b] - (n if i in good else 0) + importance.SMOOTHING * share
            want += n * np.log(t / (raw[b] - n + importance.SMOOTHING) / share)
        assert abs(weight[i] - want) < 1e-6
    k = round(len(good) / labels.doc_id.nunique() * len(docs))
    assert set(found.nlargest(k, "key").doc_id) == set(found.doc_id[found.selected])


def test_importance_separates(spark):
    from patchlens.llm.queries import op4_importance

    folder = "/root/testdata/sf0.1"
    chosen = op4_importance(spark, folder).toPandas().set_index("doc_id").selected
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    good, toxic = labels.doc_id[(labels.quality == 1) & (labels.toxic == 0)], labels.doc_id[labels.toxic == 1]
    assert chosen[toxic].mean() < 0.45 < 0.8 < chosen[good].mean()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(0, 70))
def test_kth_largest(spark, values, k):
    least = importance.smallest_of_top(spark.createDataFrame([(v,) for v in values], "key double"), "key", k, parts=4)
    want = None if k >= len(values) else float("inf") if k == 0 else sorted(values, reverse=True)[k - 1]
    assert least == want


def test_importance_odd_rows(spark):
    ids = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    found = importance.resample(table(spark), ids, 0.5).collect()
    assert len(found) == len(ODD)
    assert {r["log_weight"] for r in found if r["doc_id"] in (3, 4, 5)} == {0.0}
    assert len({r["selected"] for r in found if r["doc_id"] == 2}) == 1
    assert importance.resample(table(spark, []), ids, 0.5).count() == 0


# 5 WARC


def test_warc_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    same = "".join(map(str, rng.integers(0, 10, 1500)))
    rows = [(i, f"http://a/{i}", "".join(map(str, rng.integers(0, 10, 3000)))) for i in range(40)]
    rows += [(100, None, same), (101, "http://x/\r\ny", same), (101, "http://x/", same), (102, "u", None), (None, "n", same), (103, "é", "é" * 400), (104, "", "é" * 400)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")
    records = warc.payloads(df)
    for folder in ("one", "two"):
        warc.write_archive(records, warc.revisits(records), str(tmp_path / folder), file_bytes=8000)
    files = sorted(p.name for p in (tmp_path / "one/records").iterdir())
    assert len(files) > 4 and all(f.endswith(".warc.gz") for f in files if not f.startswith("."))
    for f in files:
        assert (tmp_path / "one/records" / f).read_bytes() == (tmp_path / "two/records" / f).read_bytes()
    (tmp_path / "one/records/shard-000000-00099.warc.gz").write_bytes(b"of a lost task")
    found = warc.read_archive(spark, str(tmp_path / "one")).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert by_id[100] == [("revisit", 101)] and by_id[None] == [("revisit", 101)]
    assert by_id[101] == [("response", None)] * 2
    assert by_id[103] == by_id[104] == [("response", None)]  # under the size
    for r in found:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    html = {(i, h or "") for i, _, h in rows if i is not None and i < 100 or i == 102}
    assert html <= {(r["page_id"], (r["payload"] or b"").decode()) for r in found}
    empty = warc.payloads(df.limit(0))
    warc.write_archive(empty, warc.revisits(empty), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archive_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string")
    records = warc.payloads(df)
    warc.write_archive(records, warc.revisits(records), str(tmp_path / "a"))
    file = next(p for p in (tmp_path / "a/records").iterdir() if p.suffix == ".gz")
    file.write_bytes(file.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


# 6 language


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = f" {' '.join(words)} " if words else ""
    found = Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1))
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return found


def plain_top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: language.PROFILE]]


def test_language_query(spark, sf_dir):
    from patchlens.llm.queries import op6_language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    counts = {}
    for r in docs:
        if not held[r["doc_id"]] and r["lang"]:
            counts.setdefault(r["lang"], Counter()).update(plain_ngrams(r["text"]))
    profiles = {lang: {g: i for i, g in enumerate(plain_top(c))} for lang, c in sorted(counts.items())}
    found = {r["doc_id"]: r for r in op6_language(spark, sf_dir).collect()}
    for r in docs:
        top, got = plain_top(plain_ngrams(r["text"])), found[r["doc_id"]]
        out = {lang: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(out, key=lambda lang: (out[lang], lang)) if top else "und"
        assert (got["held_out"], got["lang_pred"]) == (held[r["doc_id"]], best)
        assert not top or got["score"] == pytest.approx(1 - out[best] / (300 * len(top)))
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs if held[r["doc_id"]]]
    assert sum(right) / len(right) > 0.98


def test_language_odd_rows(spark):
    found = language.identify(table(spark)).collect()
    assert len(found) == len(ODD)
    assert {(r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (3, 4, 5)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language.identify(table(spark, [])).count() == 0
    assert language.keep_identified(table(spark)).columns == table(spark).columns
    no_lang = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(no_lang).collect()} == {"und"}


# 7 line dedup


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = linedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert pairs == [(i, i) for i in range(len(a))]


def _covered(a, words, b, least):
    """Lines of ``a`` in a run of ``least`` words or more that stands in ``b`` as well."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
                if sum(words[i : i + n]) >= least:
                    out.update(range(i, i + n))
    return out


@settings(max_examples=150, deadline=None)
@given(st.permutations(range(10)), st.permutations(range(10)), st.integers(1, 4))
def test_moved_blocks_are_found(a, b, least):
    a, words = a[:8], [1] * 8
    found = linedup.common_blocks(list(a), words, list(b), least)
    assert set(found) == _covered(a, words, b, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=10), st.lists(st.integers(0, 3), max_size=10))
def test_blocks_stand_in_both(a, b):
    assert set(linedup.common_blocks(a, [1] * len(a), b, 2)) <= _covered(a, [1] * len(a), b, 2)


def test_line_dedup_query(spark, sf_dir):
    """Every line run of 20 words that an earlier document has is gone, and nothing but common runs."""
    from patchlens.llm.queries import op7_linedup

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: r["text"] for r in op7_linedup(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    least, runs, earlier, changed = linedup.MIN_WORDS, {}, {}, 0
    for i in sorted(docs):
        lines = docs[i].split("\n")
        full = [n for n, x in enumerate(lines) if x.split()]
        keys = [" ".join(lines[n].split()) for n in full]
        words = [len(k.split()) for k in keys]
        must, partners = set(), set()
        for s, e in linedup.shortest_runs(words, least):
            first = runs.setdefault(tuple(keys[s:e]), i)
            if first != i:
                must.update(range(s, e))
                partners.add(first)
        may = set().union(*(_covered(keys, words, earlier[p], least) for p in partners))
        earlier[i] = keys
        kept = found[i].split("\n") if found[i] else []
        gone = Counter(lines) - Counter(kept)
        assert not Counter(lines[full[n]] for n in must) - gone
        assert not gone - Counter(lines[full[n]] for n in may) - Counter({"": len(lines)})
        changed += bool(must)
    assert changed > 5


def test_line_dedup_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven\n" * 2 + "twelve thirteen fourteen"
    rows = [*ODD, (10, "own line\n" + passage, "en"), (11, passage + "\nother line", "en"), (12, passage, "en"), (12, passage, "en"), (None, passage, "en")]
    df = table(spark, rows)
    out = linedup.delete_repeated(df, length_col="n_chars")
    assert out.columns == df.columns
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (10, "own line\n" + passage) in texts and (11, "other line") in texts and (None, passage) in texts
    assert not [t for t in texts if t[0] == 12]
    assert {r["n_chars"] for r in out.filter("doc_id = 11").collect()} == {10}
    assert (3, None) in texts and (4, "") in texts
    assert linedup.delete_repeated(table(spark, [])).count() == 0


# 8 vectors


def plain_links(rows, threshold=vectors.THRESHOLD):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x)
    return [(a, b) for a, b in combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]


@pytest.mark.parametrize("block", [4096, 40])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "LEAF", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 12))
    near = base[:20].repeat(4, axis=0) + rng.normal(size=(80, 12)) * 0.15
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near]))]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [float("nan")] * 12), (304, [None, *[1.0] * 11]), (305, [float("inf")] * 12)]
    rows += [(306, rows[0][1]), (307, [1e-300 * x for x in rows[1][1]]), (308, [1e300 * x for x in rows[1][1]]), (309, rows[2][1][:5]), (310, [*rows[2][1][:5], 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, size int")
    links = plain_links(rows)
    group, degree = groups([i for i, _ in rows], links), Counter(x for e in links for x in e)
    found = {tuple(r) for r in vectors.near_vectors(df, block=block).collect()}
    assert found == {(i, degree[i], group[i], group[i] == i) for i, _ in rows}
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(df.filter("vec_id = 302")).collect()] == [(302, 0, 302, True)]


def test_distant_blocks_are_skipped(spark):
    boxes = [(i, [float(i), 0.0], [i + 0.5, 1.0]) for i in range(100)]
    df = spark.createDataFrame(boxes, "number long, low array<double>, high array<double>")
    found = {tuple(r) for r in vectors.near_blocks(df, 100, 0.3).collect()}
    assert found == {(i, j) for i in range(100) for j in (i, i + 1) if j < 100}


# 9 decontamination


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=4),
    st.lists(st.sampled_from("abcx"), max_size=40),
    st.integers(1, 5),
)
def test_automaton(items, words, window):
    automaton = decontaminate.Automaton([(i, [w.encode() for w in item]) for i, item in enumerate(items)], window)
    n, windows = automaton.matches(" ".join(words).encode())
    want = set()
    for i, item in enumerate(items):
        size = min(window, len(item))
        for at in range(len(item) - size + 1) if size else ():
            want |= {(p, p + size, i) for p in range(len(words) - size + 1) if words[p : p + size] == item[at : at + size]}
    assert n == len(words)
    assert {(s, e, i) for s, e, found in windows for i in found} == want


def test_automaton_over_parts(monkeypatch):
    automaton = decontaminate.Automaton([(1, [b"a", b"b", b"c", b"d"])], 3)
    data = b"x a b c d y " * 20
    whole = automaton.matches(data)
    monkeypatch.setattr(decontaminate, "word_lists", lambda d, t: common.word_lists(d, t, 5))
    assert automaton.matches(data) == whole and len(whole[1]) == 40


def test_benchmark_in_blocks(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r)[:4] for r in decontaminate.scan(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    assert {tuple(r)[:4] for r in decontaminate.scan(docs, items).collect()} == whole


def test_decontamination_odd_rows(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "Short, item"), (3, None), (None, "none"), (4, ""), (2, "short item")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(40))
    rows = [*ODD, (20, f"{long} {item}! the end.", "en"), (21, item, "en"), (22, f"A {long} SHORT-item b.", "en")]
    df = table(spark, rows)
    found = {r["doc_id"]: r for r in decontaminate.scan(df, items).collect() if r["doc_id"]}
    assert (found[20]["n_hit"], found[20]["items"]) == (11, [1])
    assert (found[22]["n_hit"], found[22]["items"]) == (2, [2])
    assert found[3]["n_words"] == 0 and found[6]["n_hit"] == 0
    out = decontaminate.remove_hits(df, items, length_col="n_chars")
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"]}
    assert texts[20] == f"{long} ! the end." and texts[22] == f"A {long}  b." and 21 not in texts
    assert texts[1] == ODD[0][1] and texts[3] is None
    assert out.filter("doc_id = 20").first()["n_chars"] == len(texts[20])
    assert decontaminate.remove_hits(table(spark, []), items).count() == 0
    assert decontaminate.remove_hits(df, items.limit(0)).count() == df.count()


# 10 licenses


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6), st.lists(st.sampled_from("abcdefx"), max_size=8), st.sampled_from([Fraction(1, 2), Fraction(4, 5), Fraction(1)]))
def test_set_join_is_exact(template, block, threshold):
    frequency = {w.encode(): ord(w) % 3 for w in "abcdef"}
    join = licenses.Join({"t": " ".join(template), "u": "a b"}, frequency, threshold)
    found = join.matches([w.encode() for w in block])
    want = {}
    for label, words in (("t", set(template)), ("u", {"a", "b"})):
        if Fraction(len(words & set(block)), len(words)) >= threshold:
            want[label] = len(words & set(block)) / len(words)
    assert found == want


@given(st.lists(st.sampled_from(["cc", "by", "x"]), max_size=20), st.integers(1, 9))
def test_phrases_over_parts(words, part):
    sought = [(b"cc by", "p"), (b"by cc by", "q")]
    text = " ".join(words).encode()
    join = licenses.Join({}, {})
    whole = licenses._scan_text(text, sought, join)
    places = [i for i in range(len(words)) for p in (["cc", "by"], ["by", "cc", "by"]) if words[i : i + len(p)] == p]
    assert (whole["n_words"], whole["n_base"]) == (len(words), len(places))
    assert (whole["first_word"], whole["last_word"]) == (min(places, default=None), max(places, default=None))
    lists = licenses.word_lists
    licenses.word_lists = lambda d, t: common.word_lists(d, t, part)
    try:
        assert licenses._scan_text(text, sought, join) == whole
    finally:
        licenses.word_lists = lists


def test_license_odd_rows(spark):
    rows = [*ODD, (30, "x\nLicensed under the Apache License, Version 2.0.\nAll Rights\tReserved; cc-by cc by", "en"), (31, "Licensed under the\nApache License", "en")]
    found = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect() if r["doc_id"]}
    assert found[30]["base_labels"] == "cc-by,reserved" and found[30]["n_base"] == 3
    assert found[30]["labels"] == "apache-2.0,cc-by,reserved" and found[30]["score"] == 1.0
    assert found[31]["labels"] == "" and found[31]["score"] == 0.0
    assert found[3]["n_words"] == 0 and found[3]["first_word"] is None
    assert licenses.scan(table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6), st.lists(st.sampled_from("abcdefxyz"), max_size=40), st.sampled_from([Fraction(1, 2), Fraction(4, 5), Fraction(1)]))
def test_every_window_is_held_against_the_templates(template, words, threshold):
    frequency = {w.encode(): ord(w) % 3 for w in "abcdef"}
    join = licenses.Join({"t": " ".join(template), "u": "a b"}, frequency, threshold)
    places = [i for i, w in enumerate(words) if w in "abcdef"]
    found = {}
    for _, label, share in join.passages(places, [join.order[words[i].encode()] for i in places]):
        found[label] = max(share, found.get(label, 0))
    want = {}
    for label, own in (("t", template), ("u", ["a", "b"])):
        width = -(-len(own) * threshold.denominator // threshold.numerator)
        share = max((Fraction(len(set(own) & set(words[i : i + width])), len(set(own))) for i in range(len(words))), default=0)
        if share >= threshold:
            want[label] = float(share)
    assert found == want


def test_wrapped_license_headers(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"
    gpl = "x\n# This work is licensed under the GNU\n# General Public License\n# version 3\n"
    bsd = "x\ny\n// Use of this source code is governed by\n// a BSD 3-Clause\n// license.\n"
    scattered = " and far ".join("Licensed under the Apache License Version 2.0".split())
    rows = [(40, mpl, "en"), (41, gpl, "en"), (42, bsd, "en"), (43, scattered, "en"), (44, gpl.replace("\n# ", " "), "en")]
    found = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect()}
    assert found[40]["labels"] == "mpl-2.0" and found[40]["blocks"][0]["line"] == 0
    assert "gpl-3.0" in found[41]["labels"].split(",") and found[41]["labels"] == found[44]["labels"] and found[41]["blocks"][0]["line"] == 1
    assert found[42]["labels"] == "bsd-3-clause" and found[42]["blocks"][0]["line"] == 2
    assert found[43]["labels"] == "" and found[43]["score"] == 0.0


def _family(rng, n, words, low, high):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(low, high)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def _classes(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(
    ("families", "group", "cells", "meetings"),
    [
        ([(300, 60, 1, 2)], 4096, 1 << 22, 3), ([(300, 60, 1, 2)], 16, 1 << 12, 1), ([(300, 200, 3, 6)], 64, 1 << 14, 1),
        ([(300, 200, 4, 5)], 4096, 1 << 22, 3), ([(1000, 200, 0, 4)], 128, 1 << 15, 2), ([(17, 60, 0, 3)] * 10, 8, 1 << 9, 3),
    ],
)
def test_similar_links_lose_no_connection(spark, families, group, cells, meetings):
    from patchlens.llm import shingles

    rng = random.Random(len(families))
    texts = list(dict.fromkeys([t for f in families for t in _family(rng, *f)] + ["", " \n", "a b", "one two three four five", None]))
    sets = [set(shingles.shingle_set((t or "").encode()).tolist()) for t in texts]
    true = {(j, i) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    rows = [(i, None if t is None else t.encode(), "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows * 2, "mark long, data binary, key string")
    found = {tuple(sorted(r)) for r in shingles.similar_links(df, group=group, cells=cells, meetings=meetings).collect()}
    assert found <= true
    assert _classes(len(texts), found) == _classes(len(texts), true)


def test_links_do_not_depend_on_the_order_of_shingles(spark, monkeypatch):
    """What ``common_shingles`` counts sets the order only: any order, and none, connects the same texts."""
    from patchlens.llm import shingles

    rng = random.Random(5)
    texts = [t for _ in range(4) for t in _family(rng, 40, 60, 0, 3)]
    sets = [set(shingles.shingle_set(t.encode()).tolist()) for t in texts]
    true = {(j, i) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    every = np.array(sorted(set().union(*sets)), np.int64)
    drawn = np.random.default_rng(5).integers(1, 1000, len(every))
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "mark long, data binary")
    for common, rank in ((every[:0], drawn[:0]), (every, drawn), (every[::7], drawn[::7])):
        monkeypatch.setattr(shingles, "common_shingles", lambda texts, width, found=(common, rank): found)
        found = {tuple(sorted(r)) for r in shingles.similar_links(df, group=64, cells=1 << 12, meetings=1).collect()}
        assert found <= true
        assert _classes(len(texts), found) == _classes(len(texts), true)


@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=40), st.sets(st.integers(-(2**63), 2**63 - 1), max_size=40))
def test_signatures_differ_no_more_than_sets(own, other):
    from patchlens.llm import shingles

    x, y = (shingles.signature(np.array(sorted(s), np.int64)) for s in (own, other))
    bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    assert bits <= len(own ^ other)
    if own and other and 5 * len(own & other) >= 4 * len(own | other):
        assert shingles._signed(Fraction(4, 5), len(own), len(other), bits)


def test_chance_meetings_move_no_sets(spark, monkeypatch):
    """Texts that have only a passage in common are settled by their signatures; similar ones are still linked."""
    from patchlens.llm import shingles

    written = {}

    def counted(df, name):
        found = materialize(df, name)
        written[name] = written.get(name, 0) + found.count()
        return found

    materialize = shingles.materialize
    monkeypatch.setattr(shingles, "materialize", counted)
    rng = random.Random(8)
    own = [[f"w{rng.randrange(10**6)}" for _ in range(50)] for _ in range(120)]
    texts = [" ".join(own[40 + i] + own[i // 2]) for i in range(77)]  # two by two half alike
    texts += [f"{t} more" for t in texts[:3]]
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "mark long, data binary").repartition(3)
    found = {tuple(sorted(r)) for r in shingles.similar_links(df).collect()}
    assert found == {(i, 77 + i) for i in range(3)}
    assert written["shingle-sets"] <= 12 and written.get("shingle-sent", 0) == 0


CLASHING = ["_rep_lines", "_rep_changed", "_repeated_id", "_repeated_lines", "_repeated_changed", "_near_id", "_near_mark", "_near_stays", "_NEAR_ID", "_hits", "n", "stays", "mark", "first", "root"]


def test_clashing_columns_pass_through_the_stages(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(12)) for i in range(3))
    texts = [f"first text {passage}", f"own words\n{passage}\nmore of them", "a b c", "a b c", None, "", " ".join(f"q{i}" for i in range(30))]
    rows = [(i, t, *[f"{c}{i}" for c in CLASHING if c != "_NEAR_ID"]) for i, t in enumerate(texts)]
    names = ["doc_id", "text", *[c for c in CLASHING if c != "_NEAR_ID"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(5, 20)))], "item_id long, text string")
    lines = linedup.delete_repeated(docs)
    assert lines.columns == names and lines.count() == 7
    near = simhash.keep_first(docs)
    assert near.columns == names and sorted(r["doc_id"] for r in near.collect()) == [0, 1, 2, 4, 6]
    clean = decontaminate.remove_hits(docs, items)
    assert clean.columns == names
    kept = {r["doc_id"]: r for r in clean.collect()}
    assert set(kept) == {0, 1, 2, 3, 4, 5, 6} and kept[6]["text"].split() == [f"q{i}" for i in [*range(5), *range(20, 30)]]
    assert all(kept[i][c] == f"{c}{i}" for i in kept for c in names[2:])


def test_benchmark_in_several_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    into = ["n_words", "spans", "items", "rest"]

    def found(**options):
        rows = decontaminate.find_windows(docs.select("doc_id", "text"), items, cut=True, **options).collect()
        return {r["doc_id"]: tuple(r["hits"][c] for c in into) for r in rows}

    one = found()
    assert any(r[1] for r in one.values()) and found(item_bytes=3000) == one


def test_vectors_of_many_sizes_and_wide_ones(spark):
    rng = np.random.default_rng(3)
    wide = rng.normal(size=vectors.MAX_WIDTH + 5)
    rows = [(1, wide.tolist()), (2, (wide + 0.01 * rng.normal(size=len(wide))).tolist()), (3, rng.normal(size=len(wide)).tolist())]
    rows += [(10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [1.0]), (30, [0.0, 0.0]), (31, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    alone = {i: (0, i, True) for i in (3, 12, 20, 21, 30, 31)}
    assert found == alone | {1: (1, 1, True), 2: (1, 1, False), 10: (1, 10, True), 11: (1, 10, False)}


def test_a_standing_file_of_the_same_bytes_is_left(tmp_path):
    def write(attempt, records):
        roller = warc._Roller(f"file://{tmp_path}", 0, attempt, 1 << 20, 6, warc.DATE)
        for i in range(records):
            list(roller.add(i, b"record %d" % i))
        return roller.close()

    first = write(1, 3)
    path = tmp_path / first[0]
    inode = path.stat().st_ino
    assert write(2, 3) == first and path.stat().st_ino == inode
    other = write(3, 4)
    assert path.stat().st_size == other[4] and hashlib.sha256(path.read_bytes()).hexdigest() == other[5]
    assert [p.name for p in tmp_path.iterdir()] == [first[0]]


def test_every_capacity_takes_part_in_the_choice():
    lengths = np.array([778, 700, 670, 521, 385, 78, 52])
    scalar, whole = packing.best_fit(lengths, weights=(1, 0, 0))[0].tolist(), packing.best_fit(lengths)[0].tolist()
    assert scalar == [0, 1, 2, 3, 3, 3, 0]
    assert whole == [0, 1, 2, 3, 3, 0, 0]  # tokens alone would say 3, which has more attention left
