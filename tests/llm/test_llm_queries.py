"""The queries that have SQL against it, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import pytest
from compare import compare, duck

import corpus_pipeline
from patchlens.llm import decontaminate, shingles, simhash
from patchlens.llm.queries import ORACLE, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What goes into each stage and comes out."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        out[name] = docs, spark.read.parquet(str(folder / name))
        docs = out[name][1]
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, (_, after) in stages.items():
        assert after.columns == COLUMNS or name == "packing"


def test_language_stage(stages):
    before, after = stages["language"]
    identified = before.filter("text RLIKE '[a-zA-Z]'").count()
    assert 0.98 * identified <= after.count() <= before.count()


def test_line_stage(stages):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in stages["line_dedup"])
    assert set(after) <= set(before)
    seen = set()
    for i in sorted(after):
        assert after[i]["n_chars"] == len(after[i]["text"])
        lines = [line for line in after[i]["text"].split("\n") if len(line.split()) >= 20]
        assert not seen & set(lines)
        seen |= set(lines)
        assert set(after[i]["text"].split("\n")) <= set(before[i]["text"].split("\n"))


def test_near_stage(spark, sf_dir, stages, tmp_path):
    """Rows kept by the stage, with planted near copies, against links of fingerprints and of similarity."""
    rows = [tuple(r[c] for c in COLUMNS) for r in stages["near_dedup"][0].collect()]
    long = [r for r in rows if len(r[1].split()) > 120][:12]
    for n, (i, text, lang, source, _) in enumerate(long):
        words = text.split(" ")
        for copy in range(3):
            words[(37 * (copy + 1)) % len(words)] = f"changed{copy}"
            new = " ".join(words)
            rows.append((1_000_000 + 10 * n + copy, new, lang, source, len(new)))
    before = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, before, sf_dir).collect()}
    ids = sorted(r[0] for r in rows)
    texts = {r[0]: r[1].encode() for r in rows}
    prints = {i: simhash.simhash(t) for i, t in texts.items()}
    sets = {i: set(shingles.shingle_set(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            near = (prints[a] ^ prints[b]).bit_count() <= 3
            if near or sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    assert kept == {i for i in ids if parent[i] == i}
    assert len(kept) <= len(rows) - 30


def test_benchmark_stage(spark, sf_dir, stages):
    before, after = stages["decontaminate"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.scan(before, items).filter("n_hit > 0").collect()}
    first, then = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (before, after))
    assert hit
    for i in first:
        if i not in hit:
            assert then[i] == first[i]
        elif i in then:
            assert then[i] != first[i]
    assert decontaminate.scan(after, items).filter("n_hit > 0").count() == 0


def test_packing_stage_and_run(spark, sf_dir, stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(whole.collect()) == sorted(after.select(*whole.columns).collect())
