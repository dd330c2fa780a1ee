"""One query for each operator, over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import chat, decontaminate, importance, language, licenses, linedup, packing, repair, runs, simhash, topk, vectors, warc
from patchlens.llm.common import read_table

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token pieces of the documents with their place in a sequence of 1024 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    hard = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(given.unionByName(hard)))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether the draw selects it.

    The draw is as large as the share of labelled documents that are of target quality.
    """
    target, share = importance.target_share(read_table(spark, sf_dir, "labels"))
    return importance.resample(read_table(spark, sf_dir, "documents"), target, share)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(read_table(spark, sf_dir, "documents"))


def op7_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.delete_repeated(docs, drop_empty=False)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    return vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose windows stand in each document."""
    found = decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.digest_of_items(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements in every document."""
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("blocks")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors by integer inner product for every twentieth id."""
    found = topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to end in loops."""
    found = runs.find_runs(runs.loop_tails(read_table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.withColumn("best", runs.longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    given = read_table(spark, sf_dir, "conversations")
    turns, found = repair.repair(repair.damage(given), given.select("conv_id"))
    digests = repair.digests(turns).withColumnRenamed("conv_id", "repaired_id")
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_packing, op3_chat, op4_importance, op5_warc, op6_language, op7_linedup, op8_vectors, op9_decontaminate, op10_licenses,
        op11_topk, op12_runs, op13_repair,
    )
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), " + _LETTERS + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _chat_sql() -> str:
    rest = "|".join(re.escape(c[1:]) for c in sorted(chat.CONTROLS, key=len, reverse=True))
    escapes = f"len(regexp_extract_all({{}}, '[<\\[]\\\\*(?:{rest})'))"
    text, role = (f"length({c}) + {escapes.format(c)}" for c in ("text", "role"))
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum({text} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                ELSE 17 + {role} END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id"""


_WARC_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
    o AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN original IS NULL OR page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id != original THEN original END AS refers_to
    FROM d LEFT JOIN o USING (payload_digest)"""

_VECTORS_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (
        SELECT vec_id, e FROM v
        WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
    ),
    link AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= {vectors.THRESHOLD}
    ),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
        vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
    FROM v LEFT JOIN least_of ON least_of.a = vec_id LEFT JOIN degree ON degree.a = vec_id"""

_DECONTAMINATE_SQL = f"""
    WITH iw AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, least(len(w), {decontaminate.WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS g
        FROM iw, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS u(i) WHERE len(w) > 0
    ),
    dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    dg AS (
        SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM dw, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)
    ),
    hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM dg JOIN win USING (k, g)),
    place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
    item AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)"""


def _licenses_sql() -> str:
    values = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES.items())
    share = licenses.CONTAINMENT
    return f"""
        WITH phrase(p, label) AS (VALUES {values}), template(label, text) AS (VALUES {templates}),
        tw AS (SELECT label, list_distinct({_WORDS.format('text')}) AS t FROM template),
        d AS (SELECT doc_id, text, {_WORDS.format('text')} AS w FROM documents),
        place AS (
            SELECT doc_id, label, i - 1 AS place FROM d, phrase, unnest(range(1, len(w) + 1)) AS u(i)
            WHERE w[i] = string_split(p, ' ')[1] AND array_to_string(w[i:i + len(string_split(p, ' ')) - 1], ' ') = p
        ),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM place GROUP BY doc_id
        ),
        line AS (SELECT doc_id, list_distinct({_WORDS.format('l')}) AS w FROM d, unnest(string_split(coalesce(text, ''), chr(10))) AS u(l)),
        found AS (
            SELECT doc_id, label, len(list_intersect(w, t))::DOUBLE / len(t) AS score FROM line, tw
            WHERE len(list_intersect(w, t)) * {share.denominator} >= len(t) * {share.numerator}
        ),
        every AS (
            SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM place) GROUP BY doc_id
        ),
        best AS (SELECT doc_id, max(score) AS score FROM found GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
            last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
            CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""


_TOPK_SQL = f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS c FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
        FROM v AS q JOIN v ON q.vec_id != v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= {topk.K}"""

# Fingerprints, tokens, drawn keys, rank-order distances, patience diff and checksums have no SQL form;
# tests hold those queries against plain versions.
ORACLE: dict[str, str] = {
    "op3_chat": _chat_sql(),
    "op5_warc": _WARC_SQL,
    "op8_vectors": _VECTORS_SQL,
    "op9_decontaminate": _DECONTAMINATE_SQL,
    "op10_licenses": _licenses_sql(),
    "op11_topk": _TOPK_SQL,
}
