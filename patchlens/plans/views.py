"""Change-analytics inputs derived from the given tables.

The given tables hold prose, no code: code tokens are mixed in line by line, and
commits, diffs, events and review responses are derived from the same rows. Each
view reads its whole base table and whole texts; ``oracle.VIEWS`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.functions.signing import hmac_sha256
from patchlens.operators.prep import hash_number
from patchlens.operators.reports import report_id
from patchlens.session import spread

SECRET = "test-secret"
TEMPLATES = (
    "public void m() { // ",
    "if (x == null && y > 0) { ",
    "for (int i = 0; i < n; i++) { ",
    "} /* TODO */ ",
    "System.out.print(v); ",
    "try { f.read(); } catch (Exception e) { throw e; } ",
    "return cache.get(k) ; ",
    "++n; // error ",
)
MESSAGES = ("Fix null check", "Add feature", "Refactor io", "Resolve issue", "Prefix rename")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _div(column: str, by: int) -> Column:
    return F.expr(f"{column} div {by}")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, path, code): one file per document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    suffix = F.when(F.col("doc_id") % 4 == 3, ".py").otherwise(".java")
    lines = F.transform(
        F.split("text", "\n", -1), lambda line, i: F.concat(_pick(TEMPLATES, F.col("doc_id") + i), line)
    )
    return docs.select(
        "doc_id",
        "source",
        F.concat("source", F.lit("/"), "lang", F.lit("/D"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.array_join(lines, "\n").alias("code"),
    )


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(diff_id, diff_text): four files per diff."""
    marked = F.transform(
        F.split("code", "\n", -1),
        lambda line, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), line),
    )
    path = F.col("path")
    head = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2\n--- a/"), path,
        F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n"),
    )
    blocks = snippets(spark, sf_dir).select(
        _div("doc_id", 4).alias("diff_id"), "doc_id", F.concat(head, F.array_join(marked, "\n")).alias("block")
    )
    # four rows per group
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "block")))
    return blocks.groupBy("diff_id").agg(F.array_join(ordered["block"], "\n").alias("diff_text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, source, path, before, after): documents 2k and 2k + 1 as two versions; a single one has an empty ``after``."""
    docs = snippets(spark, sf_dir).withColumn("k", _div("doc_id", 2))
    # two rows per group
    versions = docs.groupBy("k").agg(
        F.min_by("source", "doc_id").alias("source"),
        F.min_by("path", "doc_id").alias("path"),
        F.min_by("code", "doc_id").alias("before"),
        F.when(F.count("*") == 1, "").otherwise(F.max_by("code", "doc_id")).alias("after"),
    )
    return versions


def _md5(column: Column) -> Column:
    return F.md5(column.cast("string"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change corpus of the pairs, small ones included."""
    size = F.size(F.split("before", "\n", -1)) + F.size(F.split("after", "\n", -1))
    return pairs(spark, sf_dir).select(
        F.col("source").alias("project"),
        _md5(F.col("k")).alias("commit_hash"),
        F.col("path").alias("file_path"),
        F.col("before").alias("buggy_change"),
        F.col("after").alias("fixed_change"),
        F.when(size < 10, 0.5).otherwise(1.0).alias("buggy_label"),
        F.when(size < 10, 0.5).otherwise(0.0).alias("fixed_label"),
    )


PLANTED = "\nif (item == null) { throw new Exception(item); }"


def planted(text: Column, times: Column) -> Column:
    """A text with lines at its end that a model can learn to tell."""
    return F.concat(text, F.repeat(F.lit(PLANTED), times))


def planted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change corpus with 5 to 9 planted lines more on the buggy side; ids are those of ``changes``."""
    times = (5 + F.pmod(F.xxhash64("commit_hash"), F.lit(5))).cast("int")
    return changes(spark, sf_dir).withColumn("buggy_change", planted(F.col("buggy_change"), times))


def _project_url(source: Column) -> Column:
    return F.concat(F.lit("https://example.com/"), source, F.lit(".git"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per pair; the first has no parent, every tenth is a merge."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("k")
    parents = (
        F.when(k == 0, F.array().cast("array<string>"))
        .when(k % 10 == 9, F.array(_md5(k - 1), _md5(k - 2)))
        .otherwise(F.array(_md5(k - 1)))
    )
    return docs.groupBy(_div("doc_id", 2).alias("k")).agg(F.min_by("source", "doc_id").alias("source")).select(
        _md5(k).alias("commit_hash"),
        _project_url(F.col("source")).alias("project_url"),
        _pick(MESSAGES, k).alias("msg"),
        parents.alias("parents"),
        (k * 60 + 1704067200).alias("committed_at"),
    )


def file_changes(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    """One changed file per commit; some are new (no before) or removed (no after).

    With ``named`` each has the ``project_url`` of its commit.
    """

    def numbered(col: str) -> Column:
        return F.transform(
            F.split(col, "\n", -1),
            lambda line, i: F.struct((i + 1).cast("int").alias("line_no"), line.alias("text")),
        )

    k = F.col("k")
    return pairs(spark, sf_dir).select(
        _md5(k).alias("commit_hash"),
        *([_project_url(F.col("source")).alias("project_url")] if named else []),
        F.col("path").alias("new_path"),
        numbered("before").alias("deleted"),
        numbered("after").alias("added"),
        F.when(k % 7 == 0, "").otherwise(F.col("before")).alias("source_before"),
        F.when(k % 11 == 0, "").otherwise(F.col("after")).alias("source_after"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_hash, diff_text): diff d is the patch of commit 2d."""
    return diffs(spark, sf_dir).select(_md5(F.col("diff_id") * 2).alias("commit_hash"), "diff_text")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File snapshots (commit_hash, path, blob): up to ten files per commit."""
    docs = table(spark, sf_dir, "documents").select(_div("doc_id", 2).alias("k")).distinct()
    # a file is absent from every seventh commit
    files = docs.select("k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p")).filter(
        (F.col("k") + F.col("p")) % 7 != 0
    )
    own = (F.col("k") + F.col("p")) % 3 == 0
    name = F.col("p").cast("string")
    return files.select(
        _md5(F.col("k")).alias("commit_hash"),
        F.concat(F.lit("p"), name, F.lit(".java")).alias("path"),
        F.when(own, _md5(F.col("k"))).otherwise(F.md5(F.concat(F.lit("base"), name))).alias("blob"),
    )


def webhook_columns(events: DataFrame) -> DataFrame:
    """Webhook deliveries from the events table, batch or stream."""
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    action = _pick(("opened", "synchronize", "reopened", "closed", "labeled"), event)
    start = F.concat(F.lit('{"action": "'), action, F.lit('", "pull_request": {"number": '), user)
    sha = F.md5(F.concat(F.lit("head"), user))
    repo = F.concat(
        F.lit('}, "repository": {"full_name": "org/r'), (F.col("user_id") % 10).cast("string"), F.lit('"}}')
    )
    body = (
        F.when(event % 50 == 7, start)  # cut off
        .when(event % 50 == 11, F.concat(start, repo))  # no head
        .otherwise(F.concat(start, F.lit(', "head": {"sha": "'), sha, F.lit('"}'), repo))
    )
    pull = F.col("event_type").isin("click", "view", "purchase")
    signed = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("received_at"),
        F.when(pull, "pull_request").otherwise("push").alias("event_type"),
        body.alias("body"),
    )
    signature = F.when(event % 4 == 0, "sha256=bad").when(event % 100 != 1, F.concat(F.lit("sha256="), hmac_sha256(SECRET, F.col("body"))))
    return signed.withColumn("signature", signature)


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webhook_columns(table(spark, sf_dir, "events"))


def webhook_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries as a file stream.

    The table is one file or a folder of files; only a path pattern reads both.
    """
    schema = table(spark, sf_dir, "events").schema
    return webhook_columns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def pr_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, pr, head_sha, diff_text): diff d is pull request d."""
    d = F.col("diff_id")
    return diffs(spark, sf_dir).select(
        F.concat(F.lit("org/r"), (d % 10).cast("string")).alias("repo"),
        d.alias("pr"),
        F.md5(F.concat(F.lit("head"), d.cast("string"))).alias("head_sha"),
        "diff_text",
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, ref, code) at the head commits; some are empty, some were moved."""
    d = _div("doc_id", 4)
    moved = F.when(F.col("doc_id") % 10 == 7, ".moved").otherwise("")
    return snippets(spark, sf_dir).select(
        F.concat(F.lit("org/r"), (d % 10).cast("string")).alias("repo"),
        F.concat("path", moved).alias("path"),
        F.md5(F.concat(F.lit("head"), d.cast("string"))).alias("ref"),
        F.when(F.col("doc_id") % 10 == 5, "").otherwise(F.col("code")).alias("code"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response): review responses in four shapes."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    line = F.col("turn").cast("string")
    message = F.md5("text")
    listed = F.concat(
        F.lit('[{"line": '), line, F.lit(', "severity": "major", "message": "'), message,
        F.lit('"}, {"line": "'), line, F.lit('", "severity": "critical", "message": "again '), message, F.lit('"}]'),
    )
    shape = F.col("conv_id") % 4
    response = (
        F.when(shape == 0, F.concat(F.lit("Here it is:\n```json\n"), listed, F.lit("\n```\nThat is all.")))
        .when(shape == 1, "[]")
        .when(shape == 2, F.concat(F.lit("See [1] first: "), listed))
        .otherwise(F.concat(F.lit('[{"line": '), line, F.lit(', "severity": "major", "message": "'), message))
    )
    return turns.select("conv_id", "turn", response.alias("response"))


def pr_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, turn, response): the responses of conversation d review file d."""
    d = _div("doc_id", 4)
    files = snippets(spark, sf_dir).select(
        F.col("doc_id").alias("conv_id"),
        report_id(
            F.concat(F.lit("org/r"), (d % 10).cast("string")),
            d,
            F.md5(F.concat(F.lit("head"), d.cast("string"))),
            F.col("doc_id") % 4,
            F.col("path"),
        ).alias("file_id"),
    )
    return files.join(responses(spark, sf_dir), "conv_id").select("file_id", "turn", "response")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score, prediction): hash scores against the quality label."""
    slot = hash_number(F.col("doc_id"), 42) % 10001
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").alias("label"),
        (slot / 10000).alias("score"),
        (slot > 5000).cast("int").alias("prediction"),
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pos, vec): each embedding as vectors of eight values, the last one filled up with zeros."""
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 7))
    last = F.floor((F.size("embedding") + 7) / 8).cast("int") - 1
    parts = F.transform(F.sequence(F.lit(0), last), lambda p: F.slice(filled, p * 8 + 1, F.lit(8)))
    some = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0)
    return some.select("vec_id", F.posexplode(parts).alias("pos", "vec"))
