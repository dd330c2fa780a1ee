"""Mining filters, latest commits, first-parent changes and joins with hot keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from patchlens import schemas
from patchlens.operators import mining as M
from patchlens.operators.joins import measured_bytes, salted_join, sized_join


def change(commit, path, removed, added, before="b", after="a"):
    return (commit, path, [(i, f"r{i}") for i in range(removed)], [(i, f"a{i}") for i in range(added)], before, after)


def corpus(spark):
    commits = spark.createDataFrame(
        [
            ("fix", "https://h/o/kit.git", "FIX it", ["p"], None),
            ("prefix", "https://h/o/kit", "prefix rename", ["p"], None),
            ("merge", "https://h/o/kit.git", "fix merge", ["p", "q"], None),
            ("root", "https://h/o/kit.git", "bug in root", [], None),
            ("issue", "https://h/o/kit.git", "closes issue 1", ["p"], None),
            ("other", "https://h/o/kit.git", "add docs", ["p"], None),
        ],
        schemas.COMMITS,
    )
    files = spark.createDataFrame(
        [
            change("fix", "a.java", 2, 2),
            change("fix", "b.java", 2, 3),
            change("fix", "c.java", 4, 5),
            change("fix", "d.java", 5, 5),
            change("fix", "E.JAVA", 9, 9),
            change("prefix", "f.java", 0, 6, before=""),
            change("merge", "g.java", 9, 9),
            change("root", "h.java", 0, 12, before=""),
            change("issue", "i.java", 9, 9),
            change("other", "j.java", 9, 9),
        ],
        schemas.FILE_CHANGES,
    )
    return commits, files


def test_mine_changes(spark):
    rows = {r["file_path"]: r for r in M.mine_changes(*corpus(spark)).collect()}
    assert set(rows) == {"b.java", "c.java", "d.java", "f.java", "h.java"}
    assert (rows["c.java"]["buggy_label"], rows["c.java"]["fixed_label"]) == (0.5, 0.5)
    assert (rows["d.java"]["buggy_label"], rows["d.java"]["fixed_label"]) == (1.0, 0.0)
    assert rows["b.java"]["buggy_change"] == "r0\nr1" and rows["b.java"]["project"] == "kit"
    assert rows["f.java"]["buggy_change"] == ""
    assert M.mine_changes(*corpus(spark)).columns == schemas.CHANGES.names


def test_modified_pairs(spark):
    paths = {r["file_path"] for r in M.modified_pairs(*corpus(spark)).collect()}
    assert paths == {"a.java", "b.java", "c.java", "d.java", "g.java", "i.java"}


def test_latest_per_project_with_one_big_project(spark):
    commits = spark.range(3000).select(
        F.md5(F.col("id").cast("string")).alias("commit_hash"),
        F.when(F.col("id") % 100 < 90, "big").otherwise("small").alias("project_url"),
        (F.col("id") % 500).alias("committed_at"),
    )
    got = {(r["project_url"], r["commit_hash"]) for r in M.latest_commits(commits, 7, per_project=True).collect()}
    rows = sorted(commits.collect(), key=lambda r: (-r["committed_at"], r["commit_hash"]))
    want = set()
    for project in ("big", "small"):
        want |= {(project, r["commit_hash"]) for r in [r for r in rows if r["project_url"] == project][:7]}
    assert got == want
    assert [r["commit_hash"] for r in M.latest_commits(commits, 5).collect()] == [r["commit_hash"] for r in rows[:5]]


def test_changed_files(spark):
    commits = spark.createDataFrame(
        [("c1", []), ("c2", ["c1"]), ("c3", ["c2", "c1"]), ("c4", ["c1"])], "commit_hash string, parents array<string>"
    )
    trees = spark.createDataFrame(
        [("c1", "a", "1"), ("c1", "b", "1"), ("c2", "a", "2"), ("c2", "b", "1"), ("c2", "n", "1"),
         ("c3", "a", "2"), ("c4", "a", "1"), ("c4", "b", "1")],
        "commit_hash string, path string, blob string",
    )
    got = {(r["commit_hash"], r["path"], r["change"]) for r in M.changed_files(commits, trees).collect()}
    assert got == {
        ("c2", "a", "modified"), ("c2", "n", "added"), ("c3", "b", "deleted"), ("c3", "n", "deleted")
    }


def _skewed(spark, n, hot, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < hot else f"k{rng.randint(0, 40)}", i) for i in range(n)]
    return spark.createDataFrame(rows + [(None, -1)], f"key string, v{seed} int")


def test_salted_join_equals_join(spark):
    left, right = _skewed(spark, 900, 0.5, 1), _skewed(spark, 300, 0.4, 2)
    want = sorted(left.join(right, "key").collect())
    assert sorted(salted_join(left, right, ["key"], hot_rows=50, salted=True).collect()) == want
    assert sorted(salted_join(left, right, ["key"], hot_rows=50, salted=True, both_sides=True).collect()) == want
    few = right.dropDuplicates(["key"]).filter("key <> 'k3'")
    outer = salted_join(left, few, ["key"], "left", hot_rows=50, salted=True).fillna(-9).collect()
    assert sorted(map(str, outer)) == sorted(map(str, left.join(few, "key", "left").fillna(-9).collect()))


def test_salted_join_spreads_the_hot_key(spark):
    left, right = _skewed(spark, 4000, 0.6, 1), _skewed(spark, 20, 0.0, 2).union(
        spark.createDataFrame([("hot", 1)], "key string, v2 int")
    )
    joined = salted_join(left, right, ["key"], hot_rows=100, salted=True)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_ls" in plan
    hot = left.filter("key = 'hot'").count()
    assert joined.filter("key = 'hot'").count() == hot


def test_sized_join_chooses_by_size(spark):
    left, right = _skewed(spark, 500, 0.5, 1), _skewed(spark, 60, 0.2, 2)
    assert measured_bytes(right) > 500
    want = sorted(left.join(right, "key").collect())

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    small, large = sized_join(left, right, ["key"]), sized_join(left, right, ["key"], limit=500)
    assert hinted(small) and not hinted(large)
    assert sorted(small.collect()) == want and sorted(large.collect()) == want


def test_commit_diffs(spark):
    commits = spark.createDataFrame(
        [(f"c{i}", [] if i == 9 else ["p"], i) for i in range(10)],
        "commit_hash string, parents array<string>, committed_at long",
    )
    patches = spark.createDataFrame(
        [(f"c{i}", "a", "" if i == 8 else f"+{i}") for i in range(10)], "commit_hash string, path string, diff_text string"
    )
    # the newest four are 9 (a root), 8 (nothing in its patch), 7 and 6
    assert sorted(r["commit_hash"] for r in M.commit_diffs(commits, patches, 4).collect()) == ["c6", "c7"]


def test_append_corpora(spark):
    mined = M.mine_changes(*corpus(spark))
    assert M.append_corpora(mined, mined.select(*reversed(mined.columns))).count() == 2 * mined.count()


def test_sized_join_prunes_partitions(spark, tmp_path):
    large = spark.range(300).select((F.col("id") % 30).cast("string").alias("repo"), F.col("id").alias("pr"))
    large.write.partitionBy("repo").parquet(str(tmp_path / "large"))
    stored = spark.read.schema("repo string, pr long").parquet(str(tmp_path / "large"))
    small = spark.createDataFrame([("3", 3), ("4", 34), ("4", 35)], "repo string, pr long")
    joined = sized_join(stored, small, ["repo", "pr"], prune_by="repo")
    assert sorted(map(tuple, joined.collect())) == [("3", 3), ("4", 34)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [repo" in plan and "IN (3,4)" in plan


def test_corpus_counts(spark):
    rows = {r["project"]: r for r in M.corpus_counts(M.mine_changes(*corpus(spark))).collect()}
    assert (rows["kit"]["n_changes"], rows["kit"]["n_commits"], rows["kit"]["n_soft"]) == (5, 3, 3)


def test_forks_share_commit_hashes(spark):
    commits, changes = corpus(spark)
    other = commits.withColumn("project_url", F.lit("https://example.com/fork.git"))
    both = commits.unionByName(other)
    first = commits.select("commit_hash", "project_url").dropDuplicates(["commit_hash"])
    named = changes.join(first, "commit_hash")
    assert M.mine_changes(both, named).count() == M.mine_changes(commits, changes).count() > 0
    assert M.modified_pairs(both, named).count() == M.modified_pairs(commits, changes).count() > 0


def test_deleted_files_are_mined(spark):
    commits, changes = corpus(spark)
    named = changes.withColumn("filename", F.element_at(F.split("new_path", "/"), -1))
    gone = named.withColumn("new_path", F.lit(None).cast("string"))
    found = M.mine_changes(commits, gone)
    assert found.count() == M.mine_changes(commits, changes).count()
    assert {r["file_path"] for r in found.collect()} == {""}


def test_commits_without_a_parent_tree(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["x"])], "commit_hash string, parents array<string>")
    trees = spark.createDataFrame([(h, "f.java", h) for h in "abc"], "commit_hash string, path string, blob string")
    assert [r["commit_hash"] for r in M.changed_files(commits, trees).collect()] == ["b"]
    assert [r["commit_hash"] for r in M.without_parent_tree(commits, trees).collect()] == ["c"]
