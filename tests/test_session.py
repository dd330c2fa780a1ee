"""Where files go, and when rows are spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import session


def test_written_tables_go_to_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == base
    first, second = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    assert first != second and first.startswith(f"{base}/patchlens/x-")


def test_materialize_cuts_the_plan(spark):
    df = spark.range(100).withColumn("r", F.rand()).filter("r < 0.5")
    stored = session.materialize(df, "cut")
    assert stored.schema.names == df.schema.names
    assert sorted(stored.collect()) == sorted(stored.collect())
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "rand" not in plan


def test_spread_only_small_scans(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = session.spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert one.rdd.getNumPartitions() == 8
    many = spark.range(0, 1000, 1, 50)
    assert session.spread(many, "id") is many


def test_plan_text_hides_the_key(spark):
    from patchlens.functions.signing import BLOCK_BYTES, is_authentic

    key = "a secret of a service"
    df = spark.createDataFrame([("b", "sha256=00")], "body string, sig string").filter(is_authentic(key, F.col("body"), F.col("sig")))
    pads = [bytes(b ^ x for b in key.encode().ljust(BLOCK_BYTES, b"\0")).hex() for x in (0x36, 0x5C)]
    texts = [df._jdf.queryExecution().toString(), df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))]
    assert all(pad not in text.lower() for pad in pads for text in texts)
    assert df.count() == 0
