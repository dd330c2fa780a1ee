"""Session construction and the shared folder for files a job leaves behind."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_shipping = Lock()

# key pads of a signature check, as plan text shows them
SECRET_PATTERN = "(?i)(0x|X')[0-9a-f]{128}"


def build_session(app: str = "patchlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` overrides them.

    Shuffle partitions are left to the cluster: AQE coalesces small ones and
    splits skewed ones, so a large initial number is the safe choice there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.redaction.string.regex": SECRET_PATTERN,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session may do without; it uses the warehouse folder. Whether
    executors share the folder that is set cannot be told from its name.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing is reused or cleared."""
    return f"{shared_dir(spark)}/patchlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage in a way that survives the loss of executors.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table whose files cannot be split that far.

    A file is cut at its row groups at most. When the scan has no more
    partitions than there are cores, rows are hashed by ``key``; a larger table
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``--py-files`` does."""
    context = spark.sparkContext
    with _shipping:
        if context.applicationId in _shipped:
            return
        path = os.path.join(tempfile.mkdtemp(prefix="patchlens-py-"), "patchlens.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(_PACKAGE.rglob("*.py")):
                archive.write(file, f"{_PACKAGE.name}/{file.relative_to(_PACKAGE)}")
        context.addPyFile(path)
        _shipped.add(context.applicationId)
