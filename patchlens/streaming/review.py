"""From the event stream to stored reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from patchlens.functions.text import has_suffix
from patchlens.operators.diffs import parse_diffs
from patchlens.operators.joins import sized_join
from patchlens import schemas
from patchlens.operators.reports import FLAG_KEYS, analyse_flagged, can_fail, flagged, with_issues
from patchlens.operators.review import Analyzer
from patchlens.session import materialize
from patchlens.sources.tables import write_reports
from patchlens.streaming.events import rejected_events, review_requests

LEDGER_BUCKETS = 256  # folders of handled deliveries, by repository
FAN_BITS = 4
FAN = 1 << FAN_BITS  # segments of the ledger that become one of the next level
Scorer = Callable[[DataFrame], DataFrame]  # (..., content) -> the same rows + risky


def review_batch(
    requests: DataFrame, diffs: DataFrame, files: DataFrame, scorer: Scorer, analyzers: Sequence[Analyzer]
) -> DataFrame:
    """Reports for a table of review requests (repo, pr, head_sha)."""
    return with_issues(analyse_batch(requests, diffs, files, scorer, analyzers))


def analyse_batch(
    requests: DataFrame, diffs: DataFrame, files: DataFrame, scorer: Scorer, analyzers: Sequence[Analyzer]
) -> DataFrame:
    """The risky sections of the requested changes with their issues and failures.

    Requests and flagged sections are narrow and written down before they are
    joined, so their measured size chooses between broadcast and shuffle. When
    ``diffs`` and ``files`` are partitioned by repo, a batch opens its repos only.
    A diff belongs to the head in its ``head_sha``; a table without that column has
    one diff for all heads of a pull request.
    """
    wanted = materialize(requests.select("repo", "pr", "head_sha").distinct(), "requests")
    keys = [c for c in ("repo", "pr", "head_sha") if c in diffs.columns]
    changed = sized_join(diffs.select(*keys, "diff_text"), wanted, keys, count_large=diffs.select(*keys), prune_by="repo")
    snippets = parse_diffs(changed, "diff_text").filter(has_suffix(F.col("filename")))
    return analyse_flagged(flagged(scorer(snippets)), files, analyzers)


def review_stream(
    events: DataFrame,
    diffs: DataFrame,
    files: DataFrame,
    scorer: Scorer,
    analyzers: Sequence[Analyzer],
    secret: str,
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts the review job on a stream of webhook events.

    A delivery (``event_id``) is handled once, however late it comes: its id is kept
    in a ledger beside the checkpoint, see :func:`ledger_segments`, and a batch leaves out the
    ids of earlier batches. A new delivery for a reviewed change, as when it is reopened, is
    reviewed again. Each micro-batch replaces its own folder ``batch_id=<n>`` under
    ``sink`` and in the ledger, so a batch that is retried leaves its reports once.
    Report ids are derived from the change, see :func:`read_stream_reports`. A file for
    which an analyzer fails is listed under ``<sink>-failed`` for :func:`retry_stream`, and
    the others go on.
    """
    requests = review_requests(events, secret)
    ledger = f"{checkpoint.rstrip('/')}-handled"

    def store(batch: DataFrame, batch_id: int) -> None:
        narrow = batch.select("event_id", "repo", "pr", "head_sha").withColumn("bucket", _bucket())
        arrived = materialize(narrow, "deliveries")
        analysed = analyse_batch(_unhandled(arrived, ledger, batch_id), diffs, files, scorer, analyzers)
        if can_fail(analyzers):
            analysed = materialize(analysed, "analysed")
            failed = analysed.filter(F.size("failures") > 0).select(*schemas.FAILED.names)
            failed.write.mode("overwrite").parquet(f"{sink}-failed/attempt=1/batch_id={batch_id}/run=0")
        write_reports(with_issues(analysed), f"{sink}/batch_id={batch_id}", mode="overwrite")
        arrived.select("event_id", "bucket").distinct().write.mode("overwrite").parquet(_segment(ledger, 0, batch_id))

    return (
        requests.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("repo"), F.lit(LEDGER_BUCKETS)).cast("int")


def ledger_segments(batches: int) -> list[tuple[int, int]]:
    """The (level, number) of the segments that hold the deliveries of the first ``batches`` batches.

    Segment ``i`` of a level holds the batches from ``i * FAN ** level`` on, ``FAN ** level`` of
    them. So there are fewer than ``FAN`` segments a level, whatever the number of batches,
    and no folder has to be listed to find them.
    """
    found, level = [], 0
    while batches >> (level * FAN_BITS):
        last = batches >> (level * FAN_BITS)
        found += [(level, i) for i in range(last // FAN * FAN, last)]
        level += 1
    return found


def _segment(ledger: str, level: int, number: int) -> str:
    return f"{ledger}/level-{level}/segment-{number}"


_LEDGER = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _compact(spark, ledger: str, batch_id: int) -> None:
    """Writes the segments that are complete with the batches before ``batch_id``, each from ``FAN`` smaller ones.

    A segment is written by the first batch after it, in place of what a lost attempt of that
    batch has left. Segments above level 0 are foldered by the bucket of the repository.
    """
    level = 1
    while batch_id and batch_id % FAN**level == 0:
        number = batch_id // FAN**level - 1
        parts = [_segment(ledger, level - 1, number * FAN + i) for i in range(FAN)]
        rows = spark.read.schema(_LEDGER).parquet(*parts) if level == 1 else _union([spark.read.schema(_LEDGER).parquet(p) for p in parts])
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "event_id")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(_segment(ledger, level, number))
        level += 1


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _unhandled(arrived: DataFrame, ledger: str, batch_id: int) -> DataFrame:
    """Deliveries that no earlier batch has handled; of the large segments, opens those of their repositories."""
    spark = arrived.sparkSession
    if not batch_id:
        return arrived
    _compact(spark, ledger, batch_id)
    opened = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # LEDGER_BUCKETS at most
    segments = [spark.read.schema(_LEDGER).parquet(_segment(ledger, *s)) for s in ledger_segments(batch_id)]
    known = _union([s.filter(F.col("bucket").isin(opened)).select("event_id") for s in segments])
    return arrived.join(known, "event_id", "left_anti")


_TRIED = T.StructType([T.StructField("attempt", T.IntegerType()), T.StructField("batch_id", T.LongType()), T.StructField("run", T.LongType())])


def retry_stream(
    spark, files: DataFrame, analyzers: Sequence[Analyzer], sink: str, checkpoint: str, attempts: int = 3, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the job that tries failed files again: the failures of :func:`review_stream` are its source.

    A file that is analysed now has its report under ``<sink>-retried``, which
    :func:`read_stream_reports` reads too. One that fails again goes back to the source with the
    next number in ``attempt``, for a later batch; after ``attempts`` tries in all it ends
    under ``<sink>-dead``. Files that are gone or empty by now end there too. Each micro-batch
    replaces its own folders, so a retried batch leaves its results once.
    """
    schema = T.StructType([*schemas.FAILED.fields, *_TRIED.fields])
    source = spark.readStream.schema(schema).parquet(f"{sink}-failed")

    def again(batch: DataFrame, run: int) -> None:
        newest = F.max_by(F.struct("attempt", "batch_id", "failures"), F.struct("batch_id", "attempt"))
        waiting = batch.groupBy("report_id", *FLAG_KEYS).agg(newest.alias("last"))
        waiting = materialize(waiting.select("report_id", *FLAG_KEYS, "last.*"), "waiting")
        analysed = analyse_flagged(waiting.select(*FLAG_KEYS), files, analyzers).drop(*FLAG_KEYS).withColumnRenamed("failures", "now")
        tried = materialize(waiting.join(analysed, "report_id", "left"), "tried-again")
        well = tried.filter(F.size("now") == 0)
        reports = well.filter(F.size("issues") > 0).select(*schemas.REPORTS.names, "attempt", "batch_id")
        reports.write.mode("overwrite").parquet(f"{sink}-retried/run={run}")
        failing = tried.filter((F.size("now") > 0) | F.col("now").isNull())
        failing = failing.withColumn("gone", F.col("now").isNull()).withColumn("failures", F.coalesce("now", "failures"))
        ended = F.col("gone") | (F.col("attempt") >= attempts)
        failing.filter(ended).select(*schemas.FAILED.names, "attempt", "batch_id", "gone").write.mode("overwrite").parquet(f"{sink}-dead/run={run}")
        open_again = failing.filter(~ended)
        for attempt in range(2, attempts + 1):
            part = open_again.filter(F.col("attempt") == attempt - 1)
            for batch_id in [r[0] for r in part.select("batch_id").distinct().collect()] if not part.isEmpty() else []:
                rows = part.filter(F.col("batch_id") == batch_id).select(*schemas.FAILED.names)
                rows.write.mode("overwrite").parquet(f"{sink}-failed/attempt={attempt}/batch_id={batch_id}/run={run}")

    return source.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream_reports(spark, sink: str, retried: bool = False) -> DataFrame:
    """Stored reports with their ``id_prefix``; of a change that was reviewed again, the latest.

    ``retried`` adds those of :func:`retry_stream`: they replace the report of their own batch,
    not that of a later review.
    """
    folders = [T.StructField("batch_id", T.LongType()), T.StructField("id_prefix", T.StringType())]
    stored = spark.read.schema(T.StructType([*schemas.REPORTS.fields, *folders])).parquet(sink)
    stored = stored.withColumns({"attempt": F.lit(0), "run": F.lit(0).cast("long")})
    if retried:
        more = spark.read.schema(T.StructType([*schemas.REPORTS.fields, *_TRIED.fields])).parquet(f"{sink}-retried")
        stored = stored.unionByName(more.withColumn("id_prefix", F.substring("report_id", 1, 1)))
    newest = ["batch_id", "attempt", "run"]
    latest = stored.groupBy("report_id", "id_prefix").agg(F.max(F.struct(*newest)).alias("last"))
    latest = latest.select("report_id", "id_prefix", "last.*")
    return stored.join(latest, ["report_id", "id_prefix", *newest]).drop(*newest)


def request_stream(events: DataFrame, secret: str, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes review requests as they arrive; stateless, exactly once per input row.

    ``trigger`` is that of Structured Streaming, e.g. ``{"processingTime": "1 minute"}`` for a
    service; by default what is there is handled and the query ends.
    """
    return (
        review_requests(events, secret)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(sink)
    )


def reject_stream(events: DataFrame, secret: str, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes rejected events with their reason; ``trigger`` as in :func:`request_stream`."""
    return (
        rejected_events(events, secret)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(sink)
    )
