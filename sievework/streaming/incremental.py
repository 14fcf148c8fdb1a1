"""Scanning as files arrive: detectors per batch, known findings dropped, counts kept per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import categorised
from ..operators import verify
from ..plans.scan import Config, raw_findings, scan


def stream_findings(files: DataFrame, event_time: str = "at", delay: str = "1 hour", detectors: tuple[str, ...] = ("code", "secrets", "urls")) -> DataFrame:
    """Unverified findings of a stream of files, each fingerprint once within the watermark.

    The detectors named need no window over other files, so they run in the stream itself."""
    from functools import reduce

    from ..operators import detect

    # Findings carry no time, so each file's travels with its repository.
    timed = categorised(files.withColumn("repo_id", F.struct("repo_id", F.col(event_time).alias("at"))))
    found = reduce(DataFrame.unionByName, [detect.ALL[d](timed) for d in detectors])
    found = found.withColumns({"at": F.col("repo_id.at"), "repo_id": F.col("repo_id.repo_id")}).withWatermark("at", delay)
    return found.withColumn("fingerprint", F.concat_ws(":", "repo_id", verify.fingerprint())).dropDuplicatesWithinWatermark(["fingerprint"])


def scan_batches(files: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Scan each micro-batch as a whole, with verification and reports; sink(findings, reports, batch number) must be idempotent."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        result = scan(batch, config)
        sink(result.findings, result.reports, number)
        batch.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def severity_counts(findings: DataFrame, event_time: str = "at", width: str = "1 hour") -> DataFrame:
    """Findings by repository, severity and window of time."""
    return findings.groupBy(F.window(event_time, width), "repo_id", "severity").agg(F.count("*").alias("n"))


def windowed_events(events: DataFrame, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Events by kind and window: count, users and total value; the same plan in batch and in a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


__all__ = ["raw_findings", "scan_batches", "severity_counts", "stream_findings", "windowed_events"]
