import datetime

from pyspark.sql import functions as F

from sievework.plans.scan import Config
from sievework.streaming.incremental import scan_batches, stream_findings, windowed_events

SCHEMA = "repo_id string, file_seq long, path string, content string, size long, at timestamp"


def written(spark, path):
    at = datetime.datetime(2026, 1, 1)
    rows = [("r", 1, "a.py", "eval(x)", 7, at), ("r", 2, "a.py", "eval(x)", 7, at), ("r", 3, "b.py", "x = 1", 5, at)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_stream_findings_are_reported_once(spark, tmp_path):
    found = stream_findings(written(spark, str(tmp_path / "in")), detectors=("code",))
    q = found.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.file, r.line) for r in spark.table("seen").collect()] == [("a.py", 1)]


def test_scan_batches(spark, tmp_path):
    out = []
    q = scan_batches(written(spark, str(tmp_path / "in")), lambda f, r, n: out.extend(r.select("repo_id", "grade").collect()), str(tmp_path / "c"), Config(detectors=("code",), dependencies=False))
    q.awaitTermination()
    assert [r.repo_id for r in out] == ["r"]


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_events(events).agg(F.sum("n")).first()[0] == events.count()
