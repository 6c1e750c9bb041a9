"""Streams: late rows, restarts, replays and failures between two writes."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.streaming import rollup

SCORES = "port_code string, ts timestamp, operability double, seen long"


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES)


def kept(spark, path):
    return sorted((r.port_code, r.ts, r.operability) for r in rollup.read_scores(spark, path).collect())


FIRST = [("a", at(1, 1), 10.0, 1), ("a", at(1, 2), 20.0, 1), ("b", at(2, 1), 30.0, 1)]
SECOND = [("a", at(1, 2), 25.0, 2), ("b", at(3, 1), 40.0, 2)]
BOTH = [("a", at(1, 1), 10.0), ("a", at(1, 2), 25.0), ("b", at(2, 1), 30.0), ("b", at(3, 1), 40.0)]


def test_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert rollup.read_scores(spark, path) is None
    assert rollup.keep_scores_once(scores(spark, FIRST), 0, path) and rollup.keep_scores_once(scores(spark, SECOND), 1, path)
    assert kept(spark, path) == BOTH
    for i, rows in ((0, FIRST), (1, SECOND), (0, FIRST)):
        assert not rollup.keep_scores_once(scores(spark, rows), i, path)
    assert kept(spark, path) == BOTH


def test_a_failure_before_the_ledger_leaves_the_old_days(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "scores")
    rollup.keep_scores_once(scores(spark, FIRST), 0, path)
    before = kept(spark, path)
    from pyspark.sql.readwriter import DataFrameWriter

    whole, written = DataFrameWriter.json, []

    def lost(self, *a, **b):
        written.append(a)
        raise OSError("lost before the ledger was written")

    monkeypatch.setattr(DataFrameWriter, "json", lost)
    with pytest.raises(OSError):
        rollup.keep_scores_once(scores(spark, SECOND), 1, path)
    monkeypatch.setattr(DataFrameWriter, "json", whole)
    assert written and kept(spark, path) == before  # the new version is on disk, and nobody reads it
    assert rollup.keep_scores_once(scores(spark, SECOND), 1, path) and kept(spark, path) == BOTH


def test_the_stream_restarts_where_it_ended(spark, tmp_path):
    src, path, ck = (str(tmp_path / n) for n in ("src", "scores", "ck"))
    for rows in (FIRST, SECOND):
        scores(spark, rows).coalesce(1).write.mode("append").parquet(src)
        query = rollup.stream_scores_once(spark.readStream.schema(SCORES).parquet(src), path, ck, "seen")
        assert query.awaitTermination(120) and query.exception() is None
    assert kept(spark, path) == BOTH
    assert sorted({r.batch for r in rollup._ledger(spark, path).collect()}) == [0, 1]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "k string, ts timestamp, value double"
    steps = [[("x", at(1, 1), 1.0), ("x", at(1, 5), 3.0)], [("x", at(9), 5.0)], [("x", at(1, 7), 100.0), ("x", at(9, 3), 7.0)], [("x", at(20), 1.0)], [("x", at(30), 1.0)]]
    dropped = 0
    for rows in steps:  # every step is a restart from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema(schema).parquet(src)
        query = rollup.windowed_rollup(events, ["k"], "value").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        dropped += rollup.dropped_late(query)
    got = {r.window_start.day: (r.n, r.mean, r.max) for r in spark.read.parquet(out).collect()}
    assert got == {1: (2, 2.0, 3.0), 9: (2, 6.0, 7.0), 20: (1, 1.0, 1.0)} and dropped == 1
    # without the late row, and up to the last window that is closed, the stream says what the table says
    table = rollup.windowed_rollup(spark.read.schema(schema).parquet(src).where("value < 50"), ["k"], "value").where(F.col("window_end") <= F.lit(at(28)))
    assert {r.window_start.day: (r.n, r.mean, r.max) for r in table.collect()} == got
