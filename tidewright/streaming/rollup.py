"""Stream jobs: snapshot intake, latest scores, scores kept exactly once, windowed rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import SNAPSHOT, flatten_snapshots
from ..sources.tables import replace_partition, stored


def windowed_rollup(events: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts, mean and greatest value in tumbling windows; the same function serves a stream (with a bound on lateness) and a table."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "max")


def stream_snapshots(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Vessel rows of snapshot files as they arrive, once for each port, list, vessel and scrape time."""
    raw = spark.readStream.schema(SNAPSHOT).option("multiLine", True).json(folder)
    rows = flatten_snapshots(raw).withColumn("scraped_at", F.to_timestamp("scrape_timestamp")).withWatermark("scraped_at", late)
    return rows.dropDuplicatesWithinWatermark(["port_code", "list", "imo", "scraped_at"])


def _latest(old: DataFrame | None, new: DataFrame, order: str | None) -> DataFrame:
    """The days that new touches, merged with what old has of them: one row for each (port_code, ts), rows of new being later."""
    rows = new.withColumn("_n", F.lit(1))
    if old is not None:
        before = old.join(new.select("day").distinct(), "day", "left_semi").withColumn("_n", F.lit(0))
        rows = before.unionByName(rows, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in ("port_code", "ts", "_n")]
    rank = F.struct("_n", *([order] if order else []), *columns)
    return rows.groupBy("port_code", "ts").agg(F.max_by(F.struct(*columns), rank).alias("s")).select("port_code", "ts", "s.*")


def stream_scores(scored: DataFrame, path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keeps the latest score of each (port_code, ts): each batch replaces the days it touches, merged with what is there.

    Rows of a batch are later than those of earlier batches. Within a batch the greatest value of the column `order` is the
    latest (an ingest time, say); where that is equal or not given, the row with the greatest values, so the result is the same
    in every run. The merged days are stored in the shared folder before the files that they were read from are replaced.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date("ts").cast("string"))
        try:
            old = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        replace_partition(stored(_latest(old, new, order), "scores"), path, "day")

    return scored.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """batch and day of every batch that is in; None before the first."""
    try:
        return spark.read.schema("batch long, day string").json(f"{path}/ledger")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """What keep_scores_once() has kept: of each day the version of the last batch in the ledger; None before the first batch."""
    ledger = _ledger(spark, path)
    if ledger is None:
        return None
    current = ledger.groupBy("day").agg(F.max("batch").alias("version"))
    data = spark.read.parquet(f"{path}/data").withColumns({"day": F.col("day").cast("string"), "version": F.col("version").cast("long")})
    return data.join(current, ["day", "version"], "left_semi").drop("version")


def keep_scores_once(batch: DataFrame, batch_id: int, path: str, order: str | None = None) -> bool:
    """Merges one batch into the scores below path, exactly once; False if the ledger says that it is in already.

    The days that the batch touches are written whole as data/day=D/version=<batch>; no earlier version is changed, so readers
    see the old days until the ledger names the new ones. The ledger entry is one file for a batch and is written last: a failure
    before it leaves the old state, and the replay writes the same version over what the failure left.
    """
    spark = batch.sparkSession
    ledger = _ledger(spark, path)
    if ledger is not None and not ledger.where(F.col("batch") == batch_id).isEmpty():
        return False
    best = _latest(read_scores(spark, path), batch.withColumn("day", F.to_date("ts").cast("string")), order)
    best.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{path}/data")
    days = batch.select(F.lit(batch_id).cast("long").alias("batch"), F.to_date("ts").cast("string").alias("day")).distinct()
    days.coalesce(1).write.mode("append").json(f"{path}/ledger")  # one file, which appears at once
    return True


def stream_scores_once(scored: DataFrame, path: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """stream_scores() with a ledger: replayed batches change nothing, and readers (read_scores) never see half a batch."""
    return scored.writeStream.foreachBatch(lambda batch, i: keep_scores_once(batch, i, path, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows (states of windows, if they were pre-aggregated) that a finished query dropped as later than its watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
