"""Snapshot documents of ports and the vessels in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import normal_code

_VESSEL = "struct<time: string, vessel_name: string, vessel_type: string, imo: string, flag: string, built: int, gt: int, dwt: int, size: string>"
LISTS = ("expected_vessels", "vessels_in_port", "recent_arrivals", "recent_departures")
SNAPSHOT = (
    "scrape_type string, scrape_timestamp string, ports_scraped int, data array<struct<source: string, port_code: string, port_name: string, scrape_timestamp: string, summary: struct<expected_ships: int, ships_in_port: int>, "
    + ", ".join(f"{name}: array<{_VESSEL}>" for name in LISTS) + ">>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, with its name; files that cannot be read give nulls."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file_name", F.col("_metadata.file_name"))


def flatten_snapshots(snapshots: DataFrame) -> DataFrame:
    """A row for each port, list and vessel."""
    ports = snapshots.select(*[c for c in ("file_name",) if c in snapshots.columns], F.explode("data").alias("p"))
    lists = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.col(f"p.{name}").alias("vessels")) for name in LISTS])).alias("l")
    keep = [c for c in ports.columns if c != "p"]
    rows = ports.select(*keep, normal_code(F.col("p.port_code")).alias("port_code"), F.col("p.port_name").alias("port_name"), F.col("p.scrape_timestamp").alias("scrape_timestamp"), lists)
    return rows.select(*keep, "port_code", "port_name", "scrape_timestamp", F.col("l.list").alias("list"), F.explode("l.vessels").alias("v")).select(*keep, "port_code", "port_name", "scrape_timestamp", "list", "v.*")


def newest_files(rows: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n last files by name."""
    files = rows.select("file_name").distinct().orderBy(F.desc("file_name")).limit(n)
    return rows.join(F.broadcast(files), "file_name", "left_semi")  # n names


def search_vessels(rows: DataFrame, text: str, files: int = 10) -> DataFrame:
    """Vessels of the newest files whose name holds the text or whose IMO number it is; once for each vessel and list, from the newest file.

    Vessels without a number are told by their names; a row without both is found by no text.
    """
    hit = F.lower("vessel_name").contains(text.lower()) | (F.col("imo") == text)
    number = F.nullif(F.trim("imo"), F.lit(""))
    newest = Window.partitionBy(number, F.when(number.isNull(), F.lower("vessel_name")), "list").orderBy(F.desc("file_name"), F.desc("scrape_timestamp"), "port_code")
    return newest_files(rows, files).where(hit).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def port_status(snapshots: DataFrame) -> DataFrame:
    """Counters and list lengths of each port in each file."""
    p = snapshots.select(*[c for c in ("file_name",) if c in snapshots.columns], F.explode("data").alias("p"))
    sizes = [F.coalesce(F.size(F.col(f"p.{name}")), F.lit(0)).alias(f"n_{name}") for name in LISTS]
    return p.select(*[c for c in p.columns if c != "p"], normal_code(F.col("p.port_code")).alias("port_code"), F.col("p.scrape_timestamp").alias("scrape_timestamp"), "p.summary.expected_ships", "p.summary.ships_in_port", *sizes)
