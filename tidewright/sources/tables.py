"""Reading, landing, validating and reconciling tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import nan_to_null as _nan_to_null

#: Types of other stores, by name; what is not listed becomes text.
TYPES = {"tinyint": "tinyint", "smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint", "hugeint": "bigint", "float": "float", "real": "float", "double": "double", "decimal": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz", "string": "string", "varchar": "string"}


def read_raw(spark: SparkSession, base: str, schema: StructType, sep: str = ",") -> DataFrame:
    """CSV below base/year=Y/, with the year as a column."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(base).withColumn("year", F.col("year").cast("int"))


def read_staging(spark: SparkSession, base: str, year: int | None = None) -> DataFrame:
    df = spark.read.parquet(base).withColumn("year", F.col("year").cast("int"))
    return df if year is None else df.where(F.col("year") == year)


#: Names of the files of a year, by kind.
FILE_NAMES = {"ingresos": "ingresos{year}.csv", "salidas": "salidas_{year}.csv"}


def land_files(spark: SparkSession, source: str, target: str, kind: str, years: Sequence[int], schema: StructType, sep: str = ",", force: bool = False) -> DataFrame:
    """Lands the yearly files of a kind from a folder as target/kind/year=Y/, for read_raw.

    Returns year, state: uploaded; skipped (there already, and no force); missing (the folder has no such file, whether the
    target has the year or not). Files of other names are left alone. Landing a year again with force replaces it.
    """
    before, after = FILE_NAMES[kind].split("{year}")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pattern = f"^{re.escape(before)}(\\d{{4}}){re.escape(after)}$"
    found = spark.read.format("binaryFile").load(source).select("path", F.regexp_extract(name, pattern, 1).alias("_y")).where("_y <> ''")
    there = landed_years(spark, f"{target}/{kind}", "csv").withColumn("_t", F.lit(True))
    wanted = spark.createDataFrame([(y,) for y in sorted(set(years))], "year int")
    report = wanted.join(found.select(F.col("_y").cast("int").alias("year"), "path"), "year", "left").join(there, "year", "left")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("_t") & F.lit(not force), "skipped").otherwise("uploaded")
    done = report.select("year", state.alias("state"), "path").collect()  # a row for each year
    new = [r["path"] for r in done if r["state"] == "uploaded"]
    if new:
        rows = spark.read.schema(schema).option("header", True).option("sep", sep).csv(new)
        year = F.regexp_extract("_metadata.file_name", pattern, 1).cast("int")
        rows.withColumn("year", year).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("sep", sep).partitionBy("year").csv(f"{target}/{kind}")
    return spark.createDataFrame([(r["year"], r["state"]) for r in done], "year int, state string")


def landed_years(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The years of a partitioned folder, none if it is not there yet."""
    try:
        return spark.read.format(fmt).load(path).select(F.col("year").cast("int").alias("year")).distinct()
    except AnalysisException as e:  # the first landing finds no folder
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "year int")


def land_partitions(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes the years that path lacks, all with force. Returns year, state (uploaded or skipped)."""
    spark = df.sparkSession
    years = df.select("year").distinct()
    there = landed_years(spark, path, "parquet")
    report = years.join(there.withColumn("_t", F.lit(True)), "year", "left").select("year", F.when(F.col("_t") & F.lit(not force), "skipped").otherwise("uploaded").alias("state"))
    done = report.collect()  # a row for each year
    new = [r["year"] for r in done if r["state"] == "uploaded"]
    replace_partition(df.where(F.col("year").isin(*new)), path) if new else None
    return spark.createDataFrame(done, report.schema)


def replace_partition(df: DataFrame, path: str, by: str = "year") -> None:
    """Replaces exactly the partitions that df holds, in one commit; doing it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def full_load(df: DataFrame, path: str) -> DataFrame | None:
    """Overwrites the target and audits it; an empty source leaves it as it is."""
    if df.isEmpty():
        return None
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("year").parquet(path)
    return year_audit(df.sparkSession.read.parquet(path))


def missing_columns(critical: Sequence[str]):
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in critical]))


def split_valid(df: DataFrame, critical: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all critical columns, and the others with `reason` (their missing columns)."""
    marked = df.withColumn("_missing", missing_columns(critical))
    return marked.where(F.size("_missing") == 0).drop("_missing"), marked.where(F.size("_missing") > 0).withColumn("reason", F.concat_ws(",", "_missing")).drop("_missing")


def rejection_counts(df: DataFrame, critical: Sequence[str]) -> DataFrame:
    reason = F.concat_ws(",", missing_columns(critical))
    return df.groupBy(F.when(reason == "", "valid").otherwise(reason).alias("reason")).agg(F.count("*").alias("n"))


def year_audit(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def read_table(spark: SparkSession, fmt: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """Any source by format; partition = (column, lower, upper, n) makes a JDBC read parallel."""
    reader = spark.read.format(fmt).options(**options)
    if partition:
        reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
    return reader.load()


def write_table(df: DataFrame, fmt: str, mode: str = "append", batch: int = 10_000, **options) -> None:
    df.write.format(fmt).mode(mode).options(batchsize=batch, **options).save()


def materialize(df: DataFrame, name: str) -> DataFrame:
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def save_metrics(metrics: DataFrame, path: str) -> None:
    """One partition for each model; saving a model again replaces it."""
    replace_partition(metrics, path, "model")


def load_all_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def missing_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks; what is appended so can be appended again without harm."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_missing(tables: dict[str, DataFrame], base: str, keys: dict[str, Sequence[str]], only: Sequence[str] | None = None) -> list[str]:
    """Appends to base/<table> the rows it lacks, for the chosen tables. Returns those done."""
    done = []
    for name, df in tables.items():
        if only is not None and name not in only:
            continue
        try:
            existing = df.sparkSession.read.parquet(f"{base}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = df.limit(0)
        missing_rows(df, existing, keys[name]).write.mode("append").parquet(f"{base}/{name}")
        done.append(name)
    return done


def coerce_schema(df: DataFrame, types: dict[str, str] = TYPES) -> DataFrame:
    """Each column cast by the name of its type; types that are not listed become text."""
    return df.select(*[F.col(f.name).cast(types.get(f.dataType.simpleString().split("(")[0], "string")).alias(f.name) for f in df.schema.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[_nan_to_null(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def reconcile(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """table, n_left, n_right, same: row counts of two stores."""
    def counts(side: dict[str, DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("table"), F.count("*").alias(name)) for t, df in side.items()])

    both = counts(left, "n_left").join(counts(right, "n_right"), "table", "full_outer")
    return both.withColumn("same", F.col("n_left").eqNullSafe(F.col("n_right")))


def all_same(report: DataFrame) -> DataFrame:
    """One row over a reconcile() report: how many tables there are, how many differ, and whether all are the same."""
    return report.agg(F.count("*").alias("n_tables"), F.count_if(~F.col("same")).alias("n_different"), F.coalesce(F.bool_and("same"), F.lit(True)).alias("all_same"))


def panel_meta(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    return panel.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_series"))


def export_feed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_panel(panel: DataFrame, path: str, keys: Sequence[str] = ("port", "direction")) -> None:
    """Keeps a panel as Parquet; rows of a series lie together and in order, so a single series is read from few row groups."""
    panel.repartitionByRange(*keys).sortWithinPartitions(*keys, "year", "month").write.mode("overwrite").parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str] = ("port", "direction"), rows_per_bucket: int = 2_000_000, path: str | None = None) -> DataFrame:
    """Keeps a panel as a table in buckets of its series, so that windows, groupings and joins over the keys need no exchange.

    df is computed once: it is stored, if it is no stored table, counted, and then cut into as many buckets as rows_per_bucket asks for. Each bucket is one
    file. The table lies in `path` (a new one in the shared folder by default) and is registered as `name`; open_bucketed()
    finds it again in another session. Saving a name again replaces the table. An empty df gives one bucket.
    """
    spark = df.sparkSession
    once = df if hasattr(df, "stored_at") else stored(df, f"{name}-rows")
    n = max(1, -(-once.count() // rows_per_bucket))
    path = path or stored_path(spark, name)
    once.repartition(n, *keys).write.format("parquet").mode("overwrite").bucketBy(n, *keys).sortBy(*keys, *[c for c in ("year", "month") if c in df.columns]).option("path", f"{path}/rows").saveAsTable(name)
    spark.createDataFrame([(n, list(keys), df.schema.json())], "n int, keys array<string>, schema string").write.mode("overwrite").json(f"{path}/layout")
    if once is not df:
        discard(once)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table that save_bucketed() has put in a folder, under a name of this session."""
    layout = spark.read.schema("n int, keys array<string>, schema string").json(f"{path}/layout").first()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])).fields)
    keys = ", ".join(f"`{k}`" for k in layout["keys"])
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {layout['n']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df: written once to the folder in spark.checkpoint.dir and read again."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder in spark.checkpoint.dir, which the driver and all executors see.

    Where that is unset, a session of a single process gets a new folder; on a cluster it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", place)
    return f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() has made, once the last step that reads it is itself stored."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.stored_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
