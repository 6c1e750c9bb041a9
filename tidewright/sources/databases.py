"""Tables of a database over JDBC: parallel reads, insertion of absent rows, copies that can be resumed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Database:
    """A JDBC url and options (driver, user, password). Column names are quoted as in standard SQL, table names are taken as given."""

    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self, spark: SparkSession):
        return spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def read(self, spark: SparkSession, table: str, key: str | None = None, parts: int = 8) -> DataFrame:
        """The table; with an integer key, in `parts` parallel ranges between its least and greatest value, which the database finds."""
        whole = self._reader(spark).option("dbtable", table)
        if key is None:
            return whole.load()
        low, high = self._reader(spark).option("query", f'SELECT min("{key}") AS lo, max("{key}") AS hi FROM {table}').load().first()
        if low is None or low == high:
            return whole.load()
        return whole.options(partitionColumn=f'"{key}"', lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()

    def write(self, df: DataFrame, table: str, mode: str = "append", batch: int = 10_000) -> None:
        df.write.format("jdbc").mode(mode).option("url", self.url).option("dbtable", table).option("batchsize", batch).options(**self.options).save()

    def has(self, spark: SparkSession, table: str) -> bool:
        try:
            self._reader(spark).option("dbtable", table).load()
        except Exception as e:  # each database has an error of its own for it
            if not any(word in str(e).lower() for word in ("does not exist", "doesn't exist", "no such table", "not found")):
                raise
            return False
        return True

    def run(self, spark: SparkSession, *statements: str) -> None:
        """Statements in one transaction, by the driver."""
        jvm = spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql in statements:
                statement = connection.createStatement()
                statement.executeUpdate(sql)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()


def _insert_sql(table: str, staging: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    names = ", ".join(f'"{c}"' for c in columns)
    same = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})"


def insert_absent(df: DataFrame, db: Database, table: str, keys: Sequence[str]) -> None:
    """Adds the rows of df whose key the table lacks, all or none of them; of rows with one key in df the least.

    Rows go to a staging table in parallel, and one statement of the database moves them, so a failure leaves the table as it was
    and the same call can be made again. Rows with a null key match nothing and are left out. A table that is not there is made.
    """
    spark, staging = df.sparkSession, f"{table}_staging"
    others = [c for c in df.columns if c not in keys]
    rows = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*") if others else df.dropna(subset=list(keys)).distinct()
    rows = rows.select(*df.columns)
    if not db.has(spark, table):
        db.write(rows.limit(0), table)
    db.write(rows, staging, "overwrite")
    db.run(spark, _insert_sql(table, staging, df.columns, keys), f"DROP TABLE {staging}")


def key_ranges(df: DataFrame, key: str, rows_per_range: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of equal width over an integer key, about so many rows each; the same whenever the same table is copied."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return []
    width = -(-(high - low + 1) // max(1, -(-n // rows_per_range)))
    return [(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]


def copy_by_ranges(df: DataFrame, db: Database, table: str, key: str, rows_per_range: int = 1_000_000) -> list[tuple[int, int]]:
    """Copies df range by range of an integer key; returns the ranges that this call has copied.

    A range and its entry in <table>_ranges are committed in one transaction. A copy that was broken goes on behind the last
    committed range, one that is complete does nothing; rows without a key are not copied. The source must not change in between.
    """
    spark, ledger, staging = df.sparkSession, f"{table}_ranges", f"{table}_staging"
    if not db.has(spark, table):
        db.write(df.limit(0), table)
    if not db.has(spark, ledger):
        db.write(spark.createDataFrame([], "low long, high long"), ledger)
    there = {tuple(r) for r in db.read(spark, ledger).select("low", "high").collect()}  # one row for each range
    done = []
    names = ", ".join(f'"{c}"' for c in df.columns)
    for low, high in key_ranges(df, key, rows_per_range):
        if (low, high) in there:
            continue
        db.write(df.where((F.col(key) >= low) & (F.col(key) < high)), staging, "overwrite")
        db.run(spark, f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}", f'INSERT INTO {ledger} ("low", "high") VALUES ({low}, {high})', f"DROP TABLE {staging}")
        done.append((low, high))
    return done
