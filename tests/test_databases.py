"""Copies to and from a database that Spark ships with."""

import pytest
from pyspark.sql import functions as F

from tidewright.sources import databases


@pytest.fixture
def db(tmp_path):
    return databases.Database(f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_parallel_read_between_the_bounds_of_the_key(spark, db):
    df = spark.range(-5, 995).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    db.write(df, "numbers", batch=100)
    got = db.read(spark, "numbers", "k", 4)
    assert got.rdd.getNumPartitions() == 4 and rows_of(got) == rows_of(df)
    assert rows_of(db.read(spark, "numbers").where("k = 7")) == [(7, 14)]
    db.write(df.limit(0), "nothing")
    assert db.read(spark, "nothing", "k").count() == 0 and db.has(spark, "nothing") and not db.has(spark, "nowhere")


def test_absent_rows_go_in_once(spark, db):
    new = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 5)], "k long, v long")
    databases.insert_absent(new, db, "t", ["k"])
    databases.insert_absent(new, db, "t", ["k"])
    databases.insert_absent(spark.createDataFrame([(2, 99), (3, 30)], "k long, v long"), db, "t", ["k"])
    assert rows_of(db.read(spark, "t")) == [(1, 10), (2, 20), (3, 30)] and not db.has(spark, "t_staging")


def test_a_failed_insertion_changes_nothing(spark, db, monkeypatch):
    databases.insert_absent(spark.createDataFrame([(1, 10)], "k long, v long"), db, "t", ["k"])
    monkeypatch.setattr(databases, "_insert_sql", lambda *a: "INSERT INTO t VALUES (7, 70)")  # then the transaction breaks
    whole = databases.Database.run
    monkeypatch.setattr(databases.Database, "run", lambda self, s, *sql: whole(self, s, sql[0], "INSERT INTO nowhere VALUES (1)"))
    with pytest.raises(Exception):
        databases.insert_absent(spark.createDataFrame([(2, 20)], "k long, v long"), db, "t", ["k"])
    monkeypatch.undo()
    assert rows_of(db.read(spark, "t")) == [(1, 10)]
    databases.insert_absent(spark.createDataFrame([(2, 20)], "k long, v long"), db, "t", ["k"])
    assert rows_of(db.read(spark, "t")) == [(1, 10), (2, 20)]


def test_a_broken_copy_ends_complete(spark, db, monkeypatch):
    df = spark.range(100, 1100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    whole, calls = databases.Database.run, []

    def breaks(self, spark, *sql):
        calls.append(sql)
        if len(calls) == 3:
            raise OSError("connection lost")
        whole(self, spark, *sql)

    monkeypatch.setattr(databases.Database, "run", breaks)
    with pytest.raises(OSError):
        databases.copy_by_ranges(df, db, "copied", "k", 200)
    monkeypatch.undo()
    assert db.read(spark, "copied").count() == 400
    assert databases.copy_by_ranges(df, db, "copied", "k", 200) == [(500, 700), (700, 900), (900, 1100)]
    assert rows_of(db.read(spark, "copied", "k", 3)) == rows_of(df)
    assert databases.copy_by_ranges(df, db, "copied", "k", 200) == [] and databases.copy_by_ranges(df.limit(0), db, "empty", "k") == []
