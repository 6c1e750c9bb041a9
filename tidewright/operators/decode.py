"""Joins of facts with small dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lookup:
    """Left join to a dimension: fact column (already parsed) = key; columns maps dimension columns to result names."""

    dim: DataFrame
    on: str
    key: str
    columns: dict[str, str]
    most_rows: int = 100_000


def is_small(df: DataFrame, most_rows: int, sure: int = 4 << 20) -> bool:
    """Whether df may be broadcast: the planner's estimate is at most `sure` bytes, or a count finds most_rows rows at most.

    The estimate comes from the files' sizes without a job; only what it leaves open is counted.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate <= sure or df.limit(most_rows + 1).count() <= most_rows


def decode(facts: DataFrame, lookups: list[Lookup]) -> DataFrame:
    """Facts with the labels of all lookups; the number of rows never changes.

    Keys of dimensions are made unique (smallest labels win). A dimension is broadcast only if it holds most_rows rows at most,
    otherwise the join is left to the optimizer.
    """
    for i, x in enumerate(lookups):
        names = list(x.columns)
        dim = x.dim.select(F.col(x.key).alias(f"_k{i}"), *[F.col(c).alias(f"_v{i}_{j}") for j, c in enumerate(names)])
        dim = dim.where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min(F.struct(*[f"_v{i}_{j}" for j in range(len(names))])).alias("_v")).select(f"_k{i}", "_v.*")
        facts = facts.join(F.broadcast(dim) if is_small(x.dim, x.most_rows) else dim, F.col(x.on) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        facts = facts.withColumnsRenamed({f"_v{i}_{j}": x.columns[c] for j, c in enumerate(names)})
    return facts


def prefix_fallback(facts: DataFrame, dim: DataFrame, code: str, key: str, label: str, out: str, width: int = 4, most_rows: int = 1_000_000) -> DataFrame:
    """Label of the code, else that of the first code (in order) with the same prefix of `width` characters."""
    hint = F.broadcast if is_small(dim, most_rows) else (lambda d: d)
    exact = dim.groupBy(F.col(key).alias("_code")).agg(F.min(label).alias("_exact"))
    near = dim.groupBy(F.substring(key, 1, width).alias("_prefix")).agg(F.min(F.struct(key, label)).alias("_near")).select("_prefix", F.col(f"_near.{label}").alias("_near"))
    found = facts.join(hint(exact), F.col(code) == F.col("_code"), "left").join(hint(near), F.substring(code, 1, width) == F.col("_prefix"), "left")
    return found.withColumn(out, F.coalesce("_exact", "_near")).drop("_code", "_exact", "_prefix", "_near")


def miss_report(decoded: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and for each column how many stayed without a label."""
    return decoded.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"miss_{c}") for c in columns])


def leak_check(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """table, n_leaks: rows of each table that still match what should be gone."""
    out = None
    for name, (df, bad) in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count_if(bad).alias("n_leaks"))
        out = one if out is None else out.unionByName(one)
    return out
