"""Connected components of a link table: in one task while it is small, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 30)), F.lit(0))).first())


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (a, b) and the least node that each can reach, by minima and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new[new]]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)]
        nodes, least = labels(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.record_batch([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, most_rounds: int = 60, most_at_once: int = 500_000) -> DataFrame:
    """links(a, b) of longs. Returns node, component: the smallest node that can be reached, for every node of a link with another.

    Up to most_at_once links (16 bytes each) are labelled in one task. Beyond that, rounds are logarithmic in the longest path;
    each is two joins on aggregated minima and is written to the shared folder; only a count and a checksum come to the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    if before[0] <= most_at_once:
        return _in_one_task(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
