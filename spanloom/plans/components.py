"""Connected components of an edge table, in few rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.skew import lookup_join
from spanloom.session import discard, stage


#: Edges up to which one task joins them all: a few megabytes.
ONE_TASK = 200_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, root) for edges (a, b): the smallest id of each id's component. Ids without edges do not come out.

    Alternating large-star and small-star steps (each a minimum per node with partial aggregation) shrink every component
    to a star in a logarithmic number of rounds. Every round is written to the shared folder, so lost executors
    cost no more than one round. A graph of at most ``one_task`` edges, which are counted, is joined by one task with the same result.
    """
    edges = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_join_all, "id long, root long")
    while True:
        large = stage(_large_star(edges), "large")
        small = stage(_small_star(large), "edges", replaces=large)
        if _same(edges, small):
            discard(small)
            break
        discard(edges)
        edges = small
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root")).distinct()


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over edges (a, b); the smallest id leads."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = (top(z) if z in up else up.setdefault(z, z) for z in (a, b))
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["id", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return lookup_join(both.where("v > u"), low, "u", "inner").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = lookup_join(edges, low, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _same(a: DataFrame, b: DataFrame) -> bool:
    sums = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).collect()[0]
    return sums(a) == sums(b)
