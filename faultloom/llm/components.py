"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import unions

#: Links of one partition that are contracted together.
CHUNK = 500_000


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition replaced by stars around the least node; components are unchanged."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            found = [(x, r) for x, r in unions(held).items() if x != r]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.extend(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            if len(held) >= CHUNK:
                yield flush()
        yield flush()

    return links.select("a", "b").mapInArrow(stars, "a long, b long")


def settled(links: DataFrame) -> bool:
    """Whether distinct links (a > b) are stars around their least nodes: one link a node, and none that ends in a node with one."""
    if not links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.select(F.col("b").alias("a")).distinct().join(links.select("a"), "a", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b), two longs; component is the least node reachable.

    Both stars are a grouped minimum and a join, so a node with very many links is split like any skewed key. The loop
    ends when only stars are left.
    """
    larger = lambda x: x.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(larger(contract(links)), "links")
    while not settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = larger(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = larger(large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))))
        edges = materialize(small, "stars")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
