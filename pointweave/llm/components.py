"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut_table

#: Edges that one task contracts at once, and nodes that it holds.
TASK_EDGES, TASK_NODES = 200_000, 400_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties every larger node of a partition's edges (u, v) to the smallest one that they lead to.

    What is tied is let go whenever it reaches TASK_NODES nodes, so a partition of any size needs bounded memory.
    """
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def tied() -> Iterator[pa.RecordBatch]:
        nodes = np.fromiter(root, np.int64, len(root))
        tops = np.fromiter(map(find, root), np.int64, len(root))
        root.clear()
        for at in range(0, len(nodes), 1 << 16):
            yield pa.record_batch([pa.array(nodes[at : at + (1 << 16)]), pa.array(tops[at : at + (1 << 16)])], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((find(u), find(v)))
            if low != high:
                root[high] = low
        if len(root) >= TASK_NODES:
            yield from tied()
    yield from tied()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down and none up, or only edges up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component_id`` for every id of a link: the smallest id that links lead to.

    Edges are contracted within the tasks that have them, then within tasks of about ``TASK_EDGES`` edges, as many as
    there are edges for.  While edges of several tasks meet in a node, each round ties the larger neighbours of every node
    to its smallest one, and the smaller ones likewise, until all edges lead to their component's smallest id.  Minima are
    pre-aggregated, so that a node of many links costs one row for each task, and edges are split by Spark's skew join.
    """
    old, new = Scratch(links.sparkSession), Scratch(links.sparkSession)
    edges = old.cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).mapInArrow(forest, "u long, v long"))
    tasks = -(-edges.count() // TASK_EDGES)
    if tasks:
        edges = new.cut(edges.coalesce(tasks).mapInArrow(forest, "u long, v long"))
        old.drop()
    while tasks > 1 and not _all_stars(edges):
        old, new = new, old
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour moves to the node's least neighbour
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # small star: every smaller neighbour, and the node itself, likewise
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = new.cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().mapInArrow(forest, "u long, v long"))
        old.drop()
    known = cut_table(edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()))
    old.drop()
    new.drop()
    return known
