"""Exact nearest neighbours through an octree whose cells hold a bounded number of points.

``grow`` splits the box of each cloud into cells; a cell of more than ``CELL_ROWS`` points goes on at once to the level where the
box of its own points splits, so dense spots cost a few rounds and sparse space costs nothing.  A search has two passes:

1. Each query meets the points of the cell that it lies in; its k-th distance there bounds the search.  A query outside of all cells,
   or in one with too few points, is bounded by the far corner of the smallest tree node near it that holds enough.
2. Each query meets the other cells that its ball touches.  Cells are found by equality of keys: at the level where a ball touches two
   cells an axis at most, and at the coarser levels that have cells.

Within a task the points of one cell are held and queries stream by, so memory is bounded; a cell of many queries is dealt over tasks.
Points at one place are one cell, which keeps as many of the smallest ids as a search can return.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .points import XYZ, clean_points

#: Points of a cell, and queries that one task answers in a cell; levels of the tree; distances that are computed at once.
CELL_ROWS, QUERY_ROWS, DEPTH, SLAB = 1024, 65_536, 50, 1 << 20
_CELL = [f"c{c}" for c in XYZ]
_BOX = [f"{side}{c}" for c in XYZ for side in ("a", "b")]


@dataclass
class Tree:
    """``roots``: key, corner, span and size of each cloud; ``leaves``: cells with the box of their points; ``points``: id and place by cell.

    ``keep`` is the most neighbours that a search may ask for.
    """

    roots: DataFrame
    leaves: DataFrame
    points: DataFrame
    levels: list[int]
    keep: int


def _keyed(points: DataFrame, name: str, key: str | None) -> DataFrame:
    return clean_points(points).select((F.lit(0) if key is None else F.col(key)).alias("key"), F.col("id").cast("long").alias(name), *[F.col(c).cast("double").alias(c) for c in XYZ])


def _unit(at: Column, c: str) -> Column:
    """A coordinate's share of the root's span; far ones end just outside."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(2.0), (at - F.col(f"o{c}")) / F.col("span")))


def _placed(points: DataFrame, roots: DataFrame) -> DataFrame:
    """Points of clouds that have a root, with their place at the finest level."""
    out = points.join(roots, "key")
    return out.withColumns({f"i{c}": F.floor(_unit(F.col(c), c) * float(1 << DEPTH)).cast("long") for c in XYZ})


def _cell_of(level: str = "level") -> dict[str, Column]:
    return {f"c{c}": F.expr(f"shiftright(i{c}, {DEPTH} - {level})") for c in XYZ}


def grow(targets: DataFrame, keep: int = 2, key: str | None = None, cell_rows: int = CELL_ROWS) -> Tree | None:
    """The tree of ``id, x, y, z`` (by ``key``), for searches of fewer than ``keep`` neighbours; None without points.  Runs jobs."""
    t = _keyed(targets, "tid", key)
    roots = t.groupBy("key").agg(F.count("*").alias("total"), *[F.min(c).alias(f"o{c}") for c in XYZ], *[F.max(c).alias(f"e{c}") for c in XYZ])
    span = F.greatest(*[F.col(f"e{c}") - F.col(f"o{c}") for c in XYZ])
    roots = roots.select("key", "total", *[f"o{c}" for c in XYZ], F.when(span > 0, span * (1 + 1e-9)).otherwise(1.0).alias("span"))
    start = F.greatest(F.lit(0), F.ceil(F.log(F.col("total") / cell_rows) / math.log(8))).cast("int")
    roots = written(roots.withColumn("level", start))
    now = _placed(t, roots).withColumns(_cell_of())
    found = []
    while True:
        differ = F.greatest(*[F.expr(f"max(i{c}) ^ min(i{c})") for c in XYZ])
        box = [f(c).alias(f"{side}{c}") for c in XYZ for side, f in (("a", F.min), ("b", F.max))]
        cells = written(now.groupBy("key", "level", *_CELL).agg(F.count("*").alias("n"), differ.alias("differ"), *box))
        small = (F.col("n") <= cell_rows) | (F.col("differ") == 0)
        found.append(cells.where(small).drop("differ"))
        # the level at which the cell's points part, and as many more as their number asks for
        part = DEPTH - F.length(F.bin("differ"))
        more = F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / cell_rows) / math.log(8))).cast("int")
        large = cells.where(~small).select("key", "level", *_CELL, F.least(F.lit(DEPTH), part + more).cast("int").alias("next"))
        if large.isEmpty():
            break
        now = now.join(large, ["key", "level", *_CELL]).withColumn("level", F.col("next")).drop("next").withColumns(_cell_of())
    leaves = found[0]
    for more_leaves in found[1:]:
        leaves = leaves.unionByName(more_leaves)
    leaves = written(leaves.withColumn("leaf", F.monotonically_increasing_id()))
    levels = sorted(r.level for r in leaves.select("level").distinct().collect())  # at most DEPTH + 1
    if not levels:
        return None
    roots = roots.drop("level")
    points = _located(_placed(t, roots), leaves, levels).select("leaf", "n", "tid", *XYZ)
    nth = F.row_number().over(Window.partitionBy("leaf", *XYZ).orderBy("tid"))
    heavy = points.where(F.col("n") > cell_rows).withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")
    return Tree(roots, leaves, written(points.where(F.col("n") <= cell_rows).unionByName(heavy).drop("n")), levels, keep)


def _located(placed: DataFrame, leaves: DataFrame, levels: list[int]) -> DataFrame:
    """Rows with the cell that they lie in; rows outside of all cells are left out."""
    each = placed.withColumn("level", F.explode(F.array(*[F.lit(m) for m in levels]))).withColumns(_cell_of())
    return each.join(leaves.select("key", "level", *_CELL, "leaf", "n"), ["key", "level", *_CELL]).drop("level", *_CELL)


def _compared(ids: np.ndarray, at: np.ndarray, tids: np.ndarray, there: np.ndarray, k: int, skip: bool) -> Iterator[pa.RecordBatch]:
    """The k nearest of a cell's points for each query, ties by id."""
    rows = max(1, SLAB // max(1, len(tids)))
    for lo in range(0, len(ids), rows):
        own, q = ids[lo : lo + rows], at[lo : lo + rows]
        d = np.sqrt(sum((q[:, i, None] - there[None, :, i]) ** 2 for i in range(3)))
        if skip:
            d[own[:, None] == tids[None, :]] = np.inf
        edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(q), np.inf)
        i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        order = np.lexsort((tids[j], d[i, j], i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < k], j[nth < k]
        yield pa.record_batch([pa.array(own[i]), pa.array(tids[j]), pa.array(d[i, j])], names=["qid", "tid", "distance"])


def _searched(pairs: DataFrame, tree: Tree, k: int, skip: bool) -> DataFrame:
    """``qid, tid, distance``: the k nearest within each pair's cell; ``pairs``: leaf, qid, x, y, z."""
    pairs = written(pairs)
    chunks = pairs.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    q = pairs.join(chunks, "leaf").select("leaf", F.pmod(F.xxhash64("qid"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("kind"), F.col("qid").alias("id"), *XYZ)
    t = tree.points.join(chunks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.col("tid").alias("id"), *XYZ)
    dealt = t.unionByName(q).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, points = None, [], None
        for b in batches:
            leaf, chunk, kind, ids = (b.column(c).to_numpy() for c in range(4))
            at = np.stack([b.column(c).to_numpy() for c in (4, 5, 6)], axis=1)
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if lo == hi:
                    continue
                if now != (leaf[lo], chunk[lo]):
                    now, held, points = (leaf[lo], chunk[lo]), [], None
                if kind[lo] == 0:
                    held.append((ids[lo:hi].copy(), at[lo:hi].copy()))
                    continue
                points = points or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                yield from _compared(ids[lo:hi], at[lo:hi], *points, k, skip)

    return dealt.mapInArrow(run, "qid long, tid long, distance double")


def _far(side: bool) -> Column:
    """The distance from a query to the nearest or (``side``) the farthest point of a box."""
    def off(c: str) -> Column:
        low, high = F.col(f"a{c}") - F.col(c), F.col(c) - F.col(f"b{c}")
        return F.greatest(F.abs(low), F.abs(high)) if side else F.greatest(low, high, F.lit(0.0))

    return F.sqrt(off("x") ** 2 + off("y") ** 2 + off("z") ** 2)


def search(queries: DataFrame, tree: Tree, k: int = 1, most: float = math.inf, skip_same_id: bool = False, key: str | None = None) -> DataFrame:
    """``qid, rank, tid, distance``: the k nearest points of the tree for each query (``id, x, y, z``), ties by id; exact.

    ``skip_same_id`` leaves out the point of the query's own id.  Queries of a cloud without points have no rows.
    """
    if k + skip_same_id > tree.keep:
        raise ValueError("the tree was grown for fewer neighbours")
    q = _placed(_keyed(queries, "qid", key), tree.roots)
    home = _located(q, tree.leaves, tree.levels)
    first = written(_searched(home.select("leaf", "qid", *XYZ), tree, k, skip_same_id))
    least = F.least(F.lit(k), F.col("total") - int(skip_same_id)).cast("long")
    got = first.groupBy("qid").agg(F.count("*").alias("got"), F.max("distance").alias("r"))
    homes = home.select("qid", F.col("leaf").alias("home"))
    known = q.join(homes, "qid", "left").join(got, "qid", "left").withColumn("least", least).where("least > 0")
    known = written(known.withColumn("r", F.when(F.col("got") >= F.col("least"), F.col("r"))))

    # every cell under each of its ancestors
    above = tree.leaves.withColumn("own", F.col("level")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("own"))))
    above = above.withColumns({f"c{c}": F.expr(f"shiftright(c{c}, own - level)") for c in XYZ})
    nodes = above.groupBy("key", "level", *_CELL).agg(F.sum("n").alias("n"), *[(F.min if b[0] == "a" else F.max)(b).alias(b) for b in _BOX])
    inside = {f"c{c}": F.expr(f"greatest(0, least(c{c}, shiftleft(1L, level) - 1))") for c in XYZ}
    lost = known.where("r is null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(tree.levels[-1])))).withColumns(_cell_of()).withColumns(inside)
    bound = lost.join(nodes, ["key", "level", *_CELL]).where(F.col("n") >= F.col("least") + int(skip_same_id)).groupBy("qid").agg(F.min(_far(True)).alias("bound"))
    balls = known.join(bound, "qid", "left").withColumn("r", F.least(F.coalesce("r", "bound"), F.lit(float(most))) * (1 + 1e-9))

    finest = F.lit(tree.levels[-1])
    fits = F.when(F.col("r") * 2 >= F.col("span"), 0).when(F.col("r") <= F.col("span") * 2.0 ** -(DEPTH + 1), finest).otherwise(F.least(finest, F.floor(F.log2(F.col("span") / (2 * F.col("r")))).cast("int")))
    levels = F.filter(F.array(*[F.lit(m) for m in tree.levels]), lambda m: m < F.col("fits"))
    touched = balls.withColumn("fits", fits).withColumn("level", F.explode(F.concat(F.array("fits"), levels)))
    for c in XYZ:
        cells = F.expr("shiftleft(1L, level)")
        low, high = (F.floor(_unit(F.col(c) + sign * F.col("r"), c) * cells).cast("long") for sign in (-1, 1))
        low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, cells - 1)
        touched = touched.withColumn(f"c{c}", F.explode(F.when(low <= high, F.sequence(low, high))))
    met = touched.join(above.select("key", "level", *_CELL, "leaf", "own", *_BOX), ["key", "level", *_CELL])
    met = met.where(((F.col("level") == F.col("fits")) | (F.col("own") == F.col("level"))) & (F.coalesce("home", F.lit(-1)) != F.col("leaf")) & (_far(False) <= F.col("r")))
    both = first.unionByName(_searched(met.select("leaf", "qid", *XYZ), tree, k, skip_same_id)).where(F.col("distance") <= float(most))
    if k == 1:  # pre-aggregated, without a sort
        return both.groupBy("qid").agg(F.min(F.struct("distance", "tid")).alias("best")).select("qid", F.lit(1).alias("rank"), "best.tid", "best.distance")
    w = Window.partitionBy("qid").orderBy("distance", "tid")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "tid", "distance")
