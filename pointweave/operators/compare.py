"""Iterative operators: dominant plane, rigid alignment, comparison of two clouds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import plane_fit
from . import octree
from .neighbors import distance_stats, nearest, over_threshold
from .points import XYZ, clean_points, heat_colour, transform_points, voxel_downsample


def candidate_planes(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``nx, ny, nz, d`` through random triples of a sample; triples on a line are left out."""
    rng = np.random.default_rng(seed)
    a, b, c = (sample[rng.integers(0, len(sample), count)] for _ in range(3))
    n = np.cross(b - a, c - a)
    length = np.linalg.norm(n, axis=1)
    good = length > 1e-12
    n = n[good] / length[good][:, None]
    n *= np.where(n[:, 2] < 0, -1.0, 1.0)[:, None]
    return np.column_stack([n, -(n * a[good]).sum(axis=1)])


def dominant_plane(points: DataFrame, threshold: float, iterations: int = 500, seed: int = 1) -> DataFrame | None:
    """The points (``id, x, y, z``) with ``inlier`` and the refitted plane; None if no plane holds 5 % and three points.

    ``iterations`` candidate planes come from three times as many points, which the driver reads; one pass over all points
    scores them together.  The jobs run when the function is called.
    """
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    good = clean_points(points)
    picked = good.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(3 * iterations).select(*XYZ).toPandas().to_numpy(float)
    planes = candidate_planes(picked, iterations, seed) if len(picked) >= 3 else np.zeros((0, 4))
    if not len(planes):
        return None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(planes), np.int64)
        for b in batches:
            xyz = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows = max(1, (1 << 23) // len(planes))
            for at in range(0, len(xyz), rows):
                total += (np.abs(xyz[at : at + rows] @ planes[:, :3].T + planes[:, 3]) <= threshold).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(len(planes))), pa.array(total)], names=["plane", "n"])

    best = good.select(*[F.col(c).cast("double").alias(c) for c in XYZ]).mapInArrow(score, "plane long, n long").groupBy("plane").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "plane").first()
    n = good.count()
    if best["n"] < max(3, 0.05 * n):
        return None

    def off(p) -> F.Column:
        return F.abs(F.col("x") * float(p[0]) + F.col("y") * float(p[1]) + F.col("z") * float(p[2]) + float(p[3]))

    fit = plane_fit(good.where(off(planes[best["plane"]]) <= threshold).withColumn("__all", F.lit(0)), ["__all"]).first()
    if fit is None:
        return None
    plane = (fit["nx"], fit["ny"], fit["nz"], fit["d"])
    return points.withColumns({"inlier": F.coalesce(off(plane) <= threshold, F.lit(False)), **{c: F.lit(float(v)) for c, v in zip(("nx", "ny", "nz", "d"), plane, strict=True)}})


@dataclass(frozen=True)
class CompareOptions:
    align: bool = True
    voxel: float = 0.0
    max_distance: float = 1.0
    iterations: int = 60
    epsilon: float = 1e-10
    threshold: float = 0.2

    def __post_init__(self) -> None:
        if self.max_distance <= 0 or self.iterations < 1 or self.voxel < 0 or self.threshold < 0:
            raise ValueError("distances and iterations must be positive")


def rigid_from_sums(n: float, p: np.ndarray, q: np.ndarray, pq: np.ndarray) -> np.ndarray:
    """The rotation and shift that best carry points p to q, from sums of p, q and their products."""
    cov = pq - np.outer(p, q) / n
    u, _, vt = np.linalg.svd(cov)
    fix = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    m = np.eye(4)
    m[:3, :3] = vt.T @ fix @ u.T
    m[:3, 3] = q / n - m[:3, :3] @ (p / n)
    return m


def icp_align(reference: DataFrame, moving: DataFrame, options: CompareOptions) -> np.ndarray | None:
    """The matrix that aligns ``moving`` with ``reference`` (``id, x, y, z``); None once fewer than three points lie near enough.

    Rounds end at a step or a change of error that is too small to matter, or at ``iterations``, whose matrix is then the result.

    Every round is one neighbour join and one aggregation of 16 sums; only those reach the driver.
    """
    ref, mov = clean_points(reference), clean_points(moving)
    if options.voxel:
        ref, mov = (voxel_downsample(p.withColumn("cloud_id", F.lit(0)), options.voxel).withColumn("id", F.xxhash64("vx", "vy", "vz")) for p in (ref, mov))
    ref, mov = ref.select("id", *XYZ).persist(), mov.select("id", *XYZ).persist()
    a, b = (p.agg(*[F.avg(c).alias(c) for c in XYZ]).first() for p in (ref, mov))
    total = np.eye(4)
    total[:3, 3] = [a[c] - b[c] for c in XYZ]
    target = ref.select(F.col("id").alias("tid"), *[F.col(c).alias(f"t{c}") for c in XYZ])
    before, tree = None, octree.grow(ref, 1)
    try:
        for _ in range(options.iterations):
            now = transform_points(mov, total.tolist())
            pairs = octree.search(now, tree, most=options.max_distance).join(now.withColumnRenamed("id", "qid"), "qid").join(target, "tid")
            s = pairs.agg(F.count("*").alias("n"), F.avg(F.col("distance") ** 2).alias("e"), *[F.sum(c).alias(c) for c in (*XYZ, "tx", "ty", "tz")], *[F.sum(F.col(p) * F.col(f"t{q}")).alias(p + q) for p in XYZ for q in XYZ]).first()
            if s["n"] < 3:
                return None
            step = rigid_from_sums(s["n"], np.array([s[c] for c in XYZ]), np.array([s[f"t{c}"] for c in XYZ]), np.array([[s[p + q] for q in XYZ] for p in XYZ]))
            total = step @ total
            if np.abs(step - np.eye(4)).max() < 1e-9 or (before is not None and abs(before - s["e"]) < options.epsilon):
                return total
            before = s["e"]
        return total
    finally:
        ref.unpersist()
        mov.unpersist()


def compare_clouds(reference: DataFrame, moving: DataFrame, options: CompareOptions) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """Distances from ``moving`` to ``reference`` after alignment, with colours and flags; their figures; the matrix.

    None if a cloud has fewer than three finite points, if alignment fails, or if fewer aligned points than three or a
    hundredth of the smaller cloud lie within ``max_distance``.
    """
    least = min(clean_points(reference).count(), clean_points(moving).count())
    if least < 3:
        return None
    matrix = icp_align(reference, moving, options) if options.align else np.eye(4)
    if matrix is None:
        return None
    aligned = transform_points(moving, matrix.tolist())
    found = aligned.join(nearest(aligned, reference).select(F.col("qid").alias("id"), "tid", "distance"), "id")
    if options.align and found.where(F.col("distance") <= options.max_distance).count() < max(3, least // 100):
        return None
    coloured = heat_colour(found, options.threshold).withColumn("over", over_threshold(F.col("distance"), options.threshold))
    return coloured, distance_stats(found, options.threshold), matrix
