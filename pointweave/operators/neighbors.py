"""Exact nearest neighbours, and what rests on them: spacing, outliers, snapping, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import octree
from .points import XYZ, clean_points
from .sequences import stride_sample


def nearest(queries: DataFrame, targets: DataFrame, k: int = 1, most: float = math.inf, skip_same_id: bool = False, key: str | None = None) -> DataFrame:
    """``qid, rank, tid, distance``: the k nearest targets of each query within ``most``, ties by target id; exact.

    ``queries`` and ``targets`` hold ``id, x, y, z``, and ``key`` where clouds are searched one by one.  The tree is grown, and the
    bounds of the search are found, when the function is called.
    """
    tree = octree.grow(targets, k + skip_same_id, key)
    if tree is None:
        return clean_points(queries).limit(0).select(F.col("id").cast("long").alias("qid"), F.lit(0).alias("rank"), F.col("id").cast("long").alias("tid"), F.lit(0.0).alias("distance"))
    return octree.search(queries, tree, k, most, skip_same_id, key)


def snap_points(picks: DataFrame, points: DataFrame) -> DataFrame:
    """Picked points moved to the nearest real point; unchanged if there is none."""
    best = nearest(picks, points).join(points.select(F.col("id").alias("tid"), *[F.col(c).alias(f"s{c}") for c in XYZ]), "tid")
    out = picks.join(best.withColumnRenamed("qid", "id"), "id", "left")
    return out.select("id", *[F.coalesce(f"s{c}", c).alias(c) for c in XYZ], "tid", "distance")


def region_spacing(points: DataFrame, key: str) -> DataFrame:
    """The median distance to the nearest other point of the same region; zero distances are left out."""
    found = nearest(points, points, skip_same_id=True, key=key).where(F.col("distance") * F.col("distance") > 1e-12)
    regions = clean_points(points).select(F.col("id").alias("qid"), key)
    return found.join(regions, "qid").groupBy(key).agg(F.median("distance").alias("spacing"))


def point_spacing(points: DataFrame, sample: int | None = None) -> DataFrame:
    """The median distance to the nearest other point, from all points or a stride sample of so many (3,000 for a quick figure); zero distances are left out."""
    asked = points if sample is None else stride_sample(clean_points(points), ["id"], sample)
    found = nearest(asked.select("id", *XYZ), points, skip_same_id=True).where(F.col("distance") * F.col("distance") > 1e-12)
    return found.agg(F.median("distance").alias("spacing"))


def statistical_outliers(points: DataFrame, k: int, m: float) -> DataFrame:
    """Adds ``mean_distance`` to the k nearest others and ``outlier``: above the mean by m sample deviations; k is 2 to n - 1."""
    if k < 2 or m <= 0 or k > clean_points(points).count() - 1:
        raise ValueError("k must be 2 to the number of other points, and m positive")
    means = nearest(points, points, k, skip_same_id=True).groupBy("qid").agg(F.avg("distance").alias("mean_distance")).withColumnRenamed("qid", "id")
    limit = means.agg((F.avg("mean_distance") + float(m) * F.stddev_samp("mean_distance")).alias("__limit"))  # one row
    return points.join(means, "id").join(F.broadcast(limit)).withColumn("outlier", F.col("mean_distance") > F.col("__limit")).drop("__limit")


def over_threshold(distance: Column, threshold: float) -> Column:
    return distance > threshold + max(1e-12, abs(threshold) * 1e-6)


def distance_stats(distances: DataFrame, threshold: float, column: str = "distance") -> DataFrame:
    d = F.col(column)
    over = F.count_if(over_threshold(d, threshold))
    return distances.agg(
        F.count("*").alias("n"), F.min(d).alias("min"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rmse"), F.median(d).alias("median"),
        F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("max"), over.alias("n_over"), (over / F.count("*")).alias("over_ratio"),
    )
