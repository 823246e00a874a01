"""Neighbour queries over embeddings seen as points: even ids are one cloud, odd ids another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import fits
from ..operators import neighbors as N
from .tables import SMALL_POINTS, rounded, small_points


def _pts(spark, sf_dir):
    return small_points(spark, sf_dir).select(F.col("ordinal").alias("id"), "x", "y", "z")


def _two(spark, sf_dir):
    p = _pts(spark, sf_dir)
    return p.where("id % 2 = 0"), p.where("id % 2 = 1")


def nearest_distance(spark, sf_dir):
    ref, mov = _two(spark, sf_dir)
    return rounded(N.nearest(mov, ref).select("qid", "tid", "distance"))


def knn(spark, sf_dir):
    p = _pts(spark, sf_dir)
    return rounded(N.nearest(p, p, 4, skip_same_id=True))


def snap_points(spark, sf_dir):
    ref, mov = _two(spark, sf_dir)
    picks = mov.select("id", *[(F.col(c) * 0.9).alias(c) for c in "xyz"])
    return rounded(N.snap_points(picks, ref))


def point_spacing(spark, sf_dir):
    return rounded(N.point_spacing(_pts(spark, sf_dir), None))


def _regions(spark, sf_dir):
    """Points in regions by label."""
    return small_points(spark, sf_dir).select(F.col("ordinal").alias("id"), "x", "y", "z", (F.col("frame_id") % 5).alias("region"))


def region_report(spark, sf_dir):
    """Every region's figures, spacing, box and plane; the plane as the share of its normal that is checked by SQL: its length."""
    r = fits.region_report(_regions(spark, sf_dir), ["region"])
    normal = F.sqrt(F.col("plane_nx") ** 2 + F.col("plane_ny") ** 2 + F.col("plane_nz") ** 2)
    through = F.abs(F.col("plane_nx") * F.col("mean_x") + F.col("plane_ny") * F.col("mean_y") + F.col("plane_nz") * F.col("mean_z") + F.col("plane_d"))
    return rounded(r.select("region", "n", "min_x", "max_x", "mean_z", "std_z", "per_area", "per_volume", "spacing", "box_points_used", normal.alias("normal_length"), through.alias("centre_off_plane")), 5)


def statistical_outliers(spark, sf_dir):
    return rounded(N.statistical_outliers(_pts(spark, sf_dir), 8, 1.0).select("id", "mean_distance", "outlier"))


def distance_stats(spark, sf_dir):
    ref, mov = _two(spark, sf_dir)
    return rounded(N.distance_stats(N.nearest(mov, ref), 0.05))


def dominant_plane(spark, sf_dir):
    p = _pts(spark, sf_dir).withColumn("z", F.when(F.col("id") % 4 != 0, F.col("x") * 0.5 + 0.1).otherwise(F.col("z")))
    return C.dominant_plane(p, 1e-6, 200).select("id", "inlier")


def compare_clouds(spark, sf_dir):
    ref, mov = _two(spark, sf_dir)
    _, stats, _ = C.compare_clouds(ref, mov, C.CompareOptions(align=False, threshold=0.05))
    return rounded(stats)


def icp_align(spark, sf_dir):
    p = _pts(spark, sf_dir)
    moved = p.select("id", (F.col("x") * 0.9998 - F.col("y") * 0.02 + 0.01).alias("x"), (F.col("x") * 0.02 + F.col("y") * 0.9998 - 0.01).alias("y"), (F.col("z") + 0.005).alias("z"))
    found, _, _ = C.compare_clouds(p, moved, C.CompareOptions(max_distance=0.3, iterations=12))
    return found.select("id", "tid", F.round("distance", 3).alias("distance"))


QUERIES = {f.__name__: f for f in (nearest_distance, knn, snap_points, point_spacing, region_report, statistical_outliers, distance_stats, dominant_plane, compare_clouds, icp_align)}

_D = "sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)"
_NEAR = f"n AS (SELECT a.ordinal AS qid, b.ordinal AS tid, {_D} AS d, row_number() OVER (PARTITION BY a.ordinal ORDER BY {_D}, b.ordinal) AS r FROM p a JOIN p b ON a.ordinal % 2 = 1 AND b.ordinal % 2 = 0)"
_KNN = f"n AS (SELECT a.ordinal AS qid, b.ordinal AS tid, {_D} AS d, row_number() OVER (PARTITION BY a.ordinal ORDER BY {_D}, b.ordinal) AS r FROM p a JOIN p b ON a.ordinal <> b.ordinal)"
_STATS = "count(*) AS n, round(min(d), 6) AS min, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rmse, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max, count(*) FILTER (d > 0.05 + 5e-8) AS n_over, round(count(*) FILTER (d > 0.05 + 5e-8) / count(*), 6) AS over_ratio"
ORACLES = {
    "nearest_distance": f"WITH {SMALL_POINTS}, {_NEAR} SELECT qid, tid, round(d, 6) AS distance FROM n WHERE r = 1",
    "knn": f"WITH {SMALL_POINTS}, {_KNN} SELECT qid, r::INTEGER AS rank, tid, round(d, 6) AS distance FROM n WHERE r <= 4",
    "snap_points": f"""WITH {SMALL_POINTS}, a AS (SELECT ordinal, x * 0.9 AS x, y * 0.9 AS y, z * 0.9 AS z FROM p WHERE ordinal % 2 = 1),
n AS (SELECT a.ordinal AS id, b.ordinal AS tid, b.x, b.y, b.z, {_D} AS d, row_number() OVER (PARTITION BY a.ordinal ORDER BY {_D}, b.ordinal) AS r FROM a JOIN p b ON b.ordinal % 2 = 0)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, tid, round(d, 6) AS distance FROM n WHERE r = 1""",
    "point_spacing": f"WITH {SMALL_POINTS}, {_KNN} SELECT round(median(d), 6) AS spacing FROM n WHERE r = 1 AND d * d > 1e-12",
    "region_report": f"""WITH {SMALL_POINTS}, q AS (SELECT *, frame_id % 5 AS region FROM p),
d AS (SELECT a.region, a.ordinal, min({_D}) AS d FROM q a JOIN q b ON a.region = b.region AND a.ordinal <> b.ordinal GROUP BY 1, 2),
s AS (SELECT region, median(d) AS spacing FROM d WHERE d * d > 1e-12 GROUP BY 1),
r AS (SELECT region, count(*) AS n, min(x) AS min_x, max(x) AS max_x, avg(z) AS mean_z, stddev_pop(z) AS std_z, (max(x) - min(x)) * (max(y) - min(y)) AS area, max(z) - min(z) AS h FROM q GROUP BY 1)
SELECT region, n, round(min_x, 5) AS min_x, round(max_x, 5) AS max_x, round(mean_z, 5) AS mean_z, round(std_z, 5) AS std_z, round(n / area, 5) AS per_area, round(n / (area * h), 5) AS per_volume,
round(spacing, 5) AS spacing, n AS box_points_used, 1.0::DOUBLE AS normal_length, 0.0::DOUBLE AS centre_off_plane FROM r JOIN s USING (region)""",
    "statistical_outliers": f"""WITH {SMALL_POINTS}, {_KNN}, m AS (SELECT qid, avg(d) AS m FROM n WHERE r <= 8 GROUP BY 1)
SELECT qid AS id, round(m, 6) AS mean_distance, m > (SELECT avg(m) + stddev_samp(m) FROM m) AS outlier FROM m""",
    "distance_stats": f"WITH {SMALL_POINTS}, {_NEAR} SELECT {_STATS} FROM n WHERE r = 1",
    "compare_clouds": f"WITH {SMALL_POINTS}, {_NEAR} SELECT {_STATS} FROM n WHERE r = 1",
    "dominant_plane": "SELECT vec_id AS id, vec_id % 4 <> 0 OR abs(embedding[3]::DOUBLE - (embedding[1]::DOUBLE * 0.5 + 0.1)) / sqrt(1.25) <= 1e-6 AS inlier FROM embeddings",
}
