"""Fits and grids: planes, oriented boxes, profiles along paths, volumes over polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .neighbors import region_spacing
from .points import XYZ, Polygon, clean_points
from .sequences import keyed_quantiles, with_key_row

_PAIRS = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]


def plane_fit(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """The least-squares plane of each group: normal (upwards), d, slope, azimuth and residuals.

    Covariances are pre-aggregated by Spark; only one row a group reaches the batched eigen-decomposition.
    Groups of fewer than three points or on a line give no row.
    """
    keys = list(keys)
    good = clean_points(points)
    sums = good.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in XYZ], *[F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in _PAIRS])
    names = ("nx", "ny", "nz", "d", "slope_deg", "azimuth_deg")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.empty((b.num_rows, 3, 3))
            for a, c in _PAIRS:
                i, j = XYZ.index(a), XYZ.index(c)
                m[:, i, j] = m[:, j, i] = b.column(f"s{a}{c}").to_numpy(zero_copy_only=False)
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0] * np.where(vectors[:, 2, 0] < 0, -1.0, 1.0)[:, None]
            centre = np.stack([b.column(f"c{c}").to_numpy(zero_copy_only=False) for c in XYZ], axis=1)
            found = [*normal.T, -(normal * centre).sum(axis=1), np.degrees(np.arccos(np.clip(normal[:, 2], -1.0, 1.0))), np.degrees(np.arctan2(normal[:, 1], normal[:, 0])) % 360.0]
            out = pa.record_batch([*[b.column(c) for c in (*keys, "n")], *map(pa.array, found)], names=[*keys, "n", *names])
            yield out.filter(pa.array((values[:, 1] > 1e-12) & (b.column("n").to_numpy() >= 3)))

    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    planes = written(sums.mapInArrow(solve, f"{kinds}, n long, " + ", ".join(f"{c} double" for c in names)))
    residual = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))
    joined = with_key_row(good.select(*keys, *XYZ), planes, keys)
    rest = joined.groupBy(*keys).agg(F.sqrt(F.avg(residual * residual)).alias("rms"), F.avg(residual).alias("mean_abs"), F.max(residual).alias("max_abs"))
    return planes.join(rest, keys)


def _principal(sxx: Column, sxy: Column, syy: Column) -> Column:
    """The angle of the major axis of a 2 x 2 covariance, with its x part not negative."""
    a = F.atan2(2 * sxy, sxx - syy) / 2
    return F.when(F.cos(a) < 0, a + math.pi).otherwise(a)


def _projected(good: DataFrame, keys: list[str], axes: DataFrame) -> DataFrame:
    c, s = F.cos("angle"), F.sin("angle")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return good.join(axes, keys).withColumns({"u": c * dx + s * dy, "v": c * dy - s * dx})


def oriented_box(points: DataFrame, keys: Sequence[str] = ("cloud_id",), crop_from: int = 200) -> DataFrame:
    """The oriented bounds of whole clouds: cropped to quantiles 0.1 % to 99.9 %, axes by covariance, trimmed by 0.5 %."""
    keys = list(keys)
    good = clean_points(points).select(*keys, *XYZ)
    edge = keyed_quantiles(good, keys, {f"p{c}": (F.col(c), (0.001, 0.999)) for c in XYZ}).join(good.groupBy(*keys).agg(F.count("*").alias("all")), keys)
    inside = F.lit(True)
    for c in XYZ:
        inside = inside & F.col(c).between(F.col(f"p{c}")[0], F.col(f"p{c}")[1])
    used = good.join(edge, keys).where((F.col("all") < crop_from) | inside).select(*keys, *XYZ)
    return _boxes(used, keys, 0)


def oriented_box_region(points: DataFrame, keys: Sequence[str] = ("cloud_id",), trim_from: int = 200) -> DataFrame:
    """The oriented bounds of a region: no crop, trimmed only from ``trim_from`` points on (0: always).

    It is centred on the mean of the points, and its yaw is that of the longer side.
    """
    return _boxes(clean_points(points).select(*keys, *XYZ), list(keys), trim_from, region=True)


def _boxes(used: DataFrame, keys: list[str], trim_from: int, region: bool = False) -> DataFrame:
    axes = used.groupBy(*keys).agg(F.count("*").alias("points_used"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "x").alias("a"), F.covar_samp("x", "y").alias("b"), F.covar_samp("y", "y").alias("c"))
    axes = axes.where("points_used >= 3").withColumn("angle", _principal(F.col("a"), F.col("b"), F.col("c"))).drop("a", "b", "c")
    turned = _projected(used, keys, axes)
    out = turned.groupBy(*keys, "points_used", "mx", "my", "angle").agg(*[F.array(F.min(c), F.max(c)).alias(f"r{c}") for c in ("u", "v", "z")])
    out = out.join(keyed_quantiles(turned, keys, {f"p{c}": (F.col(c), (0.005, 0.995)) for c in ("u", "v", "z")}), keys)
    span = {c: F.when(F.col("points_used") >= trim_from, F.col(f"p{c}")).otherwise(F.col(f"r{c}")) for c in ("u", "v", "z")}
    size = {c: s[1] - s[0] for c, s in span.items()}
    mid = {c: (s[1] + s[0]) / 2 for c, s in span.items()}
    long_, short = F.greatest(size["u"], size["v"]), F.least(size["u"], size["v"])
    yaw = F.degrees("angle")
    cx, cy = F.col("mx") + F.cos("angle") * mid["u"] - F.sin("angle") * mid["v"], F.col("my") + F.sin("angle") * mid["u"] + F.cos("angle") * mid["v"]
    if region:
        yaw, cx, cy = F.when(size["v"] > size["u"], F.degrees(F.atan2(F.cos("angle"), -F.sin("angle")))).otherwise(yaw), F.col("mx"), F.col("my")
    return out.select(
        *keys, "points_used", yaw.alias("yaw_deg"), long_.alias("length"), short.alias("width"), size["z"].alias("height"),
        cx.alias("cx"), cy.alias("cy"), mid["z"].alias("cz"),
        F.sqrt(long_ * long_ + short * short).alias("diagonal_xy"), F.sqrt(long_ * long_ + short * short + size["z"] * size["z"]).alias("diagonal"),
    )


def region_stats(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Count, bounds, heights and densities of regions of at least three points; a density is null without an extent."""
    good = clean_points(points)
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], F.stddev_pop("z").alias("std_z")).where("n >= 3")
    size = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ}
    area, volume = size["x"] * size["y"], size["x"] * size["y"] * size["z"]
    return out.withColumns({"per_area": F.when(area > 1e-12, F.col("n") / area), "per_volume": F.when(volume > 1e-12, F.col("n") / volume)})


def region_report(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """The figures of ``region_stats`` with each region's spacing, oriented box (``box_``) and plane (``plane_``, null on a line).

    Points without an ``id`` are written once with numbers, so that each one's nearest is another one.
    """
    keys = list(keys)
    out = region_stats(points, keys)
    if "id" not in points.columns:
        points = written(points.withColumn("id", F.monotonically_increasing_id()))
    one = points.withColumn("__region", F.struct(*keys) if len(keys) > 1 else F.col(keys[0]))
    spacing = region_spacing(one.select("id", *XYZ, "__region"), "__region")
    spacing = spacing.select(*([F.col(f"__region.{k}").alias(k) for k in keys] if len(keys) > 1 else [F.col("__region").alias(keys[0])]), "spacing")
    out = out.join(spacing, keys, "left")
    for name, part in (("box", oriented_box_region(points, keys)), ("plane", plane_fit(points, keys).drop("n"))):
        out = out.join(part.withColumnsRenamed({c: f"{name}_{c}" for c in part.columns if c not in keys}), keys, "left")
    return out


def elevation_profile(points: DataFrame, path: Sequence[tuple[float, float]], width: float, bin_size: float, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Heights along a path: each point on its nearest segment, if within half the width, by station bins; empty bins are rows."""
    legs, at = [], 0.0
    for (ax, ay), (bx, by) in zip(path, path[1:], strict=False):
        length = math.hypot(bx - ax, by - ay)
        if length > 0:
            legs.append((float(ax), float(ay), (bx - ax) / length, (by - ay) / length, length, at))
            at += length
    n_bins = math.ceil(at / bin_size) if bin_size > 0 else 0
    if not legs or width <= 0 or not 1 <= n_bins <= 100_000:
        raise ValueError("the path, width or bin size can't give 1 to 100,000 bins")
    x, y = F.col("x"), F.col("y")

    def near(leg: tuple) -> Column:
        ax, ay, ux, uy, length, start = leg
        along = F.least(F.lit(length), F.greatest(F.lit(0.0), (x - ax) * ux + (y - ay) * uy))
        dx, dy = x - ax - along * ux, y - ay - along * uy
        return F.struct((dx * dx + dy * dy).alias("d2"), F.lit(legs.index(leg)).alias("leg"), (along + start).alias("station"))

    half = width / 2
    xs, ys = [p[0] for p in path], [p[1] for p in path]
    close = clean_points(points).where(x.between(min(xs) - half, max(xs) + half) & y.between(min(ys) - half, max(ys) + half))
    found = close.withColumn("__n", F.least(*[near(g) for g in legs]) if len(legs) > 1 else near(legs[0])).where(F.col("__n.d2") <= half * half)
    nth = F.least(F.floor(F.col("__n.station") / bin_size).cast("int"), F.lit(n_bins - 1))
    binned = found.groupBy(*keys, nth.alias("bin")).agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.avg("z").alias("mean_z"), F.percentile("z", F.lit(0.5)).alias("median_z"), F.max("z").alias("max_z"))
    every = points.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = every.join(binned, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("bin") * float(bin_size)).alias("start"), F.least(F.lit(at), (F.col("bin") + 1) * float(bin_size)).alias("end"), F.coalesce("n", F.lit(0)).alias("n"), "min_z", "mean_z", "median_z", "max_z")


def _grid(boundary: Polygon, size: float) -> tuple[float, float, int, int]:
    xs, ys = [v[0] for v in boundary.vertices], [v[1] for v in boundary.vertices]
    cols, rows = (max(1, math.ceil((max(v) - min(v)) / size)) for v in (xs, ys))
    if size <= 0 or cols * rows > 5_000_000:
        raise ValueError("the grid would have more than 5,000,000 cells")
    return min(xs), min(ys), cols, rows


def possible_cells(spark, boundary: Polygon, size: float) -> DataFrame:
    """The grid cells with their centre in the polygon: ``i, j``."""
    x0, y0, cols, rows = _grid(boundary, size)
    cells = spark.range(cols * rows).select((F.col("id") % cols).cast("int").alias("i"), F.floor(F.col("id") / cols).cast("int").alias("j"))
    return cells.where(boundary.contains_xy(x0 + (F.col("i") + 0.5) * size, y0 + (F.col("j") + 0.5) * size))


def grid_cells(points: DataFrame, boundary: Polygon, base_z: float, size: float, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Mean height and signed volume of each grid cell with points in the polygon."""
    x0, y0, cols, rows = _grid(boundary, size)
    i, j = (F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - o) / size).cast("int"))) for c, o, n in (("x", x0, cols), ("y", y0, rows)))
    inside = clean_points(points).where(boundary.contains_xy())
    return inside.groupBy(*keys, i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"), F.avg("z").alias("mean_z")).withColumn("volume", (F.col("mean_z") - float(base_z)) * size * size)


def grid_volume(points: DataFrame, boundary: Polygon, base_z: float, size: float, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Volume above and below a base height over a polygon, from cell means."""
    v = F.col("volume")
    out = grid_cells(points, boundary, base_z, size, keys).groupBy(*keys).agg(F.count("*").alias("occupied_cells"), F.sum("n").alias("n"), F.sum(F.greatest(v, F.lit(0.0))).alias("above"), F.sum(F.greatest(-v, F.lit(0.0))).alias("below"))
    possible = possible_cells(points.sparkSession, boundary, size).count()
    return out.withColumns({"net": F.col("above") - F.col("below"), "covered_area": F.col("occupied_cells") * size * size, "boundary_area": F.lit(boundary.area), "possible_cells": F.lit(possible), "empty_pct": F.greatest(F.lit(0.0), 100.0 * (possible - F.col("occupied_cells")) / max(possible, 1))})
