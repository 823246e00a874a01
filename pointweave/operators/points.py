"""Point tables: cleaning, colours, selections, transforms, statistics, histograms, downsampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cell, finite
from ..functions.vectors import affine
from .sequences import keyed_quantiles, with_key_row

XYZ = ("x", "y", "z")
#: Colour of points without one (fixed values).
NO_COLOUR = (205, 215, 225)


def is_finite_point() -> Column:
    return finite(*[F.col(c) for c in XYZ])


def clean_points(points: DataFrame) -> DataFrame:
    """Drops points with a coordinate that is null, NaN or infinite."""
    return points.where(is_finite_point())


def unpack_colour(points: DataFrame, packed: str) -> DataFrame:
    """r, g, b, a from a packed 32-bit number; null gives the default colour."""
    v = F.col(packed).cast("long")
    parts = {n: F.coalesce(F.shiftright(v, s).bitwiseAND(F.lit(255)), F.lit(d)).cast("smallint") for (n, s), d in zip((("r", 16), ("g", 8), ("b", 0), ("a", 24)), (*NO_COLOUR, 255), strict=True)}
    return points.withColumns(parts)


def default_colour(points: DataFrame) -> DataFrame:
    """Missing colours become the default one."""
    return points.withColumns({c: F.coalesce(F.col(c), F.lit(d)).cast("smallint") for c, d in zip("rgb", NO_COLOUR, strict=True)})


def intensity_to_gray(points: DataFrame, keys: Sequence[str] = ("cloud_id", "frame_id")) -> DataFrame:
    """A gray of 0 to 255: frames of intensities within 0 to 1 are scaled, NaN is 0, infinity 255."""
    v = F.when(F.isnan("intensity"), 0.0).otherwise(F.col("intensity"))
    span = points.groupBy(*keys).agg(F.min(v).alias("__low"), F.max(v).alias("__high"))
    scaled = F.when((F.col("__low") >= 0) & (F.col("__high") <= 1), v * 255).otherwise(v)
    return points.join(span, list(keys)).withColumn("gray", F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).cast("smallint")).drop("__low", "__high")


@dataclass(frozen=True)
class Box:
    """An inclusive box; with ``inverted`` the points outside it."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    inverted: bool = False

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, self.low + self.high)) or any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise ValueError("a box needs finite corners and positive extents")

    def contains(self) -> Column:
        inside = reduce(lambda a, b: a & b, [F.col(c).between(float(lo), float(hi)) for c, lo, hi in zip(XYZ, self.low, self.high, strict=True)])
        return ~inside if self.inverted else inside

    def invert(self) -> Box:
        return Box(self.low, self.high, not self.inverted)


def select_box(points: DataFrame, box: Box) -> DataFrame:
    """The finite points that a box selects."""
    return points.where(is_finite_point() & box.contains())


def select_height(points: DataFrame, low: float, high: float, inverted: bool = False) -> DataFrame:
    """The finite points within a band of z, or outside it."""
    band = F.col("z").between(float(low), float(high))
    return points.where(is_finite_point() & (~band if inverted else band))


def select_xy(points: DataFrame, corner: tuple[float, float], other: tuple[float, float]) -> DataFrame:
    """The finite points within a rectangle given by two opposite corners, at any height."""
    (x0, x1), (y0, y1) = (sorted(p) for p in zip(corner, other, strict=True))
    if x1 - x0 < 1e-5 or y1 - y0 < 1e-5:
        raise ValueError("the rectangle is too small")
    return points.where(is_finite_point() & F.col("x").between(float(x0), float(x1)) & F.col("y").between(float(y0), float(y1)))


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _within(p, q, r) -> bool:
    return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])


def segments_meet(p, q, r, s) -> bool:
    """Whether two closed segments share a point."""
    a, b, c, d = _turn(p, q, r), _turn(p, q, s), _turn(r, s, p), _turn(r, s, q)
    if ((a > 0) != (b > 0)) and ((c > 0) != (d > 0)) and a and b and c and d:
        return True
    return any(t == 0 and _within(*seg, pt) for t, seg, pt in ((a, (p, q), r), (b, (p, q), s), (c, (r, s), p), (d, (r, s), q)))


def polygon_area(vertices: Sequence[tuple[float, float]]) -> float:
    """Signed area, positive counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(vertices, [*vertices[1:], vertices[0]], strict=True)) / 2


def polygon_fault(vertices: Sequence[tuple[float, float]], low: float = -math.inf, high: float = math.inf) -> str | None:
    """Why a polygon can't select, or None."""
    n = len(vertices)
    if n < 3:
        return "fewer than three vertices"
    if not all(math.isfinite(c) for v in vertices for c in v):
        return "a vertex is not finite"
    if not low < high:
        return "empty height range"
    edges = [(vertices[i], vertices[(i + 1) % n]) for i in range(n)]
    if any(a == b for a, b in edges):
        return "adjacent vertices are equal"
    if abs(polygon_area(vertices)) <= 1e-12:
        return "no area"
    if any(segments_meet(*edges[i], *edges[j]) for i in range(n) for j in range(i + 1, n) if j - i not in (1, n - 1)):
        return "edges cross"
    return None


@dataclass(frozen=True)
class Polygon:
    """A simple polygon in xy with a height range; its boundary counts as inside."""

    vertices: tuple[tuple[float, float], ...]
    low: float = -math.inf
    high: float = math.inf
    inverted: bool = False

    def __post_init__(self) -> None:
        if fault := polygon_fault(self.vertices, self.low, self.high):
            raise ValueError(fault)

    def contains_xy(self, x: Column | None = None, y: Column | None = None) -> Column:
        """Inside or on the boundary, after a test of the bounding box that scans can push down."""
        x, y = F.col("x") if x is None else x, F.col("y") if y is None else y
        xs, ys = [v[0] for v in self.vertices], [v[1] for v in self.vertices]
        parity, edge = F.lit(False), F.lit(False)
        for (ax, ay), (bx, by) in zip(self.vertices, [*self.vertices[1:], self.vertices[0]], strict=True):
            ax, ay, bx, by = map(float, (ax, ay, bx, by))
            length = math.hypot(bx - ax, by - ay)
            if ay != by:
                parity = parity != (((y < ay) != (y < by)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax))
            off = F.abs((x - ax) * (by - ay) - (y - ay) * (bx - ax))
            along = (x - ax) * (bx - ax) + (y - ay) * (by - ay)
            edge = edge | ((off <= 1e-9 * max(1.0, length)) & along.between(-1e-9, length * length + 1e-9))
        margin = 1e-9
        box = x.between(min(xs) - margin, max(xs) + margin) & y.between(min(ys) - margin, max(ys) + margin)
        return box & (edge | parity)

    def contains(self) -> Column:
        inside = self.contains_xy()
        if self.low > -math.inf:
            inside = inside & (F.col("z") >= float(self.low))
        if self.high < math.inf:
            inside = inside & (F.col("z") <= float(self.high))
        return ~inside if self.inverted else inside

    @property
    def area(self) -> float:
        return abs(polygon_area(self.vertices))


def select_polygon(points: DataFrame, polygon: Polygon) -> DataFrame:
    """The finite points that a polygon selects."""
    return points.where(is_finite_point() & polygon.contains())


def shift_origin(points: DataFrame, origin: Sequence[float]) -> DataFrame:
    return points.withColumns({c: F.col(c) - float(o) for c, o in zip(XYZ, origin, strict=True)})


def transform_points(points: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Points under a 4 x 4 matrix; non-finite ones go, before and after."""
    moved = affine(*[F.col(c) for c in XYZ], matrix)
    return clean_points(clean_points(points).withColumns(dict(zip(XYZ, moved, strict=True))))


@dataclass(frozen=True)
class Placement:
    """A translation, a turn about z in degrees, and a uniform scale."""

    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: float = 0.0
    scale: float = 1.0

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (*self.shift, self.turn, self.scale))) or not 1e-9 < self.scale <= 1e6:
            raise ValueError("a placement needs finite numbers and a scale above 1e-9 and up to 1e6")

    def matrix(self) -> list[list[float]]:
        a = math.radians(normal_degrees(self.turn))
        c, s, k = math.cos(a), math.sin(a), self.scale
        return [[k * c, -k * s, 0.0, self.shift[0]], [k * s, k * c, 0.0, self.shift[1]], [0.0, 0.0, k, self.shift[2]], [0.0, 0.0, 0.0, 1.0]]


def compose(*matrices: Sequence[Sequence[float]]) -> list[list[float]]:
    """The matrix that applies the given ones in turn, the first one first."""
    return reduce(lambda done, m: np.asarray(m, float) @ done, matrices, np.eye(4)).tolist()


def invert(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    """The matrix that undoes another; a singular or non-finite one is refused."""
    m = np.asarray(matrix, float)
    if m.shape != (4, 4) or not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-30:
        raise ValueError("only a finite 4 x 4 matrix with a determinant can be inverted")
    return np.linalg.inv(m).tolist()


def normal_degrees(angle: float) -> float:
    """An angle within (-180, 180]."""
    a = math.fmod(angle, 360.0)
    return a - 360.0 if a > 180.0 else a + 360.0 if a <= -180.0 else a


def place_by_table(points: DataFrame, placements: DataFrame) -> DataFrame:
    """Each cloud under its own placement: ``cloud_id, tx, ty, tz, turn, scale``."""
    a = F.radians("turn")
    x, y, k = F.col("x"), F.col("y"), F.col("scale")
    joined = with_key_row(clean_points(points), placements, ["cloud_id"])
    return joined.withColumns({"x": k * (F.cos(a) * x - F.sin(a) * y) + F.col("tx"), "y": k * (F.sin(a) * x + F.cos(a) * y) + F.col("ty"), "z": k * F.col("z") + F.col("tz")}).select(*points.columns)


def heat_colour(points: DataFrame, threshold: float, distance: str = "distance") -> DataFrame:
    """r, g, b from blue over cyan and yellow to red as the distance nears the threshold."""
    d = F.col(distance)
    t = F.when(d <= 0, 0.0).otherwise(1.0) if threshold <= 0 else F.least(F.lit(1.0), d / threshold)
    stops = ((0.0, (0, 0, 255)), (1 / 3, (0, 255, 255)), (2 / 3, (255, 255, 0)), (1.0, (255, 0, 0)))

    def channel(i: int) -> Column:
        out = F.lit(float(stops[-1][1][i]))
        for (a, low), (b, high) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(t <= b, low[i] + (t - a) * ((high[i] - low[i]) / (b - a))).otherwise(out)
        return F.when(finite(d) & (d >= 0), F.round(out)).otherwise(float(stops[-1][1][i])).cast("smallint")

    return points.withColumns({c: channel(i) for i, c in enumerate("rgb")})


def cloud_stats(points: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Counts, colours, centroid, bounds and the lowest and highest point of each cloud, in one pass."""
    good = is_finite_point()

    def of(c: str) -> Column:
        return F.when(good, F.col(c).cast("double"))

    order = ["ordinal", "x", "y"]
    spot = F.when(good, F.struct(*XYZ))
    coloured = [F.count_if(good & ((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0))).alias("non_black")] if "r" in points.columns else []
    out = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_finite"), F.count_if(~good).alias("n_invalid"), *coloured,
        *[F.avg(of(c)).alias(f"c{c}") for c in XYZ], *[F.min(of(c)).alias(f"min_{c}") for c in XYZ], *[F.max(of(c)).alias(f"max_{c}") for c in XYZ],
        F.min_by(spot, F.when(good, F.struct("z", *order))).alias("lowest"), F.min_by(spot, F.when(good, F.struct(-F.col("z"), *order))).alias("highest"),
    )
    size = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ]
    return out.withColumns({**{f"size_{c}": s for c, s in zip(XYZ, size, strict=True)}, "diagonal": F.sqrt(size[0] * size[0] + size[1] * size[1] + size[2] * size[2])})


def robust_bounds(points: DataFrame, keys: Sequence[str] = ("cloud_id",), low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Quantile bounds of each axis, interpolated."""
    out = keyed_quantiles(clean_points(points), keys, {c: (F.col(c), (low, high)) for c in XYZ})
    return out.select(*keys, *[F.col(c)[i].alias(f"{side}_{c}") for c in XYZ for i, side in enumerate(("low", "high"))])


def height_histogram(points: DataFrame, bins: int, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """Equal bins of z from its least to its greatest value; the last one is closed, empty ones are rows too."""
    if not 1 <= bins <= 500:
        raise ValueError("bins must be 1 to 500")
    good = clean_points(points)
    span = good.groupBy(*keys).agg(F.min("z").cast("double").alias("z0"), F.max("z").cast("double").alias("z1"))
    span = span.withColumn("width", F.when(F.col("z1") > F.col("z0"), (F.col("z1") - F.col("z0")) / bins).otherwise(1.0))
    nth = F.least(F.floor((F.col("z") - F.col("z0")) / F.col("width")).cast("int"), F.lit(bins - 1))
    counted = good.join(span, list(keys)).groupBy(*keys, nth.alias("bin")).agg(F.count("*").alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    low = F.col("z0") + F.col("bin") * F.col("width")
    return every.join(counted, [*keys, "bin"], "left").select(*keys, "bin", low.alias("low"), (low + F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def voxel_downsample(points: DataFrame, size: float, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """One centroid (and mean colour) for each voxel; size 0 leaves the points as they are."""
    if size <= 0:
        return points
    voxel = [cell(F.col(c), size).alias(f"v{c}") for c in XYZ]
    colour = [F.floor(F.avg(c)).cast("smallint").alias(c) for c in "rgb" if c in points.columns]
    return clean_points(points).groupBy(*keys, *voxel).agg(*[F.avg(c).alias(c) for c in XYZ], *colour, F.count("*").alias("n"))


def split(points: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """The points that a condition keeps, and all others."""
    flag = F.coalesce(flag, F.lit(False))
    return points.where(flag), points.where(~flag)
