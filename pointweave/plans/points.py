"""Point queries: cleaning, selections, statistics, fits, grids, over line items and embeddings seen as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import fits as G
from ..operators import points as O
from ..operators import regions as Q
from ..operators import sequences as S
from .tables import POINTS, SMALL_POINTS, points, rounded, small_points, table

BOX = O.Box((5.0, 5.0, 10.0), (30.0, 40.0, 60.0))
#: A concave polygon over quantities and discounts.
SHAPE = O.Polygon(((5.0, 5.0), (45.0, 5.0), (45.0, 45.0), (25.0, 20.0), (5.0, 45.0)), 10.0, 80.0)
PATH = ((1.0, 10.0), (40.0, 10.0), (40.0, 40.0))
PLACED = O.Placement((1.0, -2.0, 0.5), 30.0, 2.0)


def _faulty(spark, sf_dir):
    """Points, some with NaN or infinite heights."""
    bad = F.when(F.col("ordinal") % 97 == 0, F.lit(float("nan"))).when(F.col("ordinal") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("z"))
    return points(spark, sf_dir).withColumn("z", bad)


def clean_points(spark, sf_dir):
    p = _faulty(spark, sf_dir)
    return p.groupBy("cloud_id").agg(F.count("*").alias("header"), F.count_if(O.is_finite_point()).alias("finite"), F.count_if(~O.is_finite_point()).alias("invalid"))


def colour_normalise(spark, sf_dir):
    packed = F.when(F.col("ordinal") % 5 == 0, None).otherwise(F.col("r").cast("long") * 65536 + F.col("g") * 256 + F.lit(4278190080))
    return O.unpack_colour(points(spark, sf_dir).withColumn("rgba", packed), "rgba").groupBy("r", "g", "b", "a").agg(F.count("*").alias("n"))


def intensity_to_gray(spark, sf_dir):
    v = F.when(F.col("frame_id") % 2 == 0, F.col("x") / 50).otherwise(F.col("z"))
    return O.intensity_to_gray(points(spark, sf_dir).withColumn("intensity", v)).groupBy("cloud_id", "frame_id", "gray").agg(F.count("*").alias("n"))


def select_box(spark, sf_dir):
    p = _faulty(spark, sf_dir)
    return O.select_box(p, BOX).withColumn("side", F.lit("in")).unionByName(O.select_box(p, BOX.invert()).withColumn("side", F.lit("out"))).groupBy("cloud_id", "side").agg(F.count("*").alias("n"))


def select_height(spark, sf_dir):
    return O.select_height(_faulty(spark, sf_dir), 20.0, 40.0, True).groupBy("cloud_id", "frame_id").agg(F.count("*").alias("n"))


def select_xy(spark, sf_dir):
    return O.select_xy(points(spark, sf_dir), (30.0, 5.0), (10.0, 25.0)).groupBy("cloud_id", "frame_id").agg(F.count("*").alias("n"))


def select_polygon(spark, sf_dir):
    return O.select_polygon(points(spark, sf_dir), SHAPE).groupBy("cloud_id", "x", "y").agg(F.count("*").alias("n"))


def _quads(spark, sf_dir):
    """A polygon of four vertices, or two, for each supplier; some with a vertex twice or without a height range."""
    k = F.col("s_suppkey")
    corner = [F.pmod(k * m, F.lit(n)).cast("double") for m, n in ((7, 11), (5, 13), (3, 17), (11, 7), (13, 19), (17, 23), (19, 29), (23, 31))]
    v = F.array(*[F.struct(corner[2 * i].alias("x"), corner[2 * i + 1].alias("y")) for i in range(4)])
    return table(spark, sf_dir, "supplier").select(k.alias("polygon_id"), v.alias("vertices"))


def polygon_validate(spark, sf_dir):
    return Q.crossing_polygons(Q.edges_of(_quads(spark, sf_dir)))


def polygon_faults(spark, sf_dir):
    k, v = F.col("polygon_id"), F.col("vertices")
    odd = F.when(k % 11 == 0, F.slice(v, 1, 2)).when(k % 7 == 0, F.concat(F.slice(v, 1, 2), F.slice(v, 2, 2))).otherwise(v)
    edges = Q.edges_of(_quads(spark, sf_dir).withColumn("vertices", odd)).withColumns({"low": F.lit(0.0), "high": (k % 5).cast("double")})
    return Q.polygon_faults(edges)


def shift_origin(spark, sf_dir):
    return rounded(O.shift_origin(points(spark, sf_dir), (25.0, 25.0, 50.0)).groupBy("cloud_id").agg(*[F.max(c).alias(c) for c in "xyz"]))


def unit_convert(spark, sf_dir):
    return rounded(points(spark, sf_dir).groupBy("cloud_id").agg(F.max(N.convert_length(F.col("x"), "cm")).alias("cm"), F.max(N.convert_area(F.col("x") * F.col("y"), "mm")).alias("mm2")), 2)


def apply_transform(spark, sf_dir):
    return rounded(O.transform_points(_faulty(spark, sf_dir), PLACED.matrix()).groupBy("cloud_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"]), 4)


def transform_from_params(spark, sf_dir):
    placements = points(spark, sf_dir).groupBy("cloud_id").agg(F.min("x").alias("tx"), F.min("y").alias("ty"), F.min("z").alias("tz")).withColumns({"turn": F.lit(45.0), "scale": F.lit(0.5)})
    return rounded(O.place_by_table(points(spark, sf_dir), placements).groupBy("cloud_id", "frame_id").agg(*[F.avg(c).alias(c) for c in "xyz"]), 4)


def heat_colour(spark, sf_dir):
    return O.heat_colour(points(spark, sf_dir).withColumn("distance", F.floor(F.col("x")) / 10), 4.0).groupBy("distance", "r", "g", "b").agg(F.count("*").alias("n"))


def cloud_stats(spark, sf_dir):
    return rounded(O.cloud_stats(points(spark, sf_dir).drop("ordinal").withColumn("ordinal", F.lit(0))).drop("lowest", "highest"), 4)


def low_high_point(spark, sf_dir):
    out = O.cloud_stats(small_points(spark, sf_dir), ["cloud_id", "frame_id"])
    return rounded(out.select("cloud_id", "frame_id", F.col("lowest.x").alias("lx"), F.col("lowest.z").alias("lz"), F.col("highest.x").alias("hx"), F.col("highest.z").alias("hz")))


def robust_bounds(spark, sf_dir):
    return rounded(O.robust_bounds(points(spark, sf_dir)))


def height_histogram(spark, sf_dir):
    return rounded(O.height_histogram(points(spark, sf_dir), 20), 4)


def voxel_downsample(spark, sf_dir):
    return rounded(O.voxel_downsample(points(spark, sf_dir).select("cloud_id", "x", "y", "z"), 5.0), 7)


def assign_region(spark, sf_dir):
    k = F.col("s_suppkey")
    lows = [F.pmod(k * m, F.lit(40)).cast("double") for m in (3, 7, 11)]
    boxes = table(spark, sf_dir, "supplier").select(k.alias("region_id"), *[low.alias(f"{c}0") for c, low in zip("xyz", lows, strict=True)], *[(low + 6).alias(f"{c}1") for c, low in zip("xyz", lows, strict=True)])
    return Q.region_sums(points(spark, sf_dir), Q.box_edges(boxes))


def assign_region_polygon(spark, sf_dir):
    """Points by concave regions: an L of some size for each supplier, within a band of heights."""
    k = F.col("s_suppkey")
    a, c, low = (F.pmod(k * m, F.lit(40)).cast("double") for m in (3, 7, 11))
    shape = F.array(*[F.struct((a + i * (1 + k % 3)).alias("x"), (c + j * (1 + k % 3)).alias("y")) for i, j in ((0, 0), (9, 0), (9, 4), (4, 4), (4, 9), (0, 9))])
    regions = table(spark, sf_dir, "supplier").select(k.alias("region_id"), shape.alias("vertices"), low.alias("low"), (low + 30).alias("high"))
    edges = Q.edges_of(regions, key="region_id").join(regions.drop("vertices"), "region_id")
    return Q.region_sums(points(spark, sf_dir), edges, {"ordinals": F.col("ordinal")})


def stride_sample(spark, sf_dir):
    return S.stride_sample(small_points(spark, sf_dir), ["ordinal"], 60).select("ordinal", "position")


def plane_fit(spark, sf_dir):
    return rounded(G.plane_fit(points(spark, sf_dir)).drop("nx", "ny", "azimuth_deg"), 4)


def plane_fit_grouped(spark, sf_dir):
    return rounded(G.plane_fit(small_points(spark, sf_dir), ["cloud_id", "frame_id"]), 4)


def oriented_box_global(spark, sf_dir):
    return rounded(G.oriented_box(small_points(spark, sf_dir)), 5)


def oriented_box_region(spark, sf_dir):
    return rounded(G.oriented_box_region(small_points(spark, sf_dir), ["cloud_id", "frame_id"]), 5)


def region_stats(spark, sf_dir):
    return rounded(G.region_stats(O.select_box(points(spark, sf_dir), BOX), ["cloud_id", "frame_id"]), 5)


def elevation_profile(spark, sf_dir):
    return rounded(G.elevation_profile(points(spark, sf_dir), PATH, 6.0, 2.5), 7)


def grid_volume(spark, sf_dir):
    return rounded(G.grid_volume(points(spark, sf_dir), SHAPE, 50.0, 2.0), 2)


def possible_cells(spark, sf_dir):
    cells = G.possible_cells(spark, SHAPE, 2.0)
    used = G.grid_cells(points(spark, sf_dir), SHAPE, 50.0, 2.0).select("i", "j").distinct().withColumn("used", F.lit(True))
    return cells.join(used, ["i", "j"], "left").groupBy("j").agg(F.count("*").alias("cells"), F.count("used").alias("used"))


def split_kept_removed(spark, sf_dir):
    kept, removed = O.split(_faulty(spark, sf_dir), BOX.contains() & O.is_finite_point())
    return kept.withColumn("part", F.lit("kept")).unionByName(removed.withColumn("part", F.lit("removed"))).groupBy("part", "cloud_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (clean_points, colour_normalise, intensity_to_gray, select_box, select_height, select_xy, select_polygon, polygon_validate, polygon_faults, assign_region_polygon, shift_origin, unit_convert, apply_transform, transform_from_params, heat_colour, cloud_stats, low_high_point, robust_bounds, height_histogram, voxel_downsample, assign_region, stride_sample, plane_fit, plane_fit_grouped, oriented_box_global, oriented_box_region, region_stats, elevation_profile, grid_volume, possible_cells, split_kept_removed)}

_BAD = f"{POINTS}, f AS (SELECT * REPLACE (CASE WHEN ordinal % 97 = 0 THEN 'nan'::DOUBLE WHEN ordinal % 89 = 0 THEN 'inf'::DOUBLE ELSE z END AS z), ordinal % 97 <> 0 AND ordinal % 89 <> 0 AS ok FROM p)"
_IN = "x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 40 AND z BETWEEN 10 AND 60"
# the polygon's edges, the even-odd rule and the boundary test
_EDGES = "e(ax, ay, bx, cy) AS (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(SHAPE.vertices, [*SHAPE.vertices[1:], SHAPE.vertices[0]], strict=True)) + ")"


def _box(keys: str, source: str) -> str:
    """DuckDB's oriented boxes of the small points; of a cropped whole cloud, or of uncropped regions."""
    whole = source == "crop"
    cut = " AND ".join(f"{c} BETWEEN q{c}[1] AND q{c}[2]" for c in "xyz")
    trim = "true" if whole else "points_used >= 200"
    return f"""WITH {SMALL_POINTS}, q AS (SELECT {keys}, count(*) AS n_all, {", ".join(f"quantile_cont({c}, [0.001, 0.999]) AS q{c}" for c in "xyz")} FROM p GROUP BY {keys}),
crop AS (SELECT p.* FROM p JOIN q USING ({keys}) WHERE n_all < 200 OR ({cut})),
a AS (SELECT {keys}, count(*) AS points_used, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS angle FROM {source} GROUP BY {keys} HAVING count(*) >= 3),
j AS (SELECT {keys}, points_used, mx, my, angle, cos(angle) * (x - mx) + sin(angle) * (y - my) AS u, cos(angle) * (y - my) - sin(angle) * (x - mx) AS v, z FROM {source} JOIN a USING ({keys})),
e AS (SELECT {keys}, points_used, mx, my, angle, {", ".join(f"CASE WHEN {trim} THEN quantile_cont({c}, [0.005, 0.995]) ELSE [min({c}), max({c})] END AS e{c}" for c in "uvz")} FROM j GROUP BY {keys}, points_used, mx, my, angle),
s AS (SELECT *, eu[2] - eu[1] AS su, ev[2] - ev[1] AS sv, ez[2] - ez[1] AS sz, (eu[1] + eu[2]) / 2 AS hu, (ev[1] + ev[2]) / 2 AS hv FROM e)
SELECT {keys}, points_used, round(degrees({"angle" if whole else "CASE WHEN sv > su THEN atan2(cos(angle), -sin(angle)) ELSE angle END"}), 5) AS yaw_deg,
    round(greatest(su, sv), 5) AS length, round(least(su, sv), 5) AS width, round(sz, 5) AS height,
    round({"mx + cos(angle) * hu - sin(angle) * hv" if whole else "mx"}, 5) AS cx, round({"my + sin(angle) * hu + cos(angle) * hv" if whole else "my"}, 5) AS cy, round((ez[1] + ez[2]) / 2, 5) AS cz,
    round(sqrt(su * su + sv * sv), 5) AS diagonal_xy, round(sqrt(su * su + sv * sv + sz * sz), 5) AS diagonal FROM s"""


def _inside(src: str, x: str, y: str, keep: str) -> str:
    return f"""(SELECT {keep} FROM (SELECT DISTINCT {x} AS qx, {y} AS qy FROM {src}) q, e GROUP BY qx, qy
HAVING count(*) FILTER ((qy < ay) <> (qy < cy) AND qx < (qy - ay) * ((bx - ax) / nullif(cy - ay, 0)) + ax) % 2 = 1
OR bool_or(abs((qx - ax) * (cy - ay) - (qy - ay) * (bx - ax)) <= 1e-9 * greatest(1, sqrt((bx-ax)**2 + (cy-ay)**2)) AND (qx - ax) * (bx - ax) + (qy - ay) * (cy - ay) BETWEEN -1e-9 AND (bx-ax)**2 + (cy-ay)**2 + 1e-9))"""


#: DuckDB's four corners of each supplier, the same with odd ones, and the polygons whose opposite edges meet.
_QUADS = "k AS (SELECT s_suppkey AS id, [{'x': s_suppkey*7%11, 'y': s_suppkey*5%13}, {'x': s_suppkey*3%17, 'y': s_suppkey*11%7}, {'x': s_suppkey*13%19, 'y': s_suppkey*17%23}, {'x': s_suppkey*19%29, 'y': s_suppkey*23%31}] AS v FROM supplier)"
_ODD_QUADS = _QUADS.replace("k AS", "k0 AS") + ", k AS (SELECT id, CASE WHEN id % 11 = 0 THEN v[1:2] WHEN id % 7 = 0 THEN list_concat(v[1:2], v[2:3]) ELSE v END AS v FROM k0)"
_CROSS = """e AS (SELECT id, len(v) AS n, i, v[i + 1].x AS ax, v[i + 1].y AS ay, v[(i + 1) % len(v) + 1].x AS bx, v[(i + 1) % len(v) + 1].y AS by FROM k, range(4) r(i) WHERE i < len(v)),
s AS (SELECT a.id, a.ax AS px, a.ay AS py, a.bx - a.ax AS rx, a.by - a.ay AS ry, b.ax AS qx, b.ay AS qy, b.bx - b.ax AS sx, b.by - b.ay AS sy FROM e a JOIN e b ON a.id = b.id AND b.i - a.i = 2),
t AS (SELECT *, rx * sy - ry * sx AS d, (qx - px) * sy - (qy - py) * sx AS tn, (qx - px) * ry - (qy - py) * rx AS un, rx * rx + ry * ry AS rr, sx * sx + sy * sy AS ss, (qx - px) * rx + (qy - py) * ry AS t0, sx * rx + sy * ry AS dt FROM s),
x AS (SELECT DISTINCT id AS polygon_id FROM t WHERE CASE
    WHEN rr = 0 THEN tn = 0 AND (px - qx) * sx + (py - qy) * sy BETWEEN 0 AND ss
    WHEN ss = 0 THEN un = 0 AND t0 BETWEEN 0 AND rr
    WHEN d <> 0 THEN tn / d::DOUBLE BETWEEN 0 AND 1 AND un / d::DOUBLE BETWEEN 0 AND 1
    ELSE un = 0 AND least(t0, t0 + dt) <= rr AND greatest(t0, t0 + dt) >= 0 END)"""
_CELLS = f"g AS (SELECT i, j, 5 + (i + 0.5) * 2 AS x, 5 + (j + 0.5) * 2 AS y FROM range(20) a(i), range(20) b(j)), gc AS (SELECT i, j FROM g JOIN {_inside('g', 'x', 'y', 'qx, qy')} s ON qx = x AND qy = y)"
_USED = f"u AS (SELECT cloud_id, greatest(0, least(19, floor((x - 5) / 2)::INT)) AS i, greatest(0, least(19, floor((y - 5) / 2)::INT)) AS j, z FROM p JOIN {_inside('p', 'x', 'y', 'qx, qy')} s ON qx = x AND qy = y)"
_M = PLACED.matrix()
_LEGS = [(1.0, 10.0, 1.0, 0.0, 39.0, 0.0), (40.0, 10.0, 0.0, 1.0, 30.0, 39.0)]
ORACLES = {
    "clean_points": f"WITH {_BAD} SELECT cloud_id, count(*) AS header, count(*) FILTER (ok) AS finite, count(*) FILTER (NOT ok) AS invalid FROM f GROUP BY 1",
    "colour_normalise": f"WITH {POINTS} SELECT CASE WHEN ordinal % 5 = 0 THEN 205 ELSE r END::SMALLINT AS r, CASE WHEN ordinal % 5 = 0 THEN 215 ELSE g END::SMALLINT AS g, CASE WHEN ordinal % 5 = 0 THEN 225 ELSE b END::SMALLINT AS b, 255::SMALLINT AS a, count(*) AS n FROM p GROUP BY ALL",
    "intensity_to_gray": f"""WITH {POINTS}, i AS (SELECT *, CASE WHEN frame_id % 2 = 0 THEN x / 50 ELSE z END AS v FROM p), s AS (SELECT *, min(v) OVER w >= 0 AND max(v) OVER w <= 1 AS unit FROM i WINDOW w AS (PARTITION BY cloud_id, frame_id))
SELECT cloud_id, frame_id, floor(least(255, greatest(0, CASE WHEN unit THEN v * 255 ELSE v END)))::SMALLINT AS gray, count(*) AS n FROM s GROUP BY ALL""",
    "select_box": f"WITH {_BAD} SELECT cloud_id, CASE WHEN {_IN} THEN 'in' ELSE 'out' END AS side, count(*) AS n FROM f WHERE ok GROUP BY ALL",
    "select_height": f"WITH {_BAD} SELECT cloud_id, frame_id, count(*) AS n FROM f WHERE ok AND NOT z BETWEEN 20 AND 40 GROUP BY ALL",
    "select_xy": f"WITH {POINTS} SELECT cloud_id, frame_id, count(*) AS n FROM p WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 GROUP BY ALL",
    "select_polygon": f"WITH {POINTS}, {_EDGES} SELECT cloud_id, x, y, count(*) AS n FROM p JOIN {_inside('p', 'x', 'y', 'qx, qy')} s ON qx = x AND qy = y WHERE z BETWEEN 10 AND 80 GROUP BY ALL",
    "polygon_validate": f"WITH {_QUADS}, {_CROSS} SELECT polygon_id FROM x",
    "polygon_faults": f"""WITH {_ODD_QUADS}, {_CROSS}, a AS (SELECT id, max(n) AS n, bool_or(ax = bx AND e.by = ay) AS twice, abs(sum(ax * e.by - bx * ay)) / 2 AS area FROM e GROUP BY 1)
SELECT id AS polygon_id, CASE WHEN n < 3 THEN 'fewer than three vertices' WHEN id % 5 = 0 THEN 'empty height range' WHEN twice THEN 'adjacent vertices are equal' WHEN area = 0 THEN 'no area'
    WHEN id IN (SELECT polygon_id FROM x) THEN 'edges cross' END AS fault FROM a""",
    "assign_region_polygon": f"""WITH {POINTS}, r AS (SELECT s_suppkey AS region_id, s_suppkey * 3 % 40 AS a, s_suppkey * 7 % 40 AS c, s_suppkey * 11 % 40 AS d, 1 + s_suppkey % 3 AS f FROM supplier)
SELECT region_id, count(*) AS n, sum(ordinal)::BIGINT AS ordinals FROM p JOIN r ON z BETWEEN d AND d + 30 AND x BETWEEN a AND a + 9 * f AND y BETWEEN c AND c + 9 * f AND (x <= a + 4 * f OR y <= c + 4 * f) GROUP BY 1""",
    "oriented_box_global": _box("cloud_id", "crop"),
    "oriented_box_region": _box("cloud_id, frame_id", "p"),
    "shift_origin": f"WITH {POINTS} SELECT cloud_id, round(max(x - 25), 6) AS x, round(max(y - 25), 6) AS y, round(max(z - 50), 6) AS z FROM p GROUP BY 1",
    "unit_convert": f"WITH {POINTS} SELECT cloud_id, round(max(x * 100), 2) AS cm, round(max(x * y * 1000000), 2) AS mm2 FROM p GROUP BY 1",
    "apply_transform": f"WITH {_BAD} SELECT cloud_id, count(*) AS n, " + ", ".join(f"round(avg(x * {r[0]!r} + y * {r[1]!r} + z * {r[2]!r} + {r[3]!r}), 4) AS {c}" for c, r in zip("xyz", _M, strict=False)) + " FROM f WHERE ok GROUP BY 1",
    "transform_from_params": f"""WITH {POINTS}, t AS (SELECT cloud_id, min(x) AS tx, min(y) AS ty, min(z) AS tz FROM p GROUP BY 1)
SELECT cloud_id, frame_id, round(avg(0.5 * (cos(pi()/4) * x - sin(pi()/4) * y) + tx), 4) AS x, round(avg(0.5 * (sin(pi()/4) * x + cos(pi()/4) * y) + ty), 4) AS y, round(avg(0.5 * z + tz), 4) AS z FROM p JOIN t USING (cloud_id) GROUP BY ALL""",
    "heat_colour": f"""WITH {POINTS}, d AS (SELECT floor(x) / 10 AS distance, least(1, floor(x) / 10 / 4) AS t FROM p)
SELECT distance, round(CASE WHEN t <= 1/3 THEN 0 WHEN t <= 2/3 THEN (t - 1/3) * 765 ELSE 255 END)::SMALLINT AS r, round(CASE WHEN t <= 1/3 THEN t * 765 WHEN t <= 2/3 THEN 255 ELSE 255 - (t - 2/3) * 765 END)::SMALLINT AS g,
round(CASE WHEN t <= 1/3 THEN 255 WHEN t <= 2/3 THEN 255 - (t - 1/3) * 765 ELSE 0 END)::SMALLINT AS b, count(*) AS n FROM d GROUP BY ALL""",
    "cloud_stats": f"""WITH {POINTS} SELECT cloud_id, count(*) AS n, count(*) AS n_finite, 0 AS n_invalid, count(*) FILTER (r <> 0 OR g <> 0 OR b <> 0) AS non_black, """
    + ", ".join(f"round(avg({c}), 4) AS c{c}, round(min({c}), 4) AS min_{c}, round(max({c}), 4) AS max_{c}, round(max({c}) - min({c}), 4) AS size_{c}" for c in "xyz")
    + ", round(sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2), 4) AS diagonal FROM p GROUP BY 1",
    "low_high_point": f"""WITH {SMALL_POINTS} SELECT cloud_id, frame_id, round(first(x ORDER BY z, ordinal), 6) AS lx, round(min(z), 6) AS lz, round(first(x ORDER BY z DESC, ordinal), 6) AS hx, round(max(z), 6) AS hz FROM p GROUP BY ALL""",
    "robust_bounds": f"WITH {POINTS} SELECT cloud_id, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {s}_{c}" for c in "xyz" for s, q in (("low", 0.005), ("high", 0.995))) + " FROM p GROUP BY 1",
    "height_histogram": f"""WITH {POINTS}, s AS (SELECT cloud_id, min(z) AS a, max(z) AS b, (max(z) - min(z)) / 20 AS w FROM p GROUP BY 1), c AS (SELECT cloud_id, least(19, floor((z - a) / w)::INT) AS bin, count(*) AS n FROM p JOIN s USING (cloud_id) GROUP BY ALL)
SELECT s.cloud_id, k::INT AS bin, round(a + k * w, 4) AS low, round(a + k * w + w, 4) AS high, coalesce(n, 0) AS n FROM s, range(20) r(k) LEFT JOIN c ON c.cloud_id = s.cloud_id AND c.bin = k""",
    "voxel_downsample": f"WITH {POINTS} SELECT cloud_id, floor(x / 5)::BIGINT AS vx, floor(y / 5)::BIGINT AS vy, floor(z / 5)::BIGINT AS vz, round(avg(x), 7) AS x, round(avg(y), 7) AS y, round(avg(z), 7) AS z, count(*) AS n FROM p GROUP BY 1, 2, 3, 4",
    "assign_region": f"""WITH {POINTS}, b AS (SELECT s_suppkey AS region_id, s_suppkey * 3 % 40 AS a, s_suppkey * 7 % 40 AS c, s_suppkey * 11 % 40 AS d FROM supplier)
SELECT region_id, count(*) AS n FROM p JOIN b ON x BETWEEN a AND a + 6 AND y BETWEEN c AND c + 6 AND z BETWEEN d AND d + 6 GROUP BY 1""",
    "stride_sample": f"WITH {SMALL_POINTS}, r AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS position, count(*) OVER () AS n FROM p) SELECT ordinal, position FROM r WHERE position % ceil(n / 60)::BIGINT = 0",
    "region_stats": f"""WITH {POINTS}, s AS (SELECT * FROM p WHERE {_IN}) SELECT cloud_id, frame_id, count(*) AS n, """
    + ", ".join(f"round(min({c}), 5) AS min_{c}, round(max({c}), 5) AS max_{c}, round(avg({c}), 5) AS mean_{c}" for c in "xyz")
    + ", round(stddev_pop(z), 5) AS std_z, round(count(*) / ((max(x)-min(x)) * (max(y)-min(y))), 5) AS per_area, round(count(*) / ((max(x)-min(x)) * (max(y)-min(y)) * (max(z)-min(z))), 5) AS per_volume FROM s GROUP BY ALL HAVING count(*) >= 3",
    "elevation_profile": f"""WITH {POINTS}, l(k, ax, ay, ux, uy, len, s0) AS (VALUES {", ".join(f"({i}, {', '.join(f'{v}::DOUBLE' for v in leg)})" for i, leg in enumerate(_LEGS))}),
q AS (SELECT DISTINCT x, y FROM p), d AS (SELECT x, y, k, least(len, greatest(0, (x - ax) * ux + (y - ay) * uy)) AS al, * EXCLUDE (x, y, k) FROM q, l),
m AS (SELECT x, y, first({{'d': (x - ax - al * ux)**2 + (y - ay - al * uy)**2, 's': al + s0}} ORDER BY (x - ax - al * ux)**2 + (y - ay - al * uy)**2, k) AS near FROM d GROUP BY ALL),
c AS (SELECT cloud_id, least(27, floor(near.s / 2.5)::INT) AS bin, count(*) AS n, min(z) AS a, avg(z) AS b, median(z) AS c, max(z) AS d FROM p JOIN m USING (x, y) WHERE near.d <= 9 GROUP BY ALL)
SELECT cloud_id, k::INT AS bin, k * 2.5::DOUBLE AS start, least(69, (k + 1) * 2.5)::DOUBLE AS end, coalesce(n, 0) AS n, round(a, 7) AS min_z, round(b, 7) AS mean_z, round(c, 7) AS median_z, round(d, 7) AS max_z
FROM (SELECT DISTINCT cloud_id FROM p), range(28) r(k) LEFT JOIN c USING (cloud_id) WHERE c.bin = k OR c.bin IS NULL""".replace("LEFT JOIN c USING (cloud_id) WHERE c.bin = k OR c.bin IS NULL", "LEFT JOIN (SELECT cloud_id AS ci, * EXCLUDE (cloud_id) FROM c) ON ci = cloud_id AND bin = k"),
    "grid_volume": f"""WITH {POINTS}, {_EDGES}, {_CELLS}, {_USED}, c AS (SELECT cloud_id, i, j, count(*) AS n, (avg(z) - 50) * 4 AS v FROM u GROUP BY ALL)
SELECT cloud_id, count(*) AS occupied_cells, sum(n)::BIGINT AS n, round(sum(greatest(v, 0)), 2) AS above, round(sum(greatest(-v, 0)), 2) AS below, round(sum(greatest(v, 0)) - sum(greatest(-v, 0)), 2) AS net,
count(*) * 4.0 AS covered_area, {SHAPE.area}::DOUBLE AS boundary_area, (SELECT count(*) FROM gc) AS possible_cells, round(greatest(0, 100.0 * ((SELECT count(*) FROM gc) - count(*)) / (SELECT count(*) FROM gc)), 2) AS empty_pct FROM c GROUP BY 1""",
    "possible_cells": f"""WITH {POINTS}, {_EDGES}, {_CELLS}, {_USED}, d AS (SELECT DISTINCT i, j FROM u) SELECT j::INT AS j, count(*) AS cells, count(d.i) AS used FROM gc LEFT JOIN d USING (i, j) GROUP BY 1""",
    "split_kept_removed": f"WITH {_BAD} SELECT CASE WHEN ok AND {_IN} THEN 'kept' ELSE 'removed' END AS part, cloud_id, count(*) AS n FROM f GROUP BY ALL",
}
