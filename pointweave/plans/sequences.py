"""Frame sequence and measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import measure as M
from ..operators import sequences as S
from .tables import rounded, table


def _frames(spark, sf_dir, kind="view"):
    """Events of a type as frames of ten sessions."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind).withColumns({"cloud_id": (F.col("user_id") % 10).cast("string"), "ts_s": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    e = S.dense_position(e, ["event_id"], ["cloud_id"]).withColumn("frame_idx", F.col("position").cast("long"))
    n = F.floor("value").cast("long")
    return e.select("cloud_id", "frame_idx", F.col("event_id").alias("frame_id"), "ts_s", (n + F.col("event_id") % 3).alias("source_point_count"), n.alias("point_count"))


def _images(spark, sf_dir):
    return _frames(spark, sf_dir, "click").select("cloud_id", F.col("frame_idx").alias("idx"), F.col("frame_id").alias("id"), "ts_s")


def asof_nearest_image(spark, sf_dir):
    return rounded(R.asof_nearest(_frames(spark, sf_dir), _images(spark, sf_dir)), 3)


def proportional_image(spark, sf_dir):
    return R.proportional_image(_frames(spark, sf_dir), _images(spark, sf_dir)).select("cloud_id", "frame_idx", "idx", "image_id")


def point_offsets(spark, sf_dir):
    return R.point_offsets(_frames(spark, sf_dir)).select("cloud_id", "frame_idx", "point_offset")


def relative_time(spark, sf_dir):
    return rounded(R.relative_time(_frames(spark, sf_dir)).select("cloud_id", "frame_idx", "relative_s"), 3)


def sliding_frames(spark, sf_dir):
    return R.sliding_points(_frames(spark, sf_dir), 20).select("cloud_id", "frame_idx", "single", "window", "all")


def frame_totals(spark, sf_dir):
    return rounded(R.frame_totals(_frames(spark, sf_dir), _frames(spark, sf_dir, "signup"), _images(spark, sf_dir)), 3)


def time_reversals(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("ts_s", F.col("ts_s") - F.col("source_point_count") * 1000)
    return S.time_reversals(f, ["cloud_id"], "frame_idx", "ts_s")


def companion_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cloud_id", F.col("user_id").cast("string"))
    out = R.companion_missing(e.select("cloud_id").distinct(), e.select("cloud_id", F.col("event_type").alias("name")).distinct(), ["view", "click", "pose"])
    return out.select("cloud_id", F.array_join("missing", ",").alias("missing"))


def update_rate_ewma(spark, sf_dir):
    return rounded(R.update_rate(_frames(spark, sf_dir)))


def _vertex(a, b, c):
    return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"), c.cast("double").alias("z"))


def _measurements(spark, sf_dir):
    """Orders as measurements: kinds by key, vertices from key, customer and price."""
    o = table(spark, sf_dir, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    kinds = list(M.KINDS)
    kind = F.get(F.array(*map(F.lit, kinds)), (k % len(kinds)).cast("int"))
    points = [_vertex(k % (7 + i), c % (11 + i), F.floor(p) % (5 + i)) for i in range(4)]
    n = F.get(F.array(*map(F.lit, [v[0] for v in M.KINDS.values()])), (k % len(kinds)).cast("int")) + F.when(k % 16 > 13, 1).otherwise(0)
    return o.select(k.alias("id"), kind.alias("kind"), F.concat(F.lit("n"), (k % 13).cast("string")).alias("name"), F.when(c % 3 > 0, F.concat(F.lit("G"), (c % 3).cast("string"))).otherwise("").alias("grp"), F.col("o_orderpriority").alias("note"), F.slice(F.array(*points), 1, n).alias("vertices"))


def measure_rows(spark, sf_dir):
    return rounded(M.measure_rows(_measurements(spark, sf_dir)).drop("vertices", "name", "grp", "note"), 5)


def path_length(spark, sf_dir):
    return rounded(M.measure_rows(_measurements(spark, sf_dir)).where("kind in ('segment', 'polyline')").select("id", "length", "horizontal_length"), 5)


def polygon_area(spark, sf_dir):
    return rounded(M.polygon_area(_measurements(spark, sf_dir).where("kind = 'area'")).select("id", "plane_area", "rms", "error"), 5)


def transform_measurements(spark, sf_dir):
    turn = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    return rounded(M.transform_measurements(_measurements(spark, sf_dir), turn).select("id", "error", "length", "angle_deg", "horizontal_area", "radius"), 5)


def filter_measurements(spark, sf_dir):
    return M.filter_measurements(_measurements(spark, sf_dir), group="default", text="URGENT").select("id", "kind")


def linear_total(spark, sf_dir):
    return rounded(M.linear_total(M.measure_rows(_measurements(spark, sf_dir))), 3)


def measurement_groups(spark, sf_dir):
    return M.groups(_measurements(spark, sf_dir))


def measurement_json(spark, sf_dir):
    return rounded(M.from_json(M.to_json(_measurements(spark, sf_dir).withColumn("id", F.col("id").cast("int")))).select("id", "kind", "error", "length"), 5)


def reassign_ids(spark, sf_dir):
    taken = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return M.reassign_ids(_measurements(spark, sf_dir).select("id", "kind", "name"), taken).select("id")


def import_counts(spark, sf_dir):
    return M.import_counts(_measurements(spark, sf_dir))


QUERIES = {f.__name__: f for f in (import_counts, asof_nearest_image, proportional_image, point_offsets, relative_time, sliding_frames, frame_totals, time_reversals, companion_missing, update_rate_ewma, measure_rows, path_length, polygon_area, transform_measurements, filter_measurements, linear_total, measurement_groups, measurement_json, reassign_ids)}


def _f(name: str, kind: str) -> str:
    return f"{name} AS (SELECT (user_id % 10)::VARCHAR AS cloud_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS frame_idx, event_id AS frame_id, epoch_us(ts) / 1e6 AS ts_s, floor(value)::BIGINT + event_id % 3 AS source_point_count, floor(value)::BIGINT AS point_count FROM events WHERE event_type = '{kind}')"


_F, _I = _f("f", "view"), _f("i", "click")
_DEFAULT = "CASE WHEN o_custkey % 3 > 0 THEN 'G' || (o_custkey % 3) ELSE 'default' END"
_P = [f"o_orderkey % {7 + i} AS x{i}, o_custkey % {11 + i} AS y{i}, floor(o_totalprice)::BIGINT % {5 + i} AS z{i}" for i in range(4)]
_LEG = "sqrt((x0-x1)**2 + (y0-y1)**2 + (z0-z1)**2) + CASE WHEN id % 16 > 13 THEN sqrt((x1-x2)**2 + (y1-y2)**2 + (z1-z2)**2) ELSE 0 END"
_PATHS = f"v AS (SELECT o_orderkey AS id, {', '.join(_P)} FROM orders), s AS (SELECT id, sqrt((x0-x1)**2 + (y0-y1)**2 + (z0-z1)**2) AS length, sqrt((x0-x1)**2 + (y0-y1)**2) AS horizontal_length FROM v WHERE id % 8 IN (1, 2) AND id % 16 <= 13)"
_AXES = "xyz"
_KINDS = "['point','segment','polyline','height','angle','area','point_plane','circle']"


def _diff(a: int, b: int, name: str) -> str:
    return ", ".join(f"{c}{a} - {c}{b} AS {name}{c}" for c in _AXES)


def _cross(a: str, b: str, name: str) -> str:
    return ", ".join(f"{a}{p} * {b}{q} - {a}{q} * {b}{p} AS {name}{c}" for c, p, q in zip(_AXES, "yzx", "zxy", strict=True))


def _norm(name: str) -> str:
    return "sqrt(" + " + ".join(f"{name}{c}::DOUBLE ** 2" for c in _AXES) + ")"


#: DuckDB's ``w``: every order as a measurement with its figures; the differences of vertices are named after both.
_MEASURED = f"""v AS (SELECT o_orderkey AS id, {', '.join(_P)} FROM orders),
d AS (SELECT *, id % 8 AS k, {_diff(1, 0, 'f')}, {_diff(0, 1, 'a')}, {_diff(2, 1, 'h')}, {_diff(3, 1, 'c')}, {_diff(2, 0, 'g')} FROM v),
n AS (SELECT *, sqrt((fx ** 2 + fy ** 2)::DOUBLE) AS flat, {_cross('h', 'c', 'p')}, {_cross('f', 'g', 'q')}, ax * hx + ay * hy + az * hz AS dotted FROM d),
e AS (SELECT *, CASE WHEN k = 7 AND id % 16 > 13 THEN 'wrong number of vertices' WHEN k = 4 AND {_norm('a')} * {_norm('h')} = 0 THEN 'coincident vertices'
    WHEN k = 6 AND {_norm('p')} = 0 THEN 'the plane''s vertices lie on a line' WHEN k = 7 AND {_norm('q')} = 0 THEN 'the vertices lie on a line' END AS error FROM n),
w AS (SELECT id, {_KINDS}[k + 1] AS kind, error, CASE WHEN k IN (1, 2) THEN {_norm('f')} END AS length, CASE WHEN k IN (1, 2) THEN flat END AS horizontal_length,
    {', '.join(f"CASE WHEN k IN (1, 2, 3) THEN f{c}::DOUBLE WHEN k = 6 AND error IS NULL THEN -(ax * px + ay * py + az * pz) * p{c} / {_norm('p')} ** 2 END AS d{c}" for c in _AXES)},
    {', '.join(f"CASE WHEN k = 6 AND error IS NULL THEN {c}0 - (ax * px + ay * py + az * pz) * p{c} / {_norm('p')} ** 2 WHEN k = 7 AND error IS NULL THEN {c}0 + (({_norm('f')} ** 2) * (g{u} * q{t} - g{t} * q{u}) + ({_norm('g')} ** 2) * (q{u} * f{t} - q{t} * f{u})) / (2 * {_norm('q')} ** 2) END AS centre_{c}" for c, u, t in zip(_AXES, 'yzx', 'zxy', strict=True))},
    {', '.join(f"CASE WHEN k = 6 AND error IS NULL THEN p{c} * CASE WHEN pz < 0 THEN -1 ELSE 1 END / {_norm('p')} WHEN k = 7 AND error IS NULL THEN q{c} * CASE WHEN qz < 0 THEN -1 ELSE 1 END / {_norm('q')} END AS normal_{c}" for c in _AXES)},
    CASE WHEN k IN (1, 2, 3) AND flat > 0 THEN CASE WHEN fx < 0 THEN 360 ELSE 0 END + degrees(atan2(fx, fy)) END AS azimuth_deg, CASE WHEN k IN (1, 2, 3) AND flat > 0 THEN fz / flat * 100 END AS slope_pct,
    CASE WHEN error IS NULL THEN k IN (1, 2, 3) AND flat = 0 END AS vertical, CASE WHEN k IN (1, 2, 3) THEN degrees(atan2(fz, flat)) END AS inclination_deg,
    CASE WHEN k = 4 AND error IS NULL THEN degrees(acos(greatest(-1, least(1, dotted / ({_norm('a')} * {_norm('h')}))))) END AS angle_deg,
    CASE WHEN k = 5 THEN abs(fx * gy - fy * gx) / 2 END AS horizontal_area, CASE WHEN k = 5 THEN {_norm('f')} + {_norm('h')} + {_norm('g')} END AS perimeter,
    CASE WHEN k = 6 AND error IS NULL THEN (ax * px + ay * py + az * pz) * CASE WHEN pz < 0 THEN -1 ELSE 1 END / {_norm('p')} END AS plane_distance,
    CASE WHEN k = 7 AND error IS NULL THEN {_norm('f')} * {_norm('g')} * {_norm('h')} / (2 * {_norm('q')}) END AS radius, {_norm('q')} / 2 AS in_space FROM e)"""
_FIGURES = "length horizontal_length dx dy dz azimuth_deg slope_pct inclination_deg angle_deg horizontal_area perimeter plane_distance radius centre_x centre_y centre_z normal_x normal_y normal_z".split()
ORACLES = {
    "measure_rows": f"WITH {_MEASURED} SELECT id, kind, error, vertical, {', '.join(f'round({c}, 5) AS {c}' for c in _FIGURES)}, round(radius * 2, 5) AS diameter, round(radius * 2 * pi(), 5) AS circumference FROM w",
    "import_counts": f"WITH {_MEASURED} SELECT count(*) FILTER (error IS NULL) AS imported, count(*) FILTER (error IS NOT NULL) AS skipped FROM w",
    "transform_measurements": f"WITH {_MEASURED} SELECT id, error, round(length, 5) AS length, round(angle_deg, 5) AS angle_deg, round(horizontal_area, 5) AS horizontal_area, round(radius, 5) AS radius FROM w",
    "measurement_json": f"WITH {_MEASURED} SELECT id::INT AS id, kind, error, round(length, 5) AS length FROM w",
    "polygon_area": f"WITH {_MEASURED} SELECT id, CASE WHEN in_space > 0 THEN round(in_space, 5) END AS plane_area, CASE WHEN in_space > 0 THEN 0.0::DOUBLE END AS rms, CASE WHEN in_space = 0 THEN 'the vertices lie on a line' END AS error FROM w WHERE kind = 'area'",
    "reassign_ids": """WITH t AS (SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(c_custkey) FROM customer)) AS t)
SELECT o_orderkey AS id FROM orders ANTI JOIN customer ON c_custkey = o_orderkey UNION ALL SELECT t + row_number() OVER (ORDER BY o_orderkey) FROM orders SEMI JOIN customer ON c_custkey = o_orderkey, t""",
    "update_rate_ewma": f"""WITH RECURSIVE {_F}, w AS (SELECT cloud_id, 0::BIGINT AS i, ts_s AS t, 0::DOUBLE AS r FROM f WHERE frame_idx = 0
UNION ALL SELECT w.cloud_id, w.i + 1, f.ts_s, CASE WHEN f.ts_s <= w.t THEN w.r WHEN w.r = 0 THEN 1 / (f.ts_s - w.t) ELSE 0.65 * w.r + 0.35 / (f.ts_s - w.t) END FROM w JOIN f ON f.cloud_id = w.cloud_id AND f.frame_idx = w.i + 1)
SELECT cloud_id, round(arg_max(r, i), 6) AS rate_hz FROM w GROUP BY 1""",
    "asof_nearest_image": f"""WITH {_F}, {_I}, d AS (SELECT f.cloud_id, f.frame_idx, i.frame_idx AS image_idx, abs(f.ts_s - i.ts_s) AS dt, row_number() OVER (PARTITION BY f.cloud_id, f.frame_idx ORDER BY abs(f.ts_s - i.ts_s), i.frame_idx) AS r FROM f JOIN i USING (cloud_id))
SELECT cloud_id, frame_idx, image_idx, round(dt * 1000, 3) AS delta_ms FROM d WHERE r = 1""",
    "proportional_image": f"""WITH {_F}, {_I}, n AS (SELECT cloud_id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT cloud_id, count(*) AS m FROM i GROUP BY 1), x AS (SELECT f.*, round(frame_idx * (m - 1) / (n - 1))::BIGINT AS idx FROM f JOIN n USING (cloud_id) JOIN m USING (cloud_id))
SELECT x.cloud_id, x.frame_idx, x.idx, i.frame_id AS image_id FROM x JOIN i ON i.cloud_id = x.cloud_id AND i.frame_idx = x.idx""",
    "point_offsets": f"WITH {_F} SELECT cloud_id, frame_idx, coalesce(sum(point_count) OVER (PARTITION BY cloud_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS point_offset FROM f",
    "relative_time": f"WITH {_F} SELECT cloud_id, frame_idx, round(ts_s - first_value(ts_s) OVER (PARTITION BY cloud_id ORDER BY frame_idx), 3) AS relative_s FROM f",
    "sliding_frames": f"WITH {_F} SELECT cloud_id, frame_idx, point_count AS single, (sum(point_count) OVER (PARTITION BY cloud_id ORDER BY frame_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))::BIGINT AS \"window\", (sum(point_count) OVER (PARTITION BY cloud_id ORDER BY frame_idx))::BIGINT AS \"all\" FROM f",
    "frame_totals": f"""WITH {_F}, {_I}, {_f("p", "signup")} SELECT cloud_id, count(*) AS frames, round(max(ts_s) - min(ts_s), 3) AS duration_s, sum(point_count)::BIGINT AS points, sum(source_point_count - point_count)::BIGINT AS skipped,
(SELECT count(*) FROM p WHERE p.cloud_id = f.cloud_id) AS poses, (SELECT count(*) FROM i WHERE i.cloud_id = f.cloud_id) AS images, 0 AS time_reversals FROM f GROUP BY 1""",
    "time_reversals": f"WITH {_F}, t AS (SELECT cloud_id, ts_s - source_point_count * 1000 < lag(ts_s - source_point_count * 1000) OVER (PARTITION BY cloud_id ORDER BY frame_idx) AS b FROM f) SELECT cloud_id, count(*) FILTER (b) AS time_reversals FROM t GROUP BY 1",
    "companion_missing": """WITH s AS (SELECT DISTINCT user_id FROM events), h AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT s.user_id::VARCHAR AS cloud_id, string_agg(n, ',' ORDER BY n) AS missing FROM s, (VALUES ('view'), ('click'), ('pose')) r(n) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = s.user_id AND h.event_type = n) GROUP BY 1""",
    "path_length": f"WITH {_PATHS} SELECT id, round(length, 5) AS length, round(horizontal_length, 5) AS horizontal_length FROM s UNION ALL SELECT id, round({_LEG}, 5), round(sqrt((x0-x1)**2 + (y0-y1)**2) + sqrt((x1-x2)**2 + (y1-y2)**2), 5) FROM v WHERE id % 8 = 2 AND id % 16 > 13 UNION ALL SELECT id, NULL, NULL FROM v WHERE id % 8 = 1 AND id % 16 > 13",
    "linear_total": f"WITH {_PATHS} SELECT round(sum(length), 3) AS total_length FROM s",
    "filter_measurements": f"SELECT o_orderkey AS id, ['point','segment','polyline','height','angle','area','point_plane','circle'][o_orderkey % 8 + 1] AS kind FROM orders WHERE {_DEFAULT} = 'default' AND contains(lower(o_orderpriority), 'urgent')",
    "measurement_groups": f"SELECT DISTINCT {_DEFAULT} AS grp FROM orders",
}
