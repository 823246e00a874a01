import math

import pytest
from pyspark.sql import functions as F

from pointweave.operators import compare as C
from pointweave.operators import fits as G
from pointweave.operators import neighbors as N
from pointweave.operators import points as O
from pointweave.operators import regions as Q
from pointweave.operators import sequences as S


def cloud(spark, rows):
    return spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(rows)], "cloud_id string, ordinal long, x double, y double, z double")


def test_clean_and_invert(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1), (math.nan, 0, 0), (2, math.inf, 0)])
    box = O.Box((0.5, 0.5, 0.5), (2, 2, 2))
    assert O.clean_points(p).count() == 2
    assert O.select_box(p, box).count() + O.select_box(p, box.invert()).count() == 2


def test_polygon_boundary_is_inside_and_faults(spark):
    square = O.Polygon(((0, 0), (2, 0), (2, 2), (0, 2)))
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (3, 1, 0), (2, 2, 0)])
    assert sorted(r.ordinal for r in O.select_polygon(p, square).collect()) == [0, 1, 2, 4]
    assert O.polygon_fault(((0, 0), (2, 2), (2, 0), (0, 3))) == "edges cross"
    with pytest.raises(ValueError):
        O.Polygon(((0, 0), (1, 1)))


def test_profile(spark):
    p = cloud(spark, [(0, 0, 0), (0.5, 0.1, 1), (1, -0.1, 2), (1.5, 0, 3), (2, 0, 4), (1, 2, 99)])
    rows = sorted(G.elevation_profile(p, ((0, 0), (2, 0)), 0.4, 1.0).collect(), key=lambda r: r.bin)
    assert [r.n for r in rows] == [2, 3] and rows[0].mean_z == 0.5 and rows[1].max_z == 4


def test_volume(spark):
    boundary = O.Polygon(((0, 0), (2, 0), (2, 2), (0, 2)))
    centres = [(0.5, 0.5), (1.5, 0.5), (0.5, 1.5), (1.5, 1.5)]
    r = G.grid_volume(cloud(spark, [(*c, z) for c, z in zip(centres, (2, -1, 2, -1), strict=True)]), boundary, 0.0, 1.0).first()
    assert (r.occupied_cells, r.possible_cells, r.above, r.below, r.net) == (4, 4, 4, 2, 2)


def test_plane_and_line(spark):
    grid = [(i / 10, j / 10, 0) for i in range(10) for j in range(10)]
    r = G.plane_fit(cloud(spark, grid)).first()
    assert abs(r.nz - 1) < 1e-9 and abs(r.d) < 1e-9 and r.rms < 1e-9
    assert G.plane_fit(cloud(spark, [(i, i, i) for i in range(5)])).count() == 0


def test_outlier(spark):
    grid = [(i / 10, j / 10, 0) for i in range(10) for j in range(10)] + [(100, 100, 100)]
    p = cloud(spark, grid).withColumnRenamed("ordinal", "id")
    out = N.statistical_outliers(p, 8, 1.0)
    flagged = {r.id for r in out.where("outlier").collect()}
    assert 100 in flagged and out.count() - len(flagged) >= 90


def test_dominant_plane_rejects_curve(spark):
    curve = cloud(spark, [(t / 200, (t / 200) ** 2, (t / 200) ** 3) for t in range(200)]).withColumnRenamed("ordinal", "id")
    assert C.dominant_plane(curve, 1e-8, 200) is None


def test_icp_known_motion(spark):
    sheet = [(i * 0.25, j * 0.3, 0.05 * i + 0.1 * math.sin(j)) for i in range(16) for j in range(9)]
    a, s = math.radians(5), (0.24, -0.17, 0.08)
    moved = [(x * math.cos(a) - y * math.sin(a) + s[0], x * math.sin(a) + y * math.cos(a) + s[1], z + s[2]) for x, y, z in sheet]
    ref, mov = (cloud(spark, r).withColumnRenamed("ordinal", "id") for r in (sheet, moved))
    _, stats, _ = C.compare_clouds(ref, mov, C.CompareOptions(max_distance=0.35, iterations=25))
    assert stats.first().rmse < 0.05


def test_distance_boundary(spark):
    d = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,)], "distance double")
    r = N.distance_stats(d, 0.2).first()
    assert abs(r.mean - 0.15) < 1e-12 and abs(r.p95 - 0.285) < 1e-12 and r.n_over == 1


def test_histogram_sums_and_constant(spark):
    p = cloud(spark, [(0, 0, z) for z in range(7)])
    assert O.height_histogram(p, 3).agg(F.sum("n")).first()[0] == 7
    assert [r.n for r in O.height_histogram(cloud(spark, [(0, 0, 1)] * 4), 2).orderBy("bin").collect()] == [4, 0]


def test_bucketed_previous_equals_plain(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 101).alias("v"))
    a, b = (S.with_previous(df, ["k"], "id", {"p": "v"}, n).orderBy("id").collect() for n in (None, 17))
    assert a == b


def test_exact_quantiles(spark):
    r = S.exact_quantiles(spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,)], "v double"), "v", [0.95]).first()
    assert abs(r.v - 0.285) < 1e-12


def test_dense_position_keeps_every_row(spark):
    wide = spark.range(0, 400_000, 1, 16).select((F.col("id") * 7919 % 400_009).alias("v"), F.repeat(F.col("id").cast("string"), 20).alias("wide"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = S.dense_position(wide, ["v"])
        ordered = out.select("v", "position").orderBy("position").toPandas()
        assert ordered.position.tolist() == list(range(400_000)) and ordered.v.is_monotonic_increasing
        assert S.stride_sample(wide, ["v"], 1000).count() == 1000
        assert S.dense_position(wide.limit(0), ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_crossing_polygons_agree_with_single_form(spark):
    shapes = {1: [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)], 2: [(0, 0), (4, 4), (4, 0), (0, 3)], 3: [(0, 0), (6, 0), (6, 3), (3, 0), (0, 3)], 4: [(0, 0), (1, 0), (0, 1)]}
    rows = [(i, k, len(v), *map(float, (*v[k], *v[(k + 1) % len(v)]))) for i, v in shapes.items() for k in range(len(v))]
    edges = spark.createDataFrame(rows, "polygon_id int, nth int, n int, ax double, ay double, bx double, by double")
    assert {r.polygon_id for r in Q.crossing_polygons(edges).collect()} == {i for i, v in shapes.items() if O.polygon_fault(v) == "edges cross"} == {2, 3}


def test_region_box_is_centred_on_the_mean(spark):
    p = spark.createDataFrame([("c", *map(float, v)) for v in ((0, 0, 0), (1, 0, 0), (2, 0, 0), (10, 1, 0))], "cloud_id string, x double, y double, z double")
    r = G.oriented_box_region(p).first()
    assert (r.cx, r.cy) == (3.25, 0.25) and r.length > r.width


def test_plane_fit_keeps_large_keys(spark):
    big = 2**53 + 1
    p = spark.createDataFrame([(k, float(x), float(y), 1.0) for k in (None, big) for x in range(3) for y in range(3)], "cloud_id long, x double, y double, z double")
    assert {r.cloud_id for r in G.plane_fit(p).collect()} <= {None, big}
    assert big in {r.cloud_id for r in G.plane_fit(p).collect()}


def test_neighbours_with_a_far_point(spark):
    rows = [(i, float(i % 20), float(i // 20), 0.0) for i in range(400)] + [(999, 1e5, 1e5, 0.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {r.qid: (r.tid, r.distance) for r in N.nearest(p.where("id in (0, 399, 999)"), p, skip_same_id=True).collect()}
    assert got[0] == (1, 1.0) and got[399] == (379, 1.0) and got[999][0] == 399


def test_rows_of_one_cloud_spread_over_tasks(spark):
    points = spark.range(2000, numPartitions=4).selectExpr("'c' AS cloud_id", "id AS ordinal", "cast(id as double) AS x", "0D AS y", "1D AS z")
    placements = spark.createDataFrame([("c", 1.0, 0.0, 0.0, 0.0, 2.0), ("d", 0.0, 0.0, 0.0, 0.0, 1.0)], "cloud_id string, tx double, ty double, tz double, turn double, scale double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        placed = O.place_by_table(points, placements)
        assert placed.agg(F.count("*"), F.sum("x")).first()[:] == (2000, 2.0 * 1999 * 1000 + 2000)
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
        met = S.with_key_row(points.unionByName(points.limit(1).withColumn("cloud_id", F.lit("none"))), placements, ["cloud_id"])
        assert met.count() == 2000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
