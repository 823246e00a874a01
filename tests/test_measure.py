import math

import pytest
from pyspark.sql import functions as F

from pointweave.operators import compare as C
from pointweave.operators import fits as G
from pointweave.operators import measure as M
from pointweave.operators import points as O
from pointweave.streaming import live as L


def shape(spark, kind, vertices):
    return spark.createDataFrame([(1, kind, [tuple(map(float, v)) for v in vertices])], f"id int, kind string, vertices {M.VERTICES}")


def test_circle_and_foot_point(spark):
    r = M.measure_rows(shape(spark, "circle", [(3, 0, 1), (0, 3, 1), (-3, 0, 1)])).first()
    assert (r.radius, r.diameter) == pytest.approx((3, 6)) and (r.centre_x, r.centre_y, r.centre_z) == pytest.approx((0, 0, 1)) and r.normal_z == 1
    r = M.measure_rows(shape(spark, "point_plane", [(1, 2, -4), (0, 0, 0), (0, 1, 0), (1, 0, 0)])).first()
    assert r.plane_distance == -4 and (r.centre_x, r.centre_y, r.centre_z) == (1, 2, 0) and (r.dx, r.dy, r.dz) == (0, 0, 4) and r.normal_z == 1
    flat = M.measure_rows(shape(spark, "circle", [(0, 0, 0), (1, 1, 1), (2, 2, 2)])).first()
    assert flat.error == "the vertices lie on a line" and flat.centre_x is None and flat.diameter is None


def test_import_counts(spark):
    rows = shape(spark, "segment", [(0, 0, 0), (1, 0, 0)]).unionByName(shape(spark, "blob", [(0, 0, 0)])).unionByName(shape(spark, "circle", [(0, 0, 0), (math.nan, 0, 0), (1, 0, 0)]))
    assert tuple(M.import_counts(rows).first()) == (1, 2)
    assert tuple(M.import_counts(rows.limit(0)).first()) == (0, 0)


def test_compose_and_invert(spark):
    a, b = O.Placement((1, 2, 3), 90).matrix(), O.Placement((0, 0, 1), 0, 2).matrix()
    p = spark.createDataFrame([(1.0, 0.0, 0.0)], "x double, y double, z double")
    moved = O.transform_points(p, O.compose(a, b))
    for df in (moved, O.transform_points(O.transform_points(p, a), b)):
        assert tuple(df.first()) == pytest.approx((2, 6, 7))
    assert tuple(O.transform_points(moved, O.invert(O.compose(a, b))).first()) == pytest.approx((1, 0, 0))
    with pytest.raises(ValueError):
        O.invert([[0.0] * 4] * 4)


def test_comparison_refuses_too_few_points_and_too_little_overlap(spark):
    def cloud(shift, n=60):
        return spark.createDataFrame([(i, float(i % 8) + shift, float(i // 8), float(i * i % 5)) for i in range(n)], "id long, x double, y double, z double")

    assert C.compare_clouds(cloud(0.0), cloud(0.0, 2), C.CompareOptions(align=False)) is None
    assert C.compare_clouds(cloud(0.0), cloud(0.0), C.CompareOptions(align=False)) is not None
    assert C.compare_clouds(cloud(0.0), cloud(0.0).withColumn("y", F.col("y") * 50), C.CompareOptions(max_distance=1e-6, iterations=2)) is None


def test_region_report(spark):
    p = spark.createDataFrame([("c", float(x), float(y), 2.0) for x in range(6) for y in range(3)], "cloud_id string, x double, y double, z double")
    r = G.region_report(p).first()
    assert r.n == 18 and r.box_length == pytest.approx(5) and r.plane_nz == pytest.approx(1) and r.plane_rms == pytest.approx(0)


def test_falling_frame_id_starts_a_new_map(spark):
    frames = spark.createDataFrame([("c", s, f) for s, f in enumerate([0, 1, 2, 0, 1])], "cloud_id string, seq long, frame_id long")
    assert [r.session for r in L.frame_sessions(frames).orderBy("seq").collect()] == [0, 0, 0, 1, 1]
    points = frames.select("*", F.lit(0).alias("ordinal"), F.col("seq").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert sorted(r.x for r in L.session_map(points, frames).collect()) == [3.0, 4.0]


def test_ingest_run_again_writes_nothing_twice(spark, tmp_path):
    spark.createDataFrame([("c", i, b"x" if i % 3 else None) for i in range(9)], "cloud_id string, frame_id long, data binary").write.parquet(f"{tmp_path}/in")
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    for attempt in range(2):  # a lost checkpoint runs batch 0 again
        frames = spark.readStream.schema("cloud_id string, frame_id long, data binary").parquet(f"{tmp_path}/in")
        L.ingest(frames, lambda b: b.where("data is not null").select("cloud_id", "frame_id", F.lit(1.0).alias("x")), good, bad, f"{tmp_path}/state{attempt}").awaitTermination()
    assert spark.read.parquet(good).count() == 6 and {r.frame_id for r in spark.read.parquet(bad).collect()} == {0, 3, 6}


def test_areas_with_missing_vertices_and_large_ids(spark):
    big = 2**53 + 1
    square = [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (2.0, 2.0, 1.0), (0.0, 2.0, 1.0)]
    rows = [(big, square), (None, square), (1, [*square[:3], None]), (2, [*square[:3], (None, 1.0, 1.0)]), (3, square[:2]), (4, None)]
    made = spark.createDataFrame(rows, "id long, vertices array<struct<x:double,y:double,z:double>>")
    got = {r.id: (r.plane_area, r.error) for r in M.polygon_area(made).collect()}
    fault = "fewer than three finite vertices"
    assert got == {big: (4.0, None), None: (4.0, None), 1: (None, fault), 2: (None, fault), 3: (None, fault)}
