"""Quantiles by key, and ordered rows in segments, against plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import sequences as S


@pytest.mark.parametrize("sketch", [100, 10_000])
def test_keyed_quantiles_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(S, "SKETCH", sketch)  # a coarse sketch brackets many values
    rng = random.Random(3)
    draws = {"many": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 3)), "one": lambda: 5.0}
    rows = [(k, draw(), rng.choice([None, rng.random()])) for k, draw in draws.items() for _ in range(3000)]
    rows += [(f"n{n}", rng.random(), None) for n in range(1, 25) for _ in range(n)] + [("none", None, None)]
    probabilities = (0.0, 0.005, 0.5, 0.95, 0.99, 1.0)
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {r.k: r for r in S.keyed_quantiles(df, ["k"], {"p": (F.col("x"), probabilities), "q": (F.col("y"), (0.5,))}).collect()}
    for k in {r[0] for r in rows} - {"none"}:
        x = [r[1] for r in rows if r[0] == k]
        y = [r[2] for r in rows if r[0] == k and r[2] is not None]
        assert np.allclose(got[k].p, np.quantile(x, probabilities), rtol=1e-12, atol=1e-12), k
        assert (got[k].q is None and not y) or math.isclose(got[k].q[0], np.median(y), rel_tol=1e-12)
    assert "none" not in got


def rows_of(spark, n=400):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.1, 0.25, -0.05, 3.0])
        rows.append((rng.choice(["a", "b", None]), i * rng.choice([1, 1, 1]), round(t, 3), rng.randint(0, 9), rng.choice(["x", "x", "x", "y", None, ""])))
    return spark.createDataFrame(rows, "cloud_id string, frame_idx long, ts_s double, point_count long, value string")


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_segments_change_nothing(spark):
    from pointweave.operators import frames as R

    df = rows_of(spark)
    for width in (1, 60):
        assert same(S.intervals(df, ["cloud_id"], "frame_idx", "ts_s", width), S.intervals(df, ["cloud_id"], "frame_idx", "ts_s", None))
        assert same(S.longest_runs(df, ["cloud_id"], "frame_idx", "value", width), S.longest_runs(df, ["cloud_id"], "frame_idx", "value", None))
        assert same(R.point_offsets(df, width), R.point_offsets(df, None))
        assert same(R.sliding_points(df, 5, width), R.sliding_points(df, 5, None))
    images = df.where("frame_idx % 3 = 0").select("cloud_id", F.col("frame_idx").alias("idx"), (F.col("ts_s") + 0.02).alias("ts_s"))
    for width in (5.0,):
        assert same(R.asof_nearest(df, images, width=width), R.asof_nearest(df, images, width=None))
    keep, expected = 0.65, {}
    for r in sorted((r for r in df.where("cloud_id is not null").collect()), key=lambda r: r.frame_idx):
        t, rate = expected.get(r.cloud_id, (None, 0.0))
        if t is not None and r.ts_s > t:
            rate = 1 / (r.ts_s - t) if rate == 0 else keep * rate + (1 - keep) / (r.ts_s - t)
        expected[r.cloud_id] = (r.ts_s, rate)
    for width in (3, 1000):
        got = {r.cloud_id: r.rate_hz for r in R.update_rate(df.where("cloud_id is not null"), keep, width).collect()}
        assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, (_, v) in expected.items()) and len(got) == 2
