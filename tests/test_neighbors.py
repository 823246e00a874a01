"""Nearest neighbours against brute force: dense spots, copies, far queries, clouds searched one by one."""

import math

import numpy as np
import pytest

from pointweave.operators import neighbors as N
from pointweave.operators import octree

SCHEMA = "id long, x double, y double, z double"


def table(spark, at, ids=None):
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(range(len(at)) if ids is None else ids, at, strict=True)], SCHEMA).repartition(3)


def plain(q, qid, t, tid, k, skip, most=math.inf):
    out = set()
    for i, p in zip(qid, q, strict=True):
        d = np.sqrt((p[0] - t[:, 0]) ** 2 + (p[1] - t[:, 1]) ** 2 + (p[2] - t[:, 2]) ** 2)
        order = np.lexsort((tid, d))
        order = order[tid[order] != i][:k] if skip else order[:k]
        out |= {(int(i), n + 1, int(tid[j]), round(float(d[j]), 9)) for n, j in enumerate(order) if d[j] <= most}
    return out


RNG = np.random.default_rng(0)
CASES = {
    "dense spot": (np.concatenate([RNG.uniform(0, 0.001, (400, 3)), RNG.uniform(0, 200, (150, 3))]), np.concatenate([RNG.uniform(0, 0.001, (30, 3)), RNG.uniform(-100, 400, (40, 3))])),
    "copies": (np.concatenate([np.zeros((300, 3)), np.ones((100, 3)), np.c_[RNG.uniform(0, 3, (80, 2)), np.zeros(80)]]), RNG.normal(size=(40, 3))),
}


@pytest.mark.parametrize("name", CASES)
def test_nearest_equals_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(octree.grow, "__defaults__", (2, None, 32))
    t, q = CASES[name]
    ids = np.arange(len(t)) * 3
    for k, skip, most in ((1, False, 0.3), (4, True, math.inf)):
        own, own_ids = (t, ids) if skip else (q, np.arange(len(q)))
        got = N.nearest(table(spark, own, own_ids), table(spark, t, ids), k, most, skip).collect()
        assert {(r.qid, r.rank, r.tid, round(r.distance, 9)) for r in got} == plain(own, own_ids, t, ids, k, skip, most)


def test_cells_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(octree.grow, "__defaults__", (2, None, 64))
    tree = octree.grow(table(spark, np.concatenate([RNG.uniform(0, 0.001, (3000, 3)), RNG.uniform(0, 200, (500, 3)), np.full((500, 3), 7.0)])))
    sizes = tree.points.groupBy("leaf").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 64 and tree.points.count() == 3502  # copies keep as many ids as a search returns
    with pytest.raises(ValueError):
        octree.search(table(spark, np.zeros((1, 3))), tree, 3)


def test_clouds_one_by_one_and_odd_tables(spark):
    at = RNG.normal(size=(60, 3))
    rows = [(i, *map(float, p), "ab"[i % 2]) for i, p in enumerate(at)] + [(60, 0.0, 0.0, math.nan, "a"), (61, 5.0, 5.0, 5.0, "alone")]
    points = spark.createDataFrame(rows, SCHEMA + ", region string")
    got = {(r.qid, r.rank, r.tid, round(r.distance, 9)) for r in N.nearest(points, points, 2, skip_same_id=True, key="region").collect()}
    expected = set()
    for part in (0, 1):
        ids = np.arange(part, 60, 2)
        expected |= plain(at[ids], ids, at[ids], ids, 2, True)
    assert got == expected
    spacing = {r.region: r.spacing for r in N.region_spacing(points, "region").collect()}
    nearest = {part: np.median([d for _, n, _, d in plain(at[part::2], np.arange(30), at[part::2], np.arange(30), 1, True)]) for part in (0, 1)}
    assert {k: round(v, 6) for k, v in spacing.items()} == {"a": round(nearest[0], 6), "b": round(nearest[1], 6)}
    assert N.nearest(points, points.limit(0)).count() == 0 and N.nearest(points.limit(0), points).count() == 0
    for k in (1, 60, 61):
        with pytest.raises(ValueError):
            N.statistical_outliers(points.where("region != 'alone'"), k, 1.0)
