"""Measurements over vertex arrays: eight kinds, computed for whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.vectors import affine, cross, dot, magnitude, minus, scaled, vec

#: Kind and its least and greatest number of vertices (fixed values).
KINDS = {"point": (1, 1), "segment": (2, 2), "polyline": (2, None), "height": (2, 2), "angle": (3, 3), "area": (3, None), "point_plane": (4, 4), "circle": (3, 3)}
DEFAULT_GROUP = "default"
VERTICES = "array<struct<x:double,y:double,z:double>>"
_TINY = 1e-12


def _v(i: int) -> Column:
    return F.get("vertices", F.lit(i))


def _last() -> Column:
    return F.get("vertices", F.size("vertices") - 1)


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def path_length(vertices: Column, closed: bool = False, flat: bool = False) -> Column:
    """The length of a path, of a closed one with the way back, or of its horizontal projection."""
    ends = F.slice(vertices, 2, F.greatest(F.lit(0), F.size(vertices) - 1))
    if closed:
        ends = F.concat(ends, F.slice(vertices, 1, 1))
    legs = F.zip_with(F.slice(vertices, 1, F.size(ends)), ends, lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (F.lit(0.0) if flat else (a["z"] - b["z"]) ** 2)))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def shoelace(vertices: Column) -> Column:
    """The horizontal area of a polygon."""
    ends = F.concat(F.slice(vertices, 2, F.greatest(F.lit(0), F.size(vertices) - 1)), F.slice(vertices, 1, 1))
    return F.abs(F.aggregate(F.zip_with(vertices, ends, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda a, x: a + x)) / 2


def vertex_angle() -> Column:
    a, b = minus(_v(0), _v(1)), minus(_v(2), _v(1))
    n = magnitude(a) * magnitude(b)
    return F.when(n > _TINY, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))))


def _upwards(n: Column) -> Column:
    return scaled(n, F.when(n["z"] < 0, -1.0).otherwise(1.0) / magnitude(n))


def point_plane_distance() -> Column:
    """The signed distance of vertex 0 to the plane through vertices 1 to 3."""
    n = cross(minus(_v(2), _v(1)), minus(_v(3), _v(1)))
    return F.when(magnitude(n) > _TINY, dot(_upwards(n), minus(_v(0), _v(1))))


def circle_radius() -> Column:
    a, b = minus(_v(1), _v(0)), minus(_v(2), _v(0))
    n = magnitude(cross(a, b))
    return F.when(2 * n * n > _TINY, magnitude(a) * magnitude(b) * magnitude(minus(a, b)) / (2 * n))


def _spanned(rows: DataFrame) -> DataFrame:
    """Adds the normal and the centre of circles and of planes under points, in steps of plain numbers that stay small.

    Sides a and b lead from the first vertex of the circle or plane to the next two, and n lies across them.
    """
    plane, circle = _kind("point_plane"), _kind("circle")
    first = {c: F.when(plane, _v(1)[c]).when(circle, _v(0)[c]) for c in "xyz"}
    to = {"a": (2, 1), "b": (3, 2)}
    rows = rows.withColumns({f"__{s}{c}": F.when(plane, _v(p)[c]).when(circle, _v(q)[c]) - first[c] for s, (p, q) in to.items() for c in "xyz"})

    def across(s: str, t: str) -> dict[str, Column]:
        return {c: F.col(f"__{s}{u}") * F.col(f"__{t}{v}") - F.col(f"__{s}{v}") * F.col(f"__{t}{u}") for c, u, v in zip("xyz", "yzx", "zxy", strict=True)}

    def square(s: str) -> Column:
        return sum((F.col(f"__{s}{c}") ** 2 for c in "yz"), F.col(f"__{s}x") ** 2)

    rows = rows.withColumns({f"__n{c}": v for c, v in across("a", "b").items()}).withColumns({"__nn": square("n"), "__aa": square("a"), "__bb": square("b")})
    up = F.when(F.col("__nz") < 0, -1.0).otherwise(1.0) / F.sqrt("__nn")
    rows = rows.withColumns({f"normal_{c}": F.when(F.col("__nn") > 0, F.col(f"__n{c}") * up) for c in "xyz"})
    height = sum((F.col(f"normal_{c}") * (_v(0)[c] - _v(1)[c]) for c in "yz"), F.col("normal_x") * (_v(0)["x"] - _v(1)["x"]))
    rows = rows.withColumn("plane_distance", F.when(plane & (F.sqrt("__nn") > _TINY), height))
    bn, na = across("b", "n"), across("n", "a")
    off = {c: F.when(2 * F.col("__nn") > _TINY, (F.col("__aa") * bn[c] + F.col("__bb") * na[c]) / (2 * F.col("__nn"))) for c in "xyz"}
    rows = rows.withColumns({f"__o{c}": F.when(circle, off[c]).otherwise(-F.col("plane_distance") * F.col(f"normal_{c}")) for c in "xyz"})
    rows = rows.withColumns({"radius": F.when(circle, F.sqrt(square("o"))), **{f"centre_{c}": _v(0)[c] + F.col(f"__o{c}") for c in "xyz"}})
    return rows.drop(*[f"__{s}{c}" for s in "abno" for c in "xyz"], "__nn", "__aa", "__bb")


def measure_rows(rows: DataFrame) -> DataFrame:
    """Adds every figure that a row's kind has, and ``error`` where it can't be measured (figures are then null).

    ``centre`` is that of a circle, or the foot of a point on its plane, to which ``dx, dy, dz`` then lead; normals point upwards.
    """
    n = F.coalesce(F.size("vertices"), F.lit(0))
    plane, circle = _kind("point_plane"), _kind("circle")
    fault = F.when(~_kind(*KINDS), "unknown kind")
    for name, (low, high) in KINDS.items():
        fault = fault.when(_kind(name) & ((n < low) | (F.lit(False) if high is None else n > high)), "wrong number of vertices")
    fault = fault.when(F.exists("vertices", lambda p: ~finite(p["x"], p["y"], p["z"])), "a vertex is not finite")
    fault = fault.when(_kind("angle") & vertex_angle().isNull(), "coincident vertices").when(plane & F.col("plane_distance").isNull(), "the plane's vertices lie on a line")
    fault = fault.when(circle & F.col("radius").isNull(), "the vertices lie on a line")
    d = minus(_last(), _v(0))
    flat = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
    two = _kind("segment", "polyline", "height")
    out = _spanned(rows).withColumn("error", fault)
    ok = F.col("error").isNull()
    figures = {
        "length": F.when(_kind("segment", "polyline"), path_length(F.col("vertices"))), "horizontal_length": F.when(_kind("segment", "polyline"), path_length(F.col("vertices"), flat=True)),
        **{f"d{c}": F.when(two, d[c]).when(plane, F.col(f"centre_{c}") - _v(0)[c]) for c in "xyz"},
        "azimuth_deg": F.when(two & (flat > _TINY), F.pmod(F.degrees(F.atan2(d["x"], d["y"])), F.lit(360.0))), "slope_pct": F.when(two & (flat > _TINY), d["z"] / flat * 100), "vertical": two & (flat <= _TINY),
        "inclination_deg": F.when(two, F.degrees(F.atan2(d["z"], flat))), "angle_deg": F.when(_kind("angle"), vertex_angle()),
        "horizontal_area": F.when(_kind("area"), shoelace(F.col("vertices"))), "perimeter": F.when(_kind("area"), path_length(F.col("vertices"), closed=True)),
        "diameter": F.col("radius") * 2, "circumference": F.col("radius") * 2 * np.pi,
        **{c: F.col(c) for c in ("plane_distance", "radius", *[f"{k}_{x}" for k in ("centre", "normal") for x in "xyz"])},
    }
    return out.withColumns({k: F.when(ok, v) for k, v in figures.items()})


def polygon_area(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, plane_area, rms, nx, ny, nz, error`` of polygons in space: area in the plane that fits their vertices best."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a missing vertex or coordinate is one that is not finite
            found = [_plane_area(np.array([[(v or {}).get(c) for c in "xyz"] for v in own.as_py()], float).reshape(-1, 3)) for own in b.column(1)]
            made = [pa.array([r[i] for r in found], pa.string() if n == "error" else pa.float64()) for i, n in enumerate(names)]
            yield pa.record_batch([b.column(0), *made], names=[id_col, *names])

    names = ["plane_area", "rms", "nx", "ny", "nz", "error"]
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.where(F.col("vertices").isNotNull()).select(id_col, "vertices").mapInArrow(solve, f"`{id_col}` {kind}, plane_area double, rms double, nx double, ny double, nz double, error string")


def _plane_area(p: np.ndarray) -> tuple:
    from .points import polygon_fault

    bad = (None,) * 5
    if len(p) < 3 or not np.isfinite(p).all():
        return (*bad, "fewer than three finite vertices")
    centred = p - p.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    if values[1] <= _TINY:
        return (*bad, "the vertices lie on a line")
    normal = vectors[:, 0] * (-1.0 if vectors[2, 0] < 0 else 1.0)
    flat = centred @ vectors[:, 1:]
    if fault := polygon_fault([tuple(map(float, v)) for v in flat]):
        return (*bad, fault)
    nxt = np.roll(flat, -1, axis=0)
    area = abs((flat[:, 0] * nxt[:, 1] - nxt[:, 0] * flat[:, 1]).sum()) / 2
    return (area, float(np.sqrt(((centred @ normal) ** 2).mean())), *map(float, normal), None)


def transform_measurements(rows: DataFrame, matrix) -> DataFrame:
    """Vertices under a matrix and all figures computed anew; labels stay."""
    moved = F.transform("vertices", lambda p: vec(*affine(p["x"], p["y"], p["z"], matrix)))
    return measure_rows(rows.withColumn("vertices", moved))


def filter_measurements(rows: DataFrame, kind: str | None = None, group: str | None = None, text: str = "") -> DataFrame:
    """By kind, by group (an empty one is the default) and by a part of name, group, note or kind in any case."""
    own = F.coalesce(F.nullif(F.col("grp"), F.lit("")), F.lit(DEFAULT_GROUP))
    out = rows.where(F.col("kind") == kind) if kind else rows
    out = out.where(own == group) if group else out
    if text:
        out = out.where(F.lower(F.concat_ws("\n", "name", own, "note", "kind")).contains(text.lower()))
    return out


def linear_total(measured: DataFrame) -> DataFrame:
    return measured.agg(F.sum(F.when(_kind("segment", "polyline"), F.col("length"))).alias("total_length"))


def groups(rows: DataFrame) -> DataFrame:
    """Distinct groups in order of their lower-case names."""
    return rows.select(F.coalesce(F.nullif(F.col("grp"), F.lit("")), F.lit(DEFAULT_GROUP)).alias("grp")).distinct().orderBy(F.lower("grp"), "grp")


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Measurements from JSON: defaults for what is missing, unusable vertices dropped, unknown kinds left out."""
    schema = "id int, kind string, name string, grp string, note string, color string, visible boolean, created_at string, vertices " + VERTICES
    m = texts.select(F.from_json(column, schema).alias("m")).select("m.*")
    good = F.filter(F.coalesce("vertices", F.array().cast(VERTICES)), lambda p: finite(p["x"], p["y"], p["z"]))
    return measure_rows(m.where(_kind(*KINDS)).withColumns({"vertices": good, "visible": F.coalesce("visible", F.lit(True)), "name": F.coalesce("name", F.lit(""))}))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("json"))


def import_counts(rows: DataFrame) -> DataFrame:
    """``imported, skipped``: rows that can be measured, and those of an unknown kind or unusable vertices."""
    bad = measure_rows(rows).select(F.col("error").isNotNull().alias("bad"))
    return bad.agg(F.count_if(~F.col("bad")).alias("imported"), F.count_if("bad").alias("skipped"))


def reassign_ids(imported: DataFrame, existing: DataFrame) -> DataFrame:
    """Imported rows; ids that are taken, or taken twice, go on after the greatest one, in order."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("t")).unionByName(imported.agg(F.coalesce(F.max("id"), F.lit(0)).alias("t"))).agg(F.max("t")).first()[0]
    rows = imported.withColumn("__nth", F.row_number().over(Window.partitionBy("id").orderBy("kind", "name")))
    taken = rows.join(existing.select("id").distinct().withColumn("__taken", F.lit(True)), "id", "left").withColumn("__new", F.col("__taken").isNotNull() | (F.col("__nth") > 1))
    from .sequences import dense_position

    fresh = dense_position(taken.where("__new"), ["id", "__nth"]).withColumn("id", (F.col("position") + top + 1).cast(imported.schema["id"].dataType)).drop("position")
    return fresh.unionByName(taken.where("not __new")).drop("__nth", "__taken", "__new")
