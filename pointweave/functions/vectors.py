"""Vectors and quaternions as structs of doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def magnitude(v: Column, names: str = "xyz") -> Column:
    return norm(*[v[n] for n in names])


def valid_vector(v: Column) -> Column:
    """The struct where all of x, y, z are finite, else null."""
    return F.when(finite(v["x"], v["y"], v["z"]), v)


def valid_quaternion(q: Column) -> Column:
    """The struct where all of x, y, z, w are finite, else null."""
    return F.when(finite(q["x"], q["y"], q["z"], q["w"]), q)


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scaled(a: Column, k: Column) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def quaternion_angle(p: Column, q: Column) -> Column:
    """The rotation between two quaternions in degrees; null where a norm is 1e-12 or less."""
    n = magnitude(p, "xyzw") * magnitude(q, "xyzw")
    d = F.abs(sum((p[k] * q[k] for k in "yzw"), p["x"] * q["x"])) / n
    return F.when((magnitude(p, "xyzw") <= 1e-12) | (magnitude(q, "xyzw") <= 1e-12), None).otherwise(F.degrees(2 * F.acos(F.least(F.lit(1.0), d))))


def affine(x: Column, y: Column, z: Column, matrix: Sequence[Sequence[float]]) -> tuple[Column, Column, Column]:
    """Coordinates under a 4 x 4 matrix."""
    a, b, c = ((x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3])) for r in matrix[:3])
    return a, b, c
