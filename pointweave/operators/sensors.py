"""Sensor health: figures of each message by role, summaries by metric, counters, frozen runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import array_median, finite, significant
from ..functions.telemetry import payload_signature
from ..functions.vectors import magnitude, minus, valid_quaternion, valid_vector
from ..session import written
from .sequences import keyed_quantiles, longest_runs, with_key_row, with_previous

KEYS = ("bag_id", "topic")
FLAGS = ("invalid", "empty", "malformed", "saturated")


def _features(rows: DataFrame, metrics: dict[str, Column], signature: Column | None = None, **flags: Column) -> DataFrame:
    """One row a message: flags, a signature and a map of metrics (null ones left out by the summary)."""
    named = F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]), F.array(*[v.cast("double") for v in metrics.values()])) if metrics else F.lit(None).cast("map<string,double>")
    return rows.select(*KEYS, "seq", *[F.coalesce(flags.get(f, F.lit(False)), F.lit(False)).alias(f) for f in FLAGS], (F.lit(None) if signature is None else signature).cast("string").alias("signature"), named.alias("metrics"))


def _printed(values: Column, digits: int) -> Column:
    return F.array_join(F.transform(values, lambda x: significant(x, digits).cast("string")), ":")


def imu(rows: DataFrame) -> DataFrame:
    a, w, q = valid_vector(F.col("linear_acceleration")), valid_vector(F.col("angular_velocity")), valid_quaternion(F.col("orientation"))
    good = a.isNotNull() & w.isNotNull()
    r = rows.withColumns({"__a": F.when(good, a), "__w": F.when(good, w), "__q": q, "__g": good})
    r = with_previous(r, [*KEYS, "__g"], "seq", {"__pa": "__a", "__pw": "__w"})
    a, w, q = F.col("__a"), F.col("__w"), F.when(F.col("__g"), F.col("__q"))
    return _features(r, {
        "acceleration": magnitude(a), "angular_velocity": magnitude(w), "orientation_norm": magnitude(q, "xyzw"), "orientation_norm_error": F.abs(magnitude(q, "xyzw") - 1),
        "acceleration_step": magnitude(minus(a, F.col("__pa"))), "angular_velocity_step": magnitude(minus(w, F.col("__pw"))),
    }, F.when(F.col("__g"), _printed(F.array(*[v[k] for v in (a, w) for k in "xyz"]), 7)), invalid=~F.col("__g"), saturated=(magnitude(a) > 100) | (magnitude(w) > 35))


def scan(rows: DataFrame, most_values: int | None = None) -> DataFrame:
    """Figures of laser scans; all values are judged, or the first ``most_values`` (4,096 to judge no more than a preview)."""
    every = F.coalesce("ranges", F.array().cast("array<double>"))
    seen = every if most_values is None else F.slice(every, 1, most_values)
    good = F.filter(seen, lambda x: finite(x))
    low, high = F.coalesce("range_min", F.lit(0.0)), F.when(F.coalesce("range_max", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("range_max"))
    bad = F.size(seen) - F.size(F.filter(good, lambda x: x.between(low, high)))
    some = F.size(every) > 0
    head = F.concat(F.slice(good, 1, 16), F.slice(good, F.greatest(F.lit(1), F.size(good) - 15), 16))
    return _features(rows, {"points": F.when(some, F.size(every)), "invalid_pct": F.when(some, bad / F.size(seen) * 100)}, F.when(some, F.concat_ws(":", F.size(every), _printed(head, 5))), empty=F.size(good) == 0)


def pointcloud(rows: DataFrame) -> DataFrame:
    w, h, step, row = (F.coalesce(c, F.lit(0)) for c in ("width", "height", "point_step", "row_step"))
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    least = F.when((row != 0) & (h != 0), row * h).otherwise(w * h * step)
    return _features(rows, {"points": w * h}, payload_signature(F.col("data")), empty=(w * h <= 0) | (size <= 0), malformed=(step <= 0) | ((least > 0) & (size < least)))


def livox(rows: DataFrame, most_points: int | None = None) -> DataFrame:
    """Figures of point packets; all points are judged, or the first ``most_points`` (2,048 to judge no more than a preview)."""
    points = F.coalesce("points", F.array().cast(rows.schema["points"].dataType))
    declared, n = F.coalesce("point_num", F.lit(0)), F.size(points)
    some = (declared > 0) & (n > 0)
    seen = points if most_points is None else F.slice(points, 1, most_points)
    good = F.filter(seen, lambda p: finite(p["x"], p["y"], p["z"]))
    ends = F.concat(F.slice(points, 1, 4), F.slice(points, F.greatest(F.lit(1), n - 3), 4))
    parts = F.flatten(F.transform(F.filter(ends, lambda p: finite(p["x"], p["y"], p["z"])), lambda p: F.array(p["x"], p["y"], p["z"])))
    return _features(rows, {
        "points": F.when(declared != 0, declared).otherwise(n), "range": F.when(some, array_median(F.transform(good, lambda p: magnitude(p)))),
        "reflectivity": F.when(some, array_median(F.transform(good, lambda p: p["reflectivity"]))), "timebase": F.when(some, F.col("timebase")), "invalid_points": F.when(some, F.size(seen) - F.size(good)),
    }, F.when(some, F.concat_ws(":", declared, _printed(parts, 4))), empty=~some, malformed=some & (declared != n), invalid=some & (F.size(good) < F.size(seen)))


def image(rows: DataFrame) -> DataFrame:
    w, h, step = (F.coalesce(c, F.lit(0)) for c in ("width", "height", "step"))
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    return _features(rows, {"pixels": w * h, "payload_bytes": size}, payload_signature(F.col("data")), empty=size <= 0, malformed=(step > 0) & (h > 0) & (size < step * h))


def odometry(rows: DataFrame) -> DataFrame:
    p = valid_vector(F.col("pose")["position"])
    r = rows.withColumns({"__p": p, "__g": p.isNotNull()})
    r = with_previous(r, [*KEYS, "__g"], "seq", {"__before": "__p"})
    return _features(r, {"position_step": magnitude(minus(F.col("__p"), F.col("__before")))}, F.when(F.col("__g"), _printed(F.array(*[F.col("__p")[k] for k in "xyz"]), 6)), invalid=~F.col("__g"))


def joint_state(rows: DataFrame) -> DataFrame:
    sizes = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("name", "position", "velocity")}
    odd = F.exists(F.coalesce("position", F.array().cast("array<double>")), lambda x: ~finite(x)) | F.exists(F.coalesce("velocity", F.array().cast("array<double>")), lambda x: ~finite(x))
    short = reduce(lambda a, b: a | b, [(sizes[c] > 0) & (sizes[c] != sizes["name"]) for c in ("position", "velocity")])
    return _features(rows, {"joints": sizes["name"]}, F.when(sizes["position"] > 0, _printed(F.col("position"), 7)), invalid=odd, malformed=short)


def gnss(rows: DataFrame) -> DataFrame:
    good = finite(F.col("latitude"), F.col("longitude"), F.col("altitude"))
    return _features(rows, {"no_fix": (F.coalesce("status", F.lit(-1)) < 0).cast("int"), "max_covariance": F.array_max(F.filter("position_covariance", lambda x: finite(x)))}, invalid=~good)


def battery(rows: DataFrame) -> DataFrame:
    return _features(rows, {c: F.col(c) for c in ("voltage", "current", "percentage", "temperature")}, invalid=~(finite(F.col("voltage")) & (F.col("voltage") > 0)))


ROLES = {"imu": imu, "scan": scan, "pointcloud": pointcloud, "livox": livox, "image": image, "odometry": odometry, "joint_state": joint_state, "gnss": gnss, "battery": battery}


def scalar_summary(values: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, ``metric, value`` to samples, invalid, range, mean, median, p95 and MAD by metric; nulls don't count."""
    keys = [*keys, "metric"]
    good = F.when(finite(F.col("value")), F.col("value")).alias("good")
    v = written(values.where(F.col("value").isNotNull()).select(*keys, good))  # read five times
    first = v.groupBy(*keys).agg(F.count("good").alias("samples"), F.count_if(F.col("good").isNull()).alias("invalid"), F.min("good").alias("min"), F.max("good").alias("max"), F.avg("good").alias("mean"))
    p = keyed_quantiles(v, keys, {"p": (F.col("good"), (0.5, 0.95))}).select(*keys, F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"))
    p = written(p)  # a row for each key
    mad = keyed_quantiles(with_key_row(v, p, keys), keys, {"mad": (F.abs(F.col("good") - F.col("median")), (0.5,))}).select(*keys, F.col("mad")[0].alias("mad"))
    return first.join(p, keys, "left").join(mad, keys, "left")


def long_metrics(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return features.select(*keys, "seq", F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull())


def counters(features: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples, faults and frozen runs of each topic."""
    out = features.groupBy(*keys).agg(F.count("*").alias("samples"), *[F.count_if(f).alias(f) for f in FLAGS])
    runs = longest_runs(features, list(keys), "seq", "signature")
    return out.join(runs, list(keys), "left").fillna(0, ["repeated_samples", "max_repeat_run"])


def hardware_faults(diagnostics: DataFrame) -> DataFrame:
    """Entries of level 1 and up, counted by name, level and message."""
    return diagnostics.select("bag_id", F.explode("status").alias("s")).where(F.col("s.level") >= 1).groupBy("bag_id", "s.name", "s.level", "s.message").agg(F.count("*").alias("n"))
