"""Frame sequences: offsets, sliding windows, as-of images, totals, update rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import BUCKET_ROWS, last_and_next, moving_sums, running_sums, time_reversals, with_previous


def point_offsets(frames: DataFrame, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Adds the number of points in all earlier frames."""
    out = running_sums(frames, ["cloud_id"], "frame_idx", {"point_offset": F.col("point_count")}, bucket_rows)
    return out.withColumn("point_offset", F.col("point_offset") - F.coalesce("point_count", F.lit(0)))


def relative_time(frames: DataFrame) -> DataFrame:
    """Adds the time since the first frame."""
    first = frames.groupBy("cloud_id").agg(F.min_by("ts_s", "frame_idx").alias("__first"))
    return frames.join(first, "cloud_id").withColumn("relative_s", F.col("ts_s") - F.col("__first")).drop("__first")


def sliding_points(frames: DataFrame, last: int = 150, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Points shown at each frame: its own, the last so many frames', and all so far."""
    out = frames.withColumn("single", F.col("point_count"))
    out = moving_sums(out, ["cloud_id"], "frame_idx", {"window": F.col("point_count")}, last, bucket_rows)
    return running_sums(out, ["cloud_id"], "frame_idx", {"all": F.col("point_count")}, bucket_rows)


def frames_in_window(points: DataFrame, frame_idx: int, last: int | None = 150) -> DataFrame:
    """The points of the last so many frames up to one; of all of them with ``last`` None."""
    low = 0 if last is None else frame_idx - last + 1
    return points.where(F.col("frame_idx").between(low, frame_idx))


def frame_totals(frames: DataFrame, poses: DataFrame, images: DataFrame) -> DataFrame:
    """Frames, duration, points, skipped points, poses, images and time reversals of each session."""
    out = frames.groupBy("cloud_id").agg(F.count("*").alias("frames"), F.greatest(F.lit(0.0), F.max_by("ts_s", "frame_idx") - F.min_by("ts_s", "frame_idx")).alias("duration_s"), F.sum("point_count").alias("points"), F.sum(F.col("source_point_count") - F.col("point_count")).alias("skipped"))
    for name, df in (("poses", poses), ("images", images)):
        out = out.join(df.groupBy("cloud_id").agg(F.count("*").alias(name)), "cloud_id", "left")
    return out.join(time_reversals(frames, ["cloud_id"], "frame_idx", "ts_s"), "cloud_id", "left").fillna(0, ["poses", "images", "time_reversals"])


def asof_nearest(frames: DataFrame, images: DataFrame, keys: Sequence[str] = ("cloud_id",), width: float | None = 3600.0) -> DataFrame:
    """Each frame with the image of least time difference, ties to the lower index; no cross join.

    Times are searched in segments of ``width`` seconds, so that one long session spreads over tasks.
    """
    keys = list(keys)
    first = images.groupBy(*keys, "ts_s").agg(F.min("idx").alias("idx"))
    empty = F.lit(None).cast(first.schema["idx"].dataType)
    both = frames.select(*keys, "ts_s", "frame_idx", empty.alias("idx")).unionByName(first.select(*keys, "ts_s", F.lit(None).cast(frames.schema["frame_idx"].dataType).alias("frame_idx"), "idx"))
    marked = last_and_next(both, keys, "ts_s", F.when(F.col("idx").isNotNull(), F.struct("ts_s", "idx")), width)
    options = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("ts_s") - F.col(f"{c}.ts_s")).alias("dt"), F.col(f"{c}.idx").alias("idx"))) for c in ("before", "after")]))
    best = F.array_min(options)
    return marked.where(F.col("frame_idx").isNotNull()).select(*keys, "frame_idx", best["idx"].alias("image_idx"), (best["dt"] * 1000).alias("delta_ms"))


def proportional_image(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames matched with images by position, where images have no times."""
    n = frames.groupBy("cloud_id").agg(F.count("*").alias("n")).join(images.groupBy("cloud_id").agg(F.count("*").alias("m")), "cloud_id")
    idx = F.when(F.col("n") > 1, F.round(F.col("frame_idx") * (F.col("m") - 1) / (F.col("n") - 1))).otherwise(0).cast("long")
    return frames.join(n, "cloud_id").withColumn("idx", idx).join(images.select("cloud_id", "idx", F.col("id").alias("image_id")), ["cloud_id", "idx"]).drop("n", "m")


def companion_missing(sessions: DataFrame, present: DataFrame, required: Sequence[str]) -> DataFrame:
    """The required companion files that each session lacks: ``sessions(cloud_id)``, ``present(cloud_id, name)``."""
    wanted = sessions.select("cloud_id", F.explode(F.array(*map(F.lit, required))).alias("name"))
    return wanted.join(present.select("cloud_id", "name"), ["cloud_id", "name"], "left_anti").groupBy("cloud_id").agg(F.array_sort(F.collect_list("name")).alias("missing"))


def update_rate(frames: DataFrame, keep: float = 0.65, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The smoothed update rate of each session: ``keep`` of the old rate and the rest of the newest one; 0 without a step in time.

    Each step forward in time maps a rate r to ``keep * r + (1 - keep) / dt``.  Steps of a segment are one such map, a product of
    decays and a weighted sum, and the maps of a session's segments compose in order; the first rate is that of the first step.
    """
    dt = F.col("ts_s") - F.col("__t")
    steps = with_previous(frames.select("cloud_id", "frame_idx", "ts_s"), ["cloud_id"], "frame_idx", {"__t": "ts_s"}, bucket_rows)
    steps = steps.where(dt > 0).select("cloud_id", "frame_idx", (1 / dt).alias("rate"), F.floor(F.col("frame_idx") / bucket_rows).alias("bucket"))
    later = F.row_number().over(Window.partitionBy("cloud_id", "bucket").orderBy(F.desc("frame_idx"))) - 1
    maps = steps.withColumn("w", F.pow(F.lit(keep), later)).groupBy("cloud_id", "bucket").agg(
        F.pow(F.lit(keep), F.count("*")).alias("decay"), ((1 - keep) * F.sum(F.col("rate") * F.col("w"))).alias("add"), F.min_by("rate", "frame_idx").alias("first"),
    )
    # a row for each segment of a session
    composed = maps.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "decay", "add", "first"))).alias("m"))
    rate = F.aggregate("m", F.col("m")[0]["first"], lambda r, x: x["decay"] * r + x["add"])
    return frames.select("cloud_id").distinct().join(composed.select("cloud_id", rate.alias("rate_hz")), "cloud_id", "left").fillna(0.0, ["rate_hz"])
