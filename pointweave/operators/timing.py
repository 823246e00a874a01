"""Topic timing: rates, periods, jitter, gaps, header lag, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import telemetry as T
from ..session import written
from .sequences import BUCKET_ROWS, intervals, keyed_quantiles

MS = 1e6
#: Lag medians from here on, in ms, mean that two clocks have nothing to do with each other.
SEPARATE_EPOCH_MS = 86_400_000.0


def interval_summary(df: DataFrame, keys: Sequence[str] = ("bag_id", "topic"), order: str = "seq", time: str = "storage_ns", gap_factor: float = 3.0, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Rate, period, jitter and gap figures of each topic, exact and without sampling.

    Jitter leaves out intervals beyond ``max(1.1, gap_factor)`` medians; those count as gaps.
    """
    keys = list(keys)
    timed = written(intervals(df.select(*keys, order, time), keys, order, time, bucket_rows).select(*keys, time, "dt"))  # read five times
    dt = F.col("dt")
    positive = F.when(dt > 0, dt)
    first = timed.groupBy(*keys).agg(
        F.count("*").alias("message_count"), F.min(time).alias("first_ns"), F.max(time).alias("last_ns"),
        F.count_if(dt == 0).alias("duplicates"), F.count_if(dt < 0).alias("reversals"), F.max(positive).alias("max_gap"),
    )
    first = written(first.join(keyed_quantiles(timed, keys, {"p": (positive, (0.5, 0.95, 0.99))}), keys, "left"))  # a row for each key
    m = F.col("median")
    edge = m * max(1.1, gap_factor)
    placed = timed.where(dt > 0).join(first.select(*keys, F.get("p", F.lit(0)).alias("median")), keys)
    regular = F.when(dt <= edge, dt)
    second = placed.groupBy(*keys).agg(
        F.avg(regular).alias("mean"), F.stddev_pop(regular).alias("std"),
        F.count_if(dt > edge).alias("gap_count"), F.sum(F.when(dt > edge, F.greatest(F.lit(1.0), F.bround(dt / m, 0) - 1)).otherwise(0.0)).cast("long").alias("estimated_drops"),
    )
    jitter = keyed_quantiles(placed, keys, {"p95_jitter": (F.when(dt <= edge, F.abs(dt - m)), (0.95,))}).withColumn("p95_jitter", F.col("p95_jitter")[0])
    both = first.join(second, keys, "left").join(jitter, keys, "left").withColumns({"gap_count": F.coalesce("gap_count", F.lit(0)), "estimated_drops": F.coalesce("estimated_drops", F.lit(0))})
    duration = F.col("last_ns") - F.col("first_ns")
    n, drops = F.col("message_count"), F.col("estimated_drops")
    p = [F.get("p", F.lit(i)) for i in range(3)]
    return both.select(
        *keys, "message_count", "first_ns", "last_ns", (duration / 1e9).alias("duration_s"),
        F.when((duration > 0) & (n > 1), (n - 1) * 1e9 / duration).alias("mean_hz"), (1e9 / p[0]).alias("median_hz"),
        (F.col("mean") / MS).alias("mean_period_ms"), (p[0] / MS).alias("median_period_ms"), (p[1] / MS).alias("p95_period_ms"), (p[2] / MS).alias("p99_period_ms"),
        (F.col("std") / MS).alias("jitter_std_ms"), (F.col("std") / F.col("mean") * 100).alias("jitter_cv_pct"), (F.col("p95_jitter") / MS).alias("p95_jitter_ms"),
        F.coalesce(F.col("max_gap") / MS, F.lit(0.0)).alias("max_gap_ms"), "gap_count", "estimated_drops", (drops / (n + drops) * 100).alias("drop_pct"), "duplicates", "reversals",
    )


def rescale_sampled(summary: DataFrame, sampled: Column, total: Column) -> DataFrame:
    """Figures of a sample of ``sampled`` messages carried to ``total``: periods shrink, rates and drops grow."""
    scale = total / sampled
    periods = ("mean_period_ms", "median_period_ms", "p95_period_ms", "p99_period_ms", "jitter_std_ms", "p95_jitter_ms", "max_gap_ms")
    drops = F.bround(F.col("estimated_drops") * scale, 0).cast("long")
    out = summary.withColumns({c: F.col(c) / scale for c in periods} | {"median_hz": F.col("median_hz") * scale, "mean_hz": F.when(F.col("duration_s") > 0, (total - 1) / F.col("duration_s")), "estimated_drops": drops})
    return out.withColumn("drop_pct", F.col("estimated_drops") / (total + F.col("estimated_drops")) * 100)


def header_lag(df: DataFrame, keys: Sequence[str] = ("bag_id", "topic"), order: str = "seq") -> DataFrame:
    """Missing and backward header stamps, and the lag of storage behind the header, by topic."""
    keys = list(keys)
    header = F.when(F.col("header_ns") != 0, F.col("header_ns"))
    rows = df.select(*keys, order, header.alias("h"), ((F.col("storage_ns") - header) / MS).alias("lag"))
    back = intervals(rows.where("h is not null"), keys, order, "h").groupBy(*keys).agg(F.count_if(F.col("dt") < 0).alias("backward_stamps"))
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("decoded"), F.count("h").alias("valid"), F.count_if(F.col("h").isNull()).alias("missing_or_zero"),
        F.avg("lag").alias("lag_mean_ms"), F.max(F.abs("lag")).alias("lag_max_abs_ms"),
    )
    middle = keyed_quantiles(rows, keys, {"m": (F.col("lag"), (0.5,)), "a": (F.abs("lag"), (0.95,))})
    middle = written(middle.select(*keys, F.col("m")[0].alias("lag_median_ms"), F.col("a")[0].alias("lag_p95_abs_ms")))  # a row for each key
    first = first.join(middle, keys, "left")
    rest = keyed_quantiles(rows.join(middle, keys), keys, {"r": (F.abs(F.col("lag") - F.col("lag_median_ms")), (0.95,))}).select(*keys, F.col("r")[0].alias("lag_p95_residual_ms"))
    relation = F.when(F.col("valid") == 0, "unknown").when(F.abs("lag_median_ms") >= SEPARATE_EPOCH_MS, "separate_epoch").otherwise("aligned")
    return first.join(back, keys, "left").join(rest, keys, "left").withColumns({"backward_stamps": F.coalesce("backward_stamps", F.lit(0)), "clock_relation": relation})


def choose_time_basis(messages: DataFrame, gap_factor: float = 3.0) -> DataFrame:
    """Storage timing of each topic, or header timing where at least 10 and 80 % of its stamps are valid; both are kept."""
    keys = ["bag_id", "topic"]
    storage = interval_summary(messages, keys, gap_factor=gap_factor)
    valid = messages.where((F.col("header_ns").isNotNull()) & (F.col("header_ns") != 0))
    header = interval_summary(valid, keys, time="header_ns", gap_factor=gap_factor)
    fields = [c for c in storage.columns if c not in keys]
    packed = header.select(*keys, F.struct(*fields).alias("header"))
    joined = storage.select(*keys, F.struct(*fields).alias("storage")).join(packed, keys, "left")
    enough = F.coalesce((F.col("header.message_count") >= 10) & (F.col("header.message_count") >= 0.8 * F.col("storage.message_count")), F.lit(False))
    chosen = F.when(enough, F.col("header")).otherwise(F.col("storage"))
    return joined.withColumns({"time_basis": F.when(enough, "header").otherwise("storage"), "timing": chosen})


def inventory(messages: DataFrame) -> DataFrame:
    """Messages and time span of each topic, and of each whole bag (``topic`` null), in one pass."""
    return messages.rollup("bag_id", "topic").agg(F.count("*").alias("message_count"), F.min("storage_ns").alias("first_ns"), F.max("storage_ns").alias("last_ns")).where(F.col("bag_id").isNotNull())


def count_by_topic(topics: DataFrame, messages: DataFrame) -> DataFrame:
    """Every listed topic with its number of messages, 0 for none."""
    return topics.join(messages.groupBy("bag_id", "topic").agg(F.count("*").alias("n")), ["bag_id", "topic"], "left").withColumn("message_count", F.coalesce("n", F.lit(0))).drop("n")


def merge_topic_metadata(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared topics and observed ones: observed counts where none are declared, the type of either."""
    d = declared.select("bag_id", "topic", F.col("msgtype").alias("d_type"), F.col("declared_count").alias("d_count"))
    o = observed.select("bag_id", "topic", F.col("msgtype").alias("o_type"), F.col("message_count").alias("o_count"))
    count = F.when(F.coalesce("d_count", F.lit(0)) == 0, F.col("o_count")).otherwise(F.col("d_count"))
    return d.join(o, ["bag_id", "topic"], "full_outer").select("bag_id", "topic", F.coalesce(F.nullif("d_type", F.lit("")), "o_type").alias("msgtype"), F.coalesce(count, F.lit(0)).alias("message_count"), F.coalesce("o_count", F.lit(0)).alias("observed_count"))


def with_topics(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Messages with their topic's row; Spark broadcasts the topics if they are small."""
    return messages.join(topics, ["bag_id", "topic"])


def classify_topics(topics: DataFrame, control_hz: float = 20.0) -> DataFrame:
    t, k = F.col("topic"), F.col("msgtype")
    return topics.withColumns({"is_control": T.is_control(t, k), "is_static": T.is_static(t), "is_event": T.is_event_driven(t), "role": T.role(t, k), "least_hz": T.least_rate(t, k, control_hz)})


def payload_stride(messages: DataFrame, most: int = 2000) -> DataFrame:
    """At most ``most`` messages of each topic: every k-th in recorded order, the first included."""
    from .sequences import stride_sample

    return stride_sample(messages, ["seq"], most, ["bag_id", "topic"]).drop("position")
