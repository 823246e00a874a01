"""The given tables seen as messages, points, frames and measurements; for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Message types by event type: the roles that the telemetry queries tell apart.
TYPES = {"view": "sensor_msgs/msg/Imu", "click": "nav_msgs/msg/Odometry", "purchase": "sensor_msgs/msg/LaserScan", "error": "diagnostic_msgs/msg/DiagnosticArray"}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a message index: ten bags, a topic for each event type."""
    e = table(spark, sf_dir, "events")
    kind = F.lit("std_msgs/msg/String")
    for k, v in TYPES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return e.select(
        (F.col("user_id") % 10).cast("string").alias("bag_id"), F.concat(F.lit("/"), F.col("event_type")).alias("topic"), kind.alias("msgtype"), F.col("event_id").alias("seq"),
        ns.alias("storage_ns"), F.when(F.col("event_id") % 50 == 0, F.lit(0)).otherwise(ns - F.floor(F.col("value") * 1000).cast("long") * 1000).alias("header_ns"), "value",
    )


_KIND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
#: DuckDB's ``m``: the same messages.
MESSAGES = f"""m AS (SELECT (user_id % 10)::VARCHAR AS bag_id, '/' || event_type AS topic, CASE event_type {_KIND} ELSE 'std_msgs/msg/String' END AS msgtype,
    event_id AS seq, epoch_us(ts) * 1000 AS storage_ns,
    CASE WHEN event_id % 50 = 0 THEN 0 ELSE epoch_us(ts) * 1000 - floor(value * 1000)::BIGINT * 1000 END AS header_ns, value FROM events)"""


def small_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as points: one cloud, frames by label."""
    e = table(spark, sf_dir, "embeddings")
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    return e.select(F.lit("c").alias("cloud_id"), F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("ordinal"), x.alias("x"), y.alias("y"), z.alias("z"))


#: DuckDB's ``p``: the same points.
SMALL_POINTS = "p AS (SELECT 'c' AS cloud_id, label::BIGINT AS frame_id, vec_id AS ordinal, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as points: a cloud for each line status, frames by line number, colours by quantity and price."""
    li = table(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.select(
        F.col("l_linestatus").alias("cloud_id"), F.col("l_linenumber").cast("long").alias("frame_id"), F.col("l_orderkey").alias("ordinal"),
        q.cast("double").alias("x"), (F.col("l_discount") * 500).alias("y"), (p / 1000).alias("z"),
        (q.cast("int") * 5).cast("smallint").alias("r"), F.col("l_linenumber").cast("smallint").alias("g"), F.lit(0).cast("smallint").alias("b"),
    )


POINTS = "p AS (SELECT l_linestatus AS cloud_id, l_linenumber::BIGINT AS frame_id, l_orderkey AS ordinal, l_quantity::DOUBLE AS x, l_discount * 500 AS y, l_extendedprice / 1000 AS z, (trunc(l_quantity)::INT * 5)::SMALLINT AS r, l_linenumber::SMALLINT AS g, 0::SMALLINT AS b FROM lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating-point columns rounded, for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
