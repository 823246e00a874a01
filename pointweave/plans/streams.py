"""Streaming queries over the event log: the file source, run until all rows are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import live as L
from .tables import SMALL_POINTS, rounded, small_points, table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: one file, or a folder of parts; a file source takes no path of a file, but a pattern that only this path fits."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(out: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream writes, or its last complete result, through Parquet in the shared folder."""
    spark = out.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a batch that is run again replaces what it wrote
    q = out.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else n}")).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def _messages(spark, sf_dir):
    e = _stream(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), ts.alias("event_ts"), (F.unix_micros(ts) * 1000).alias("storage_ns"), F.floor(F.col("value") / 20).cast("string").alias("signature"), "value", "user_id")


def stream_topic_windows(spark, sf_dir):
    out = _run(L.topic_windows(_messages(spark, sf_dir), "1 day"), "complete")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "topic", "n", "hz"))


def stream_gap_sessions(spark, sf_dir):
    out = _run(L.gap_sessions(_messages(spark, sf_dir), "30 minutes"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "topic", "n")


def stream_topic_health(spark, sf_dir):
    return L.latest(_run(L.topic_health(_messages(spark, sf_dir)), "update"), ["topic"], "n")


def stream_status(spark, sf_dir):
    kind = F.when(F.col("topic") == "view", "frame").when(F.col("topic") == "click", "pose").when(F.col("topic") == "signup", "image").when(F.col("topic") == "error", "error")
    events = _messages(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("session"), kind.alias("kind"), F.floor("value").cast("long").alias("points"), "event_ts")
    return rounded(_run(L.status(events), "complete"), 3)


def stream_voxel_map(spark, sf_dir):
    e = _stream(spark, sf_dir, "embeddings")
    p = e.select(F.lit("c").alias("cloud_id"), F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("ordinal"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return rounded(_run(L.voxel_map(p, 0.1), "complete"))


def session_voxel_map(spark, sf_dir):
    p = small_points(spark, sf_dir).withColumns({"seq": F.col("frame_id"), "frame_id": F.col("frame_id") % 4})
    frames = p.select("cloud_id", "seq", "frame_id").distinct()
    return rounded(L.session_map(p, frames, 0.1))


def voxel_coarsen(spark, sf_dir):
    out, size = L.coarsen(L.voxel_map(small_points(spark, sf_dir), 0.02), 0.02, 100)
    return rounded(out.withColumn("size", F.lit(size)))


def frame_preview(spark, sf_dir):
    return L.frame_preview(small_points(spark, sf_dir), 20).select("frame_id", "ordinal")


QUERIES = {f.__name__: f for f in (stream_topic_windows, stream_gap_sessions, stream_topic_health, stream_status, stream_voxel_map, session_voxel_map, voxel_coarsen, frame_preview)}
ORACLES = {
    "stream_topic_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS topic, count(*) AS n, round((count(*) - 1) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 6) AS hz FROM events GROUP BY 1, 2",
    "stream_gap_sessions": """WITH e AS (SELECT event_type AS topic, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY topic ORDER BY t) AS k FROM e) SELECT min(t) AS start_us, topic, count(*) AS n FROM s GROUP BY topic, k""",
    "stream_status": """SELECT (user_id % 10)::VARCHAR AS session, count(*) FILTER (event_type = 'view') AS frames, count(*) FILTER (event_type = 'click') AS poses, count(*) FILTER (event_type = 'signup') AS images, count(*) FILTER (event_type = 'error') AS errors,
sum(floor(value))::BIGINT AS points, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS elapsed_s FROM events GROUP BY 1""",
    "stream_topic_health": """WITH e AS (SELECT event_type AS topic, event_id AS seq, epoch_us(ts) * 1000 AS t, floor(value / 20)::BIGINT AS s FROM events),
l AS (SELECT *, t - lag(t) OVER w AS dt, t < max(t) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY topic ORDER BY seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY topic ORDER BY seq) AS k FROM l), q AS (SELECT *, row_number() OVER (PARTITION BY topic, k ORDER BY seq) - 1 AS run FROM r)
SELECT topic, count(*) AS n, count(*) FILTER (dt = 0) AS duplicates, count(*) FILTER (dt < 0) AS reversals, count(*) FILTER (late) AS late, max(dt) AS max_gap_ns, arg_max(run, seq) AS repeat_run, max(run) AS max_repeat_run FROM q GROUP BY 1""",
    "stream_voxel_map": f"""WITH {SMALL_POINTS}, v AS (SELECT *, floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz FROM p)
SELECT cloud_id, vx, vy, vz, round(arg_max(x, frame_id * 1000000000 + ordinal), 6) AS x, round(arg_max(y, frame_id * 1000000000 + ordinal), 6) AS y, round(arg_max(z, frame_id * 1000000000 + ordinal), 6) AS z FROM v GROUP BY 1, 2, 3, 4""",
    "session_voxel_map": f"""WITH {SMALL_POINTS}, f AS (SELECT DISTINCT cloud_id, frame_id AS seq, frame_id % 4 AS id FROM p), g AS (SELECT *, CASE WHEN id < lag(id) OVER (PARTITION BY cloud_id ORDER BY seq) THEN seq END AS fell FROM f),
s AS (SELECT cloud_id, max(fell) AS since FROM g GROUP BY 1), v AS (SELECT p.*, floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz FROM p JOIN s ON s.cloud_id = p.cloud_id AND (since IS NULL OR frame_id >= since))
SELECT cloud_id, vx, vy, vz, round(arg_max(x, frame_id * 1000000000 + ordinal), 6) AS x, round(arg_max(y, frame_id * 1000000000 + ordinal), 6) AS y, round(arg_max(z, frame_id * 1000000000 + ordinal), 6) AS z FROM v GROUP BY 1, 2, 3, 4""",
    "frame_preview": f"WITH {SMALL_POINTS}, r AS (SELECT frame_id, ordinal, row_number() OVER (PARTITION BY frame_id ORDER BY ordinal) - 1 AS r, ceil(count(*) OVER (PARTITION BY frame_id) / 20)::BIGINT AS k FROM p) SELECT frame_id, ordinal FROM r WHERE r % k = 0",
}
