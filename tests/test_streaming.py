"""Streams with state, batch by batch, against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import frames as R
from pointweave.plans import streams
from pointweave.streaming import live


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def batches(spark, rows, schema, tmp_path, cuts):
    """The rows as a stream of one file a batch."""
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(stream, tmp_path):
    """All output rows with the number of their batch."""
    def each(batch, nth):
        batch.withColumn("batch", F.lit(nth)).write.mode("append").parquet(str(tmp_path / "out"))

    stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / "out"))


def test_map_is_cleared_by_a_falling_frame_id(rocks, tmp_path):
    rng = random.Random(2)
    frame_ids = [1, 2, 3, 1, 2, 0, 1, 2]  # falls twice, once within a batch
    rows = [(cloud, seq, frame, i, *(rng.choice([0.01, 0.03, 0.05, 0.5]) for _ in range(3))) for cloud in "ab" for seq, frame in enumerate(frame_ids) if cloud == "a" or seq < 3 for i in range(12)]
    rows.sort(key=lambda r: r[1])
    schema = "cloud_id string, seq long, frame_id long, ordinal long, x double, y double, z double"
    cut = [i for i, r in enumerate(rows) if i and r[1] != rows[i - 1][1] and r[1] in (2, 6)]
    updates = run(live.stream_session_map(batches(rocks, rows, schema, tmp_path, cut), 0.02), tmp_path)
    points = rocks.createDataFrame(rows, schema)
    for nth, end in enumerate([*cut, len(rows)]):
        so_far = rocks.createDataFrame(rows[:end], schema)
        expected = live.session_map(so_far, so_far.select("cloud_id", "seq", "frame_id").distinct())
        got = live.latest_map(updates.where(F.col("batch") <= nth))
        key = lambda df: sorted((r.cloud_id, r.vx, r.vy, r.vz, r.x, r.y, r.z) for r in df.collect())
        assert key(got) == key(expected)
    assert updates.agg(F.max("session")).first()[0] == 2 and points.count() == len(rows)


def test_status_with_the_update_rate(rocks, tmp_path):
    rng = random.Random(6)
    rows, t = [], 100.0
    for seq in range(60):
        t += rng.choice([0.1, 0.2, 0.0, -0.05, 1.0])
        rows.append((rng.choice("pq"), seq, rng.choice(["frame", "frame", "pose", "image", "error"]), rng.choice([None, 5, 7]), round(t, 3)))
    schema = "session string, seq long, kind string, points long, ts_s double"
    updates = run(live.stream_status(batches(rocks, rows, schema, tmp_path, [20, 45])), tmp_path)
    for nth, end in enumerate([20, 45, 60]):
        so_far = rocks.createDataFrame(rows[:end], schema)
        frames = so_far.where("kind = 'frame'").select(F.col("session").alias("cloud_id"), F.col("seq").alias("frame_idx"), "ts_s")
        rate = {r.cloud_id: r.rate_hz for r in R.update_rate(frames).collect()}
        counts = {r.session: r for r in live.status(so_far.withColumn("event_ts", F.timestamp_micros((F.col("ts_s") * 1e6).cast("long")))).collect()}
        newest = {r.session: r for r in updates.where(F.col("batch") <= nth).orderBy("batch").collect()}
        for session, r in newest.items():
            c = counts[session]
            assert (r.frames, r.poses, r.images, r.errors, r.points) == (c.frames, c.poses, c.images, c.errors, c.points)
            assert abs(r.elapsed_s - c.elapsed_s) < 1e-5 and abs(r.rate_hz - rate[session]) < 1e-9


def test_a_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, [i / 10 + 0.05, 0.0, 1.0]) for i in range(12)], "vec_id long, label int, embedding array<float>")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "embeddings.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "one" / "embeddings.parquet")
    parts, one = (sorted(streams.stream_voxel_map(spark, str(tmp_path / d)).collect()) for d in ("parts", "one"))
    assert parts == one and len(one) == 12
