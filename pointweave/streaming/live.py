"""Structured Streaming forms: ingest, voxel map, previews, status, topic health, sessions, frozen values, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import cell, finite
from ..operators.sequences import running_sums, stride_sample, with_previous

XYZ = ("x", "y", "z")


def ingest(messages: DataFrame, decode: Callable[[DataFrame], DataFrame], good_path: str, bad_path: str, checkpoint: str):
    """Starts a stream that decodes frames into Parquet and keeps the frames that gave no points in another place.

    Each batch has a folder ``batch=<number>`` of its own in both places, so that one that is run again replaces what it wrote.
    """

    def each(batch: DataFrame, nth: int) -> None:
        points = decode(batch).persist()
        points.write.mode("overwrite").parquet(f"{good_path}/batch={nth}")
        batch.join(points.select("cloud_id", "frame_id").distinct(), ["cloud_id", "frame_id"], "left_anti").drop("data").write.mode("overwrite").parquet(f"{bad_path}/batch={nth}")
        points.unpersist()

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_sessions(frames: DataFrame) -> DataFrame:
    """Adds ``session``: how often a cloud's frame id has fallen so far in order of arrival (``cloud_id, seq, frame_id``)."""
    known = with_previous(frames, ["cloud_id"], "seq", {"__old": "frame_id"})
    return running_sums(known, ["cloud_id"], "seq", {"session": F.col("frame_id") < F.col("__old")}).drop("__old")


def session_map(points: DataFrame, frames: DataFrame, size: float = 0.02) -> DataFrame:
    """The voxel map of each cloud's newest session; a frame id that falls starts an empty map.

    ``points`` and ``frames`` share ``cloud_id, seq``, the place of a frame in order of arrival.
    """
    dealt = frame_sessions(frames.select("cloud_id", "seq", "frame_id"))
    newest = dealt.groupBy("cloud_id").agg(F.max("session").alias("session"))
    kept = dealt.join(newest, ["cloud_id", "session"], "left_semi").select("cloud_id", "seq")
    return voxel_map(points.join(kept, ["cloud_id", "seq"], "left_semi"), size)


SESSION_MAP = "cloud_id string, session long, vx long, vy long, vz long, frame_id long, ordinal long, x double, y double, z double"


class SessionVoxels(StatefulProcessor):
    """State of a cloud: its last frame, and its voxels as a map, which a frame id that falls clears."""

    def __init__(self, size: float):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frame = handle.getValueState("frame", "frame_id long, session long")
        self.voxels = handle.getMapState("voxels", "vx long, vy long, vz long", "frame_id long, ordinal long, x double, y double, z double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        points = pd.concat(list(rows)).sort_values(["seq", "ordinal"], kind="stable")
        last, session = self.frame.get() if self.frame.exists() else (None, 0)
        changed: dict[tuple, tuple] = {}
        for _, frame in points.groupby("seq", sort=True):
            now = int(frame["frame_id"].iloc[0])
            if last is not None and now < last:
                self.voxels.clear()
                changed, session = {}, session + 1
            last = now
            at = frame[list(XYZ)].to_numpy()
            good = np.isfinite(at).all(axis=1)
            cells = np.floor(at[good] / self.size).astype(np.int64)
            for cell_, ordinal, p in zip(map(tuple, cells.tolist()), frame["ordinal"].to_numpy()[good].tolist(), at[good].tolist(), strict=True):
                changed[cell_] = (now, ordinal, *p)  # the last point of a voxel stays
        self.frame.update((last, session))
        for cell_, value in changed.items():
            self.voxels.updateValue(cell_, value)
        yield pd.DataFrame([(key[0], session, *cell_, *value) for cell_, value in changed.items()], columns=[c.split()[0] for c in SESSION_MAP.split(", ")])

    def close(self) -> None:
        pass


def stream_session_map(points: DataFrame, size: float = 0.02) -> DataFrame:
    """A stream of voxel updates (``SESSION_MAP``) of ``cloud_id, seq, frame_id, ordinal, x, y, z``; a frame id that falls clears its cloud's map.

    ``seq`` is a frame's place in order of arrival.  Run it in update mode with the RocksDB state store; each batch gives the voxels that
    it changed, and ``latest_map`` makes the maps as they are now from all updates.
    """
    return points.groupBy("cloud_id").transformWithStateInPandas(SessionVoxels(size), SESSION_MAP, "Update", "None")


def latest_map(updates: DataFrame) -> DataFrame:
    """The newest point of each voxel of each cloud's newest session, of a log of ``SESSION_MAP`` rows."""
    newest = updates.groupBy("cloud_id").agg(F.max("session").alias("session"))
    point = F.max_by(F.struct(*XYZ), F.struct("frame_id", "ordinal"))
    return updates.join(newest, ["cloud_id", "session"]).groupBy("cloud_id", "vx", "vy", "vz").agg(point.alias("p")).select("cloud_id", "vx", "vy", "vz", "p.*")


def voxel_map(points: DataFrame, size: float = 0.02) -> DataFrame:
    """The last point of each voxel and cloud; a stream of it runs in update or complete mode."""
    good = points.where(finite(*[F.col(c) for c in XYZ]))
    voxel = [cell(F.col(c), size).alias(f"v{c}") for c in XYZ]
    last = F.max_by(F.struct(*XYZ, *[c for c in "rgb" if c in points.columns]), F.struct("frame_id", "ordinal"))
    return good.groupBy("cloud_id", *voxel).agg(last.alias("p")).select("cloud_id", *[f"v{c}" for c in XYZ], "p.*")


def coarsen(voxels: DataFrame, size: float, limit: int, rounds: int = 32) -> tuple[DataFrame, float]:
    """A map of at most ``limit`` points: coarser voxels, then a stride; also the voxel size that did it."""
    now = voxels.select("cloud_id", *XYZ)
    for _ in range(rounds):
        n = now.count()
        if n <= limit:
            return now, size
        size *= max(1.25, (n / limit) ** 0.5)
        keys = [cell(F.col(c), size).alias(f"k{c}") for c in XYZ]
        now = now.groupBy("cloud_id", *keys).agg(F.max(F.struct(*XYZ)).alias("p")).select("cloud_id", "p.*")
    return stride_sample(now, list(XYZ), limit).drop("position"), size


def frame_preview(points: DataFrame, limit: int) -> DataFrame:
    """A bounded stride sample of each frame."""
    return stride_sample(points, ["ordinal"], limit, ["cloud_id", "frame_id"]).drop("position")


def status(events: DataFrame) -> DataFrame:
    """Counts by session of a stream of ``session, kind, points, event_ts``."""
    return events.groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("frame", "pose", "image", "error")], F.sum("points").alias("points"), (F.max("event_ts").cast("double") - F.min("event_ts").cast("double")).alias("elapsed_s"))


STATUS = "session string, frames long, poses long, images long, errors long, points long, elapsed_s double, rate_hz double"


class SessionStatus(StatefulProcessor):
    """State of a session: its counts, its first and last time, the last frame's time and the smoothed rate of frames."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "frames long, poses long, images long, errors long, points long, first double, last double, frame_s double, rate_hz double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        counts, (points, first, last, frame_s, rate) = [0, 0, 0, 0], (0, None, None, None, 0.0)
        if self.state.exists():
            *counts, points, first, last, frame_s, rate = self.state.get()
        kinds = ("frame", "pose", "image", "error")
        for kind, n, t in zip(events["kind"], events["points"].fillna(0).astype(int).tolist(), events["ts_s"].tolist(), strict=True):
            points += n
            first, last = t if first is None else min(first, t), t if last is None else max(last, t)
            if kind in kinds:
                counts[kinds.index(kind)] += 1
            if kind == "frame":
                if frame_s is not None and t > frame_s:
                    now = 1 / (t - frame_s)
                    rate = now if rate == 0 else self.keep * rate + (1 - self.keep) * now
                frame_s = t
        self.state.update((*counts, points, first, last, frame_s, rate))
        yield pd.DataFrame([(key[0], *counts, points, last - first, rate)], columns=[c.split()[0] for c in STATUS.split(", ")])

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, keep: float = 0.65) -> DataFrame:
    """Counts, points, elapsed time and smoothed frame rate of each session so far, of a stream of ``session, seq, kind, points, ts_s``.

    Run it in update mode with the RocksDB state store; rows of a batch are taken by ``seq``.
    """
    return events.groupBy("session").transformWithStateInPandas(SessionStatus(keep), STATUS, "Update", "None")


def topic_windows(messages: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Messages and rate by topic and time window, with a watermark for late ones."""
    w = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    out = messages.withWatermark("event_ts", late).groupBy(w, "topic").agg(F.count("*").alias("n"), F.min("event_ts").alias("first"), F.max("event_ts").alias("last"))
    span = F.col("last").cast("double") - F.col("first").cast("double")
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "topic", "n", F.when(span > 0, (F.col("n") - 1) / span).alias("hz"))


def gap_sessions(messages: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of a topic that a pause of ``gap`` ends."""
    out = messages.withWatermark("event_ts", late).groupBy(F.session_window("event_ts", gap).alias("s"), "topic").agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "topic", "n")


HEALTH = "topic string, n long, duplicates long, reversals long, late long, max_gap_ns long, repeat_run long, max_repeat_run long"
_STATE = "n long, last long, greatest long, duplicates long, reversals long, late long, max_gap long, signature string, run long, max_run long"


def topic_health(messages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Running health of each topic across batches: gaps, duplicates, reversals, rows behind the greatest time, frozen runs.

    ``messages`` holds ``topic, seq, storage_ns, signature``.  State is one small row a topic; with
    ``idle_ms`` it goes after so long without messages.  Run it in update mode; each batch gives the topic's figures so far.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, greatest, dup, rev, late, gap, sig, run, most = state.get if state.exists else (0, -1, -1, 0, 0, 0, 0, None, 0, 0)
        rows = pd.concat([p[["seq", "storage_ns", "signature"]] for p in parts]).sort_values("seq", kind="stable")
        for t, s in zip(rows["storage_ns"].tolist(), rows["signature"].tolist(), strict=True):
            if n:
                dup, rev, late, gap = dup + (t == last), rev + (t < last), late + (t < greatest), max(gap, t - last)
            n, last, greatest = n + 1, t, max(greatest, t)
            if s:
                run = run + 1 if s == sig else 0
                sig, most = s, max(most, run)
        state.update((n, last, greatest, dup, rev, late, gap, sig, run, most))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], n, dup, rev, late, gap, run, most)], columns=[c.split()[0] for c in HEALTH.split(", ")])

    return messages.groupBy("topic").applyInPandasWithState(update, HEALTH, _STATE, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def split_late(batch: DataFrame, limit_ns: int) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that lie before a limit: for use before a watermark that would drop them."""
    return batch.where(F.col("storage_ns") >= limit_ns), batch.where(F.col("storage_ns") < limit_ns)


def latest(updates: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key in a log of updates."""
    return updates.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).where("__n = 1").drop("__n")
