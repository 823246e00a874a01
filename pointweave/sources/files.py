"""Readers of point, frame and log files, and writers of results.

Point files are read by ranges that their headers plan (``format("point_files")``), frame files by an index of their headers and
then frame by frame, records of a fixed size by ranges; so one file of any size is read by many tasks in bounded memory.
Faults of files are rows of ``scan_errors``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import over_threshold
from ..session import written
from . import ranged
from .ranged import POINTS, RANGE_BYTES, colours, opened, point_batches

FRAMES = "cloud_id string, frame_idx long, frame_id long, ts_s double, source_point_count long, point_offset long, payload_offset long, record_size int"
POSES = "cloud_id string, idx long, id long, ts_s double, px double, py double, pz double, qx double, qy double, qz double, qw double"
IMAGES = "cloud_id string, idx long, id long, ts_s double, payload_offset long, payload_size long"
#: A pose: id, seconds, place and turn.
_POSE = np.dtype([("id", "<u4"), ("ts_s", "<f8"), *[(n, "<f4") for n in ("px", "py", "pz", "qx", "qy", "qz", "qw")]])


def files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The listing of files (``path, length, content``); what leaves out ``content`` does not read them."""
    return spark.read.format("binaryFile").load(path)


def detect_kind(listing: DataFrame) -> DataFrame:
    """``path, kind`` of files: by their first bytes, else by their names."""
    head = F.decode(F.substring("content", 1, 16), "ISO-8859-1")
    kind = F.when(head.rlike(r"^# \.PCD|^VERSION"), "pcd").when(head.startswith("ply"), "ply").when(head.startswith("SQLite format 3"), "sqlite")
    name = F.lower("path")
    return listing.select("path", kind.when(name.endswith("metadata.yaml"), "bag_metadata").when(name.rlike(r"\.olx$|frames\.bin$"), "frames").when(name.rlike(r"poses?\.bin$"), "poses").otherwise("unknown").alias("kind"))


def _point_files(spark: SparkSession, paths: list[str], kind: str, range_bytes: int, columns: str, **more: object):
    spark.dataSource.register(ranged.PointFiles)
    reader = spark.read.format("point_files").schema(columns).option("paths", json.dumps(paths)).option("kind", kind).option("range_bytes", str(range_bytes))
    for name, value in more.items():
        reader = reader.option(name, json.dumps(value))
    return reader.load()


def _paths(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """All files, empty ones too, which a scan would leave out."""
    return sorted(map(unquote, files(spark, path).inputFiles()))


_CHECKS = "cloud_id string, start long, lines long, bad long, wanted long, error string"


def _checked(spark: SparkSession, paths: list[str], kind: str, range_bytes: int) -> tuple[list[tuple[str, int, int]], dict[str, str]]:
    """The first record of each range of the ascii files, and the fault of each faulty file.

    A row for each range of an ascii file and for each file with a faulty header comes to the driver; lines after the
    wanted records may hold anything.
    """
    checks = _point_files(spark, paths, kind, range_bytes, _CHECKS).where("wanted is not null or error is not null")
    first, faults, before, short = [], {}, {}, {}
    for cloud, start, lines, bad, wanted, error in sorted(map(tuple, checks.collect()), key=lambda r: r[:2]):
        at = before.get(cloud, 0)
        if error is not None and (bad is None or at + bad < wanted):
            faults.setdefault(cloud, error)
        first.append((cloud, start, at))
        before[cloud] = at + lines
        short[cloud] = wanted is not None and before[cloud] < wanted
    return first, {c: "ValueError: the file is cut short" for c, is_short in short.items() if is_short} | faults


def _scan_points(spark: SparkSession, path: str | Sequence[str], kind: str, range_bytes: int) -> DataFrame:
    """Points by range.  Ascii bodies are parsed once before, by range, for faults and for the number of lines before each range."""
    paths = _paths(spark, path)
    lines, faults = _checked(spark, paths, kind, range_bytes)
    return _point_files(spark, paths, kind, range_bytes, POINTS, lines=lines, skip=sorted(faults))


def scan_pcd(spark: SparkSession, path: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points of PCD files, ascii or binary; a faulty file gives none.  Ordinals count through a file."""
    return _scan_points(spark, path, "pcd", range_bytes)


def scan_ply(spark: SparkSession, path: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The vertices of PLY files, ascii or binary of either byte order; as ``scan_pcd``."""
    return _scan_points(spark, path, "ply", range_bytes)


def _walked(listing: DataFrame, schema: str, rows: Callable[[object, int, str], list[tuple]]) -> DataFrame:
    """Rows of each file from a walk over its headers; a file that can't be opened gives none."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with opened(path) as source:
                        out = rows(source, size, path)
                except ranged.FAULTS:
                    continue  # scan_errors names it
                yield pa.record_batch([pa.array([r[i] for r in out], kinds[f.split()[1]]) for i, f in enumerate(schema.split(", "))], names=names)

    return listing.select("path", "length").mapInArrow(run, schema)


def scan_frames_index(listing: DataFrame, strict: bool = False) -> DataFrame:
    """One row a frame with its place in the file, from headers only.

    A file with a bad tail keeps the good frames before it, or none with ``strict``; ``scan_errors`` names it either way.
    """

    def rows(source, size: int, path: str) -> list[tuple]:
        record, frames, error = ranged.frame_walk(source, size)
        out, first = [], 0
        for i, (frame, seconds, n, at) in enumerate([] if strict and error else frames):
            out.append((path, i, frame, seconds, n, first, at, record))
            first += n
        return out

    return _walked(listing, FRAMES, rows)


def scan_frames(listing: DataFrame, strict: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points of all frames, which are dealt to tasks; ordinals count through a file."""
    index = written(scan_frames_index(listing, strict))  # headers are walked once
    total = index.agg(F.sum(F.col("source_point_count") * F.col("record_size"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                names = "xyzrgb" if f["record_size"] == 15 else "xyzrgba"
                dtype = np.dtype([(n, "<f4" if n in "xyz" else "u1") for n in names])
                first = f["point_offset"]
                with opened(f["cloud_id"]) as source:
                    for rec in ranged.read_records(source, dtype, f["payload_offset"], f["source_point_count"]):
                        yield ranged.point_batch(f["cloud_id"], {n: rec[n] for n in names}, first, f["frame_id"])
                        first += len(rec)

    dealt = index.repartition(int(total // range_bytes) + 1, "cloud_id", "frame_idx")
    return dealt.mapInArrow(run, POINTS)


def scan_images(listing: DataFrame) -> DataFrame:
    """The index of image streams: the good frames before the first bad one; payloads stay unread."""

    def rows(source, size: int, path: str) -> list[tuple]:
        frames, _ = ranged.walk(source, size, 1, most_count=ranged.MOST_IMAGE_BYTES)
        return [(path, i, frame, seconds, at, n) for i, (frame, seconds, n, at) in enumerate(frames)]

    return _walked(listing, IMAGES, rows)


def scan_poses(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of 40 bytes, read by range; a rest at the end is left out, and a row of ``scan_errors``."""
    names = list(_POSE.names)
    step = max(1, range_bytes // _POSE.itemsize)
    n = F.floor(F.col("length") / _POSE.itemsize).cast("long")
    ranges = listing.select("path", n.alias("n")).where("n > 0").select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with opened(path) as source:
                    for rec in ranged.read_records(source, _POSE, first * _POSE.itemsize, min(step, n - first)):
                        yield pa.record_batch([pa.array([path] * len(rec), pa.string()), pa.array(np.arange(first, first + len(rec))), pa.array(rec["id"].astype(np.int64)), pa.array(rec["ts_s"].copy()), *[pa.array(rec[c].astype(np.float64)) for c in names[2:]]], names=["cloud_id", "idx", *names])
                        first += len(rec)

    return ranges.mapInArrow(run, POSES)


def scan_errors(spark: SparkSession, path: str | Sequence[str], kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, error`` of files of a kind (pcd, ply, frames, images, poses) that are faulty, wholly or from some byte on."""
    if kind in ranged.LAYOUTS:
        faults = _checked(spark, _paths(spark, path), kind, range_bytes)[1]
        return spark.createDataFrame(sorted(faults.items()), "path string, error string")

    def fault(source, size: int, path: str) -> list[tuple]:
        error = None
        if kind == "frames":
            error = ranged.frame_walk(source, size)[2]
        elif kind == "images":
            end = ranged.walk(source, size, 1, most_count=ranged.MOST_IMAGE_BYTES)[1]
            error = None if end == size else f"ValueError: no whole image at byte {end} of {size}"
        elif size % _POSE.itemsize:
            error = f"ValueError: {size % _POSE.itemsize} bytes at the end are no whole pose"
        return [(path, error)] if error else []

    def rows(source, size: int, path: str) -> list[tuple]:
        try:
            return fault(source, size, path)
        except ranged.FAULTS as e:
            return [(path, f"{type(e).__name__}: {e}")]

    return _walked(files(spark, path), "path string, error string", rows)


#: Field types of point messages by number (fixed values); those of four bytes can hold packed colours.
_FIELDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def _message_dtype(m: dict) -> np.dtype:
    """How the points of a message lie in its rows; ``ValueError`` if they can't be read."""
    fields = {f["name"].lower(): f for f in m["fields"] or []}
    colour = next((c for c in ("rgba", "rgb") if c in fields), None)
    wanted = ["x", "y", "z", *([colour] if colour else []), *(["intensity"] if "intensity" in fields else [])]
    step, width, height = m["point_step"] or 0, m["width"], m["height"]
    if step <= 0 or width is None or height is None or min(width, height) < 0:
        raise ValueError("the dimensions are not valid")
    formats = []
    for name in wanted:
        f = fields.get(name)
        kind = _FIELDS.get(f["datatype"]) if f else None
        if kind is None or f["offset"] is None or f["offset"] < 0 or (f.get("count") or 1) != 1 or f["offset"] + int(kind[1]) > step:
            raise ValueError(f"field {name} is missing or does not fit in a point")
        if name in "xyz" and kind != "f4":
            raise ValueError(f"field {name} is no 32-bit float")
        if name == colour:
            if kind[1] != "4":
                raise ValueError("packed colours need four bytes")
            kind = "u4"
        formats.append((">" if m["is_bigendian"] else "<") + kind)
    if (m["row_step"] or 0) < width * step:
        raise ValueError("row_step is less than the points of a row")
    if len(m["data"] or b"") < m["row_step"] * height:
        raise ValueError("the payload is cut short")
    return np.dtype({"names": wanted, "formats": formats, "offsets": [fields[n]["offset"] for n in wanted], "itemsize": step})


def _message_points(m: dict) -> dict[str, np.ndarray]:
    """The finite points of a message.  Without packed colours an intensity makes grays; values of one message that are floats
    and all lie in 0 to 1 are scaled to 255 together."""
    dtype, width = _message_dtype(m), m["width"]
    rec = np.concatenate([np.frombuffer(m["data"], dtype, width, i * m["row_step"]) for i in range(m["height"])] or [np.zeros(0, dtype)])
    rec = rec[np.isfinite(rec["x"]) & np.isfinite(rec["y"]) & np.isfinite(rec["z"])]
    out = {n: rec[n].astype(rec[n].dtype.newbyteorder("=")) for n in dtype.names}
    if "rgba" in out:
        out["a"] = out["rgba"] >> 24
    elif "rgb" not in out and "intensity" in out:
        is_float = out["intensity"].dtype.kind == "f"
        gray = np.nan_to_num(out["intensity"].astype(np.float64), nan=0.0, posinf=255.0, neginf=0.0)
        if is_float and len(gray) and gray.min() >= 0 and gray.max() <= 1:
            gray = gray * 255
        out |= dict.fromkeys("rgb", np.clip(gray, 0, 255).astype(np.uint8))
    return colours(out)


def decode_cloud_messages(messages: DataFrame) -> DataFrame:
    """Point payloads (``cloud_id, frame_id, width, height, point_step, row_step, is_bigendian, fields, data``) to points.

    ``fields`` holds name, offset and datatype (1 to 8), and may hold count.  Rows' padding is skipped; points that are not finite go;
    a faulty message gives none and a row of ``cloud_message_errors``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one payload at a time
                m = b.slice(i, 1).to_pylist()[0]
                try:
                    rec = _message_points(m)
                except ValueError:
                    continue
                yield from point_batches(m["cloud_id"], rec, frame=m["frame_id"])

    return messages.mapInArrow(run, POINTS)


def cloud_message_errors(messages: DataFrame) -> DataFrame:
    """``cloud_id, frame_id, error`` of the messages that ``decode_cloud_messages`` leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                m = b.slice(i, 1).to_pylist()[0]
                try:
                    _message_dtype(m)
                except ValueError as e:
                    out.append((m["cloud_id"], m["frame_id"], str(e)))
            yield pa.record_batch([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["cloud_id", "frame_id", "error"])

    return messages.mapInArrow(run, "cloud_id string, frame_id long, error string")


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").partitionBy("cloud_id").parquet(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Bins, cells or distances as CSV with a header; null figures are empty."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_distances(distances: DataFrame, path: str, threshold: float) -> None:
    """Points with their distance and whether it is over the threshold, as CSV with a header."""
    write_rows(distances.withColumn("over_threshold", over_threshold(F.col("distance"), threshold)), path)


def write_summaries(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
