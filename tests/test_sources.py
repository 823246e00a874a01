import csv
import json
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import rules
from pointweave.sources import bags as B
from pointweave.sources import files as S
from pointweave.sources import ranged as R

PCD = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgba\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {mode}\n"
RECORD = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("c", "<u4")]


def test_point_files_of_many_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 600
    rec = np.zeros(n, RECORD)
    for c in "xyz":
        rec[c] = rng.normal(size=n).astype("f4")
    rec["c"] = rng.integers(0, 1 << 24, n)
    (tmp_path / "a.pcd").write_bytes(PCD.format(n=n, mode="binary").encode() + rec.tobytes())
    lines = [f"{r['x']!r} {r['y']} {r['z']} {r['c']}".replace("np.float32(", "").replace(")", "") for r in rec]
    text = "\n".join(x + "\n" * (i % 7 == 0) for i, x in enumerate(lines))  # blank lines, no newline at the end
    (tmp_path / "b.pcd").write_text(PCD.format(n=n, mode="ascii") + text)
    got = S.scan_pcd(spark, str(tmp_path / "*.pcd"), range_bytes=500)
    assert got.rdd.getNumPartitions() > 50
    rows = sorted((r.cloud_id[-5:], r.ordinal, round(r.x, 4), r.r, r.g, r.b) for r in got.collect())
    expected = [(name, i, round(float(r["x"]), 4), r["c"] >> 16 & 255, r["c"] >> 8 & 255, r["c"] & 255) for name in ("a.pcd", "b.pcd") for i, r in enumerate(rec)]
    assert rows == expected
    whole = S.scan_pcd(spark, str(tmp_path / "*.pcd"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))
    assert S.scan_errors(spark, str(tmp_path / "*.pcd"), "pcd", 500).isEmpty()


def test_faulty_point_files_are_rows(spark, tmp_path):
    two = "1 2 3 4294901760\n4 5 6 255\n"
    body = np.array([(1, 2, 3, 4294901760), (4, 5, 6, 255)], RECORD).tobytes()
    good = {"ok.pcd": PCD.format(n=2, mode="ascii").encode() + two.encode(), "ok2.pcd": PCD.format(n=2, mode="binary").encode() + body, "none.pcd": PCD.format(n=0, mode="binary").encode()}
    bad = {
        "short.pcd": PCD.format(n=2, mode="binary").encode() + body[:-1],
        "fewer.pcd": PCD.format(n=3, mode="ascii").encode() + two.encode(),
        "word.pcd": PCD.format(n=2, mode="ascii").encode() + b"1 2 3 4\n1 two 3 4\n",
        "values.pcd": PCD.format(n=2, mode="ascii").encode() + b"1 2 3 4\n1 2\n",
        "empty.pcd": b"",
        "header.pcd": b"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS\nDATA ascii\n1 2 3\n",
        "fields.pcd": b"FIELDS x y\nSIZE 4 4\nTYPE F F\nPOINTS 1\nDATA ascii\n1 2\n",
        "packed.pcd": PCD.format(n=2, mode="binary_compressed").encode() + body,
    }
    for name, data in (good | bad).items():
        (tmp_path / name).write_bytes(data)
    for size in (8, S.RANGE_BYTES):
        got = S.scan_pcd(spark, str(tmp_path / "*.pcd"), size).collect()
        assert sorted((r.cloud_id.rsplit("/", 1)[1], r.ordinal, r.x, r.r, r.b) for r in got) == [(f, i, x, r, b) for f in ("ok.pcd", "ok2.pcd") for i, x, r, b in ((0, 1, 255, 0), (1, 4, 0, 255))]
        assert {r.path.rsplit("/", 1)[1] for r in S.scan_errors(spark, str(tmp_path / "*.pcd"), "pcd", size).collect()} == set(bad)


def test_ply_files(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    rows = [(1, 2, 3, 9, 8, 7), (4, 5, 6, 1, 1, 1), (7, 8, 9, 2, 2, 2)]
    for name, order in (("le.ply", "<"), ("be.ply", ">")):
        mode = "binary_little_endian" if order == "<" else "binary_big_endian"
        (tmp_path / name).write_bytes(head.format(mode).encode() + b"".join(struct.pack(order + "fff3B", *r) for r in rows) + b"\x03" + b"\0" * 12)
    (tmp_path / "text.ply").write_text(head.format("ascii") + "\n".join(" ".join(map(str, r)) for r in rows) + "\n3 0 1 2\n")
    (tmp_path / "bad.ply").write_bytes(head.replace("format {} 1.0\n", "").encode())
    (tmp_path / "list.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n1 1\n")
    for size in (16, S.RANGE_BYTES):
        got = S.scan_ply(spark, str(tmp_path / "*.ply"), size)
        assert sorted((r.cloud_id.rsplit("/", 1)[1], r.ordinal, r.x, r.y, r.z, r.r, r.g, r.b) for r in got.collect()) == [(f, i, *r) for f in ("be.ply", "le.ply", "text.ply") for i, r in enumerate(rows)]
        assert S.scan_errors(spark, str(tmp_path / "*.ply"), "ply", size).count() == 2


class Counting:
    """A file in memory that counts what is read."""

    def __init__(self, data):
        self.data, self.at, self.n = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at, self.n = self.at + len(out), self.n + len(out)
        return out


def frame_bytes(frames, extra=()):
    return b"".join(struct.pack("<IdI", i, t, n) + b"".join(struct.pack("<fff", i, j, 0) + bytes([1, 2, 3, *extra]) for j in range(n)) for i, t, n in frames)


def test_header_walks_read_no_payload():
    data = frame_bytes([(i, float(i), 2000) for i in range(20)], [9])
    source = Counting(data)
    record, frames, error = R.frame_walk(source, len(data))
    assert (record, len(frames), error) == (16, 20, None) and source.n <= 20 * R.WALK_BYTES < len(data) / 5
    assert R.frame_walk(Counting(data[:-5]), len(data) - 5)[:2] == (16, frames[:-1])
    assert R.frame_walk(Counting(b"no frames"), 9)[1] == []
    nan = struct.pack("<IdI", 5, math.nan, 1) + b"\0" * 16
    assert R.frame_walk(Counting(data + nan), len(data) + 32)[1] == frames


@pytest.mark.parametrize("seed", range(4))
def test_lines_are_dealt_once(seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 1, 2, 5, 40]) for _ in range(60)]
    data, n = b"HEAD\n" + b"\n".join(lines), rng.choice([1, 3, 7, 50])
    got = []
    for a in range(5, len(data), n):
        for block in R.lines_between(Counting(data), 5, a, min(a + n, len(data)), block=rng.choice([1, 4, 64])):
            got += block
    assert got == [x for x in lines if x]


def test_frames_poses_images(spark, tmp_path):
    for name, extra in (("a.olx", []), ("b.olx", [255])):
        (tmp_path / name).write_bytes(frame_bytes([(7, 1000.0, 3), (8, 1000.1, 5)], extra))
    (tmp_path / "cut.olx").write_bytes(frame_bytes([(7, 1000.0, 3), (8, 1000.1, 5)])[:-1])
    path = str(tmp_path / "*.olx")
    listing = S.files(spark, path)
    index = sorted((r.cloud_id[-5:], r.frame_id, r.source_point_count, r.point_offset, r.record_size) for r in S.scan_frames_index(listing).collect())
    assert index == [("a.olx", 7, 3, 0, 15), ("a.olx", 8, 5, 3, 15), ("b.olx", 7, 3, 0, 16), ("b.olx", 8, 5, 3, 16), ("t.olx", 7, 3, 0, 15)]
    points = S.scan_frames(listing, range_bytes=50)
    assert points.rdd.getNumPartitions() >= 4
    assert sorted((r.cloud_id[-5:], r.ordinal, r.frame_id, r.y, r.a) for r in points.collect()) == [(f, i, 7 if i < 3 else 8, i if i < 3 else i - 3, 255) for f in ("a.olx", "b.olx") for i in range(8)] + [("t.olx", i, 7, i, 255) for i in range(3)]
    assert S.scan_frames(listing, strict=True).count() == 16
    assert [r.path[-7:] for r in S.scan_errors(spark, path, "frames").collect()] == ["cut.olx"]
    (tmp_path / "pose.bin").write_bytes(b"".join(struct.pack("<Id7f", i, 2.0, *range(7)) for i in range(5)) + b"rest")
    assert sorted((r.idx, r.id, r.qw) for r in S.scan_poses(S.files(spark, str(tmp_path / "pose.bin")), 80).collect()) == [(i, i, 6) for i in range(5)]
    assert "4 bytes" in S.scan_errors(spark, str(tmp_path / "pose.bin"), "poses").first().error
    (tmp_path / "img.bin").write_bytes(struct.pack("<IdI", 1, 2.0, 3) + b"abc" + struct.pack("<IdI", 4, 2.5, 0) + struct.pack("<IdI", 2, 3.0, 99) + b"x")
    assert [(r.payload_offset, r.payload_size) for r in S.scan_images(S.files(spark, str(tmp_path / "img.bin"))).collect()] == [(16, 3), (35, 0)]
    assert "byte 35" in S.scan_errors(spark, str(tmp_path / "img.bin"), "images").first().error


META = """rosbag2_bagfile_information:
  version: 5
  storage_identifier: sqlite3
  duration:
    nanoseconds: 900
  starting_time:
    nanoseconds_since_epoch: 100
  message_count: 5
  topics_with_message_count:
    - topic_metadata:
        name: /a
        type: pkg/msg/A
        serialization_format: cdr
        offered_qos_profiles: "- history: 3\\n  depth: 0"
      message_count: 3
    - topic_metadata:
        name: "/b: c"
        type: pkg/msg/B
        serialization_format: cdr
        offered_qos_profiles: |
          - reliability: 1
            depth: 5
      message_count: 2
  compression_format: ""
  relative_file_paths:
    - one.db3
    - two.db3
"""


def bag(folder, splits, meta=META):
    folder.mkdir()
    if meta is not None:
        (folder / "metadata.yaml").write_text(meta)
    for name, rows in splits.items():
        db = sqlite3.connect(folder / name)
        db.executescript("CREATE TABLE topics(id INTEGER PRIMARY KEY, name, type); CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id, timestamp, data); INSERT INTO topics VALUES (1, '/a', 'pkg/msg/A'), (2, '/b: c', 'pkg/msg/B')")
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, x'00')", rows)
        db.commit()
        db.close()


def test_bags_of_several_splits(spark, tmp_path):
    bag(tmp_path / "full", {"one.db3": [(1, 1, 5), (2, 2, 6), (7, 1, 8)], "two.db3": [(1, 1, 9), (2, 2, 11)]})
    bag(tmp_path / "lacks", {"one.db3": [(1, 1, 5)]})
    bag(tmp_path / "odd", {}, "a line\nwithout a mapping")
    bag(tmp_path / "unlisted", {"z.db3": [(1, 1, 1)], "b.db3": [(1, 2, 2)]}, "rosbag2_bagfile_information:\n  version: 4\n  relative_file_paths: []\n")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "metadata.yaml").write_text(META.replace("    - two.db3\n", ""))
    (tmp_path / "broken" / "one.db3").write_bytes(b"no database")
    meta = B.scan_bag_metadata(spark, str(tmp_path / "*" / "metadata.yaml")).cache()
    name = lambda r: r.bag_id.rsplit("/", 1)[1]
    known = {name(r): r for r in meta.collect()}
    full = known["full"]
    assert (full.version, full.storage, full.start_ns, full.duration_ns, full.declared_count, len(full.splits), full.error) == (5, "sqlite3", 100, 900, 5, 2, None)
    assert [(t.topic, t.qos, t.declared_count) for t in full.topics] == [("/a", "- history: 3\n  depth: 0", 3), ("/b: c", "- reliability: 1\n  depth: 5\n", 2)]
    assert known["odd"].error and known["odd"].topics == []
    splits = B.scan_splits(meta).cache()
    assert sorted((name(r), r.path.rsplit("/", 1)[1]) for r in splits.where("error is not null").collect()) == [("lacks", "two.db3")]
    rows = B.scan_bag_messages(splits, range_ids=2).collect()
    of = lambda bag: [(r.topic, r.storage_ns) for r in sorted(rows, key=lambda r: r.seq) if name(r) == bag]
    assert of("full") == [("/a", 5), ("/b: c", 6), ("/a", 8), ("/a", 9), ("/b: c", 11)]
    assert of("lacks") == [("/a", 5)] and of("unlisted") == [("/b: c", 2), ("/a", 1)] and of("broken") == []
    assert [name(r) for r in B.scan_bag_messages(splits, errors=True).collect()] == ["broken"]
    alone = B.scan_bag_sqlite(spark, str(tmp_path / "full" / "*.db3"))
    assert alone.groupBy("bag_id").count().count() == 2 and alone.count() == 5
    assert S.detect_kind(S.files(spark, str(tmp_path / "full" / "one.db3"))).first().kind == "sqlite"


def test_metadata_trees():
    assert B.tree("a: 1\nb:\n  - x\n  - y: 2\n    z: 'it''s'\nc:\n- d\n- \"e\\nf\"\n\ng: {}\n") == {"a": "1", "b": ["x", {"y": "2", "z": "it's"}], "c": ["d", "e\nf"], "g": {}}
    for bad in ("just words", "a: 1\n   b: 2", "- x\n    y"):
        with pytest.raises(ValueError):
            B.tree(bad)


MESSAGE = "cloud_id string, frame_id long, width int, height int, point_step int, row_step int, is_bigendian boolean, fields array<struct<name:string,offset:int,datatype:int,count:int>>, data binary"


def test_cloud_messages(spark):
    def message(frame, points, extra=None, kind="f", big=False, pad=0, **over):
        order = ">" if big else "<"
        size = 12 + (struct.calcsize(order + kind) if extra else 0)
        rows = [b"".join(struct.pack(order + "fff" + (kind if extra else ""), *p) for p in row) + b"\xff" * pad for row in points]
        fields = [(c, i * 4, 7, 1) for i, c in enumerate("XYZ")] + ([(extra, 12, {"f": 7, "I": 6, "B": 2}[kind], 1)] if extra else [])
        m = {"cloud_id": "c", "frame_id": frame, "width": len(points[0]), "height": len(points), "point_step": size, "row_step": len(points[0]) * size + pad, "is_bigendian": big, "fields": fields, "data": bytearray(b"".join(rows))} | over
        return tuple(m.values())

    nan = math.nan
    rows = [
        message(1, [[(1, 2, 3), (4, 5, 6)], [(nan, 0, 0), (7, 8, 9)]], pad=5, big=True),
        message(2, [[(0, 0, 0, 0.5), (1, 1, 1, 1.0), (2, 2, 2, nan)]], "intensity"),
        message(3, [[(0, 0, 0, 0.5), (1, 1, 1, 300.0)]], "intensity"),
        message(4, [[(0, 0, 0, 1), (1, 1, 1, 0)]], "intensity", "B"),
        message(5, [[(0, 0, 0, 0x80102030)]], "rgba", "I", big=True),
        message(6, [[(0, 0, 0)]], row_step=1),
        message(7, [[(0, 0, 0)]], data=bytearray(b"")),
        message(8, [[(0, 0, 0)]], fields=[("x", 0, 8, 1), ("y", 4, 7, 1), ("z", 8, 7, 1)]),
        message(9, [[(0, 0, 0)]], fields=[("x", 0, 7, 1), ("y", 4, 7, 1)]),
        message(10, [[(0, 0, 0)]], fields=[("x", 0, 7, 1), ("y", 4, 7, 1), ("z", 10, 7, 1)]),
    ]
    messages = spark.createDataFrame(rows, MESSAGE)
    got = sorted((r.frame_id, r.x, r.r, r.g, r.b, r.a) for r in S.decode_cloud_messages(messages).collect())
    assert got == [(1, 1, 205, 215, 225, 255), (1, 4, 205, 215, 225, 255), (1, 7, 205, 215, 225, 255), (2, 0, 127, 127, 127, 255), (2, 1, 255, 255, 255, 255), (2, 2, 0, 0, 0, 255), (3, 0, 0, 0, 0, 255), (3, 1, 255, 255, 255, 255), (4, 0, 1, 1, 1, 255), (4, 1, 0, 0, 0, 255), (5, 0, 0x10, 0x20, 0x30, 0x80)]
    assert sorted(r.frame_id for r in S.cloud_message_errors(messages).collect()) == [6, 7, 8, 9, 10]


def test_writers(spark, tmp_path):
    points = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5), ("b", 3, 1.0)], "cloud_id string, id long, distance double")
    S.write_points(points, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).where("cloud_id = 'b'").count() == 2
    S.write_distances(points.withColumn("distance", F.when(F.col("id") < 3, F.col("distance"))), str(tmp_path / "distances"), 1.0)
    rows = [r for f in (tmp_path / "distances").glob("*.csv") for r in csv.DictReader(f.open())]
    assert sorted((r["id"], r["distance"], r["over_threshold"]) for r in rows) == [("1", "0.5", "false"), ("2", "1.5", "true"), ("3", "", "")]
    S.write_rows(points.select("id", F.lit(None).cast("double").alias("mean")), str(tmp_path / "bins"))
    assert all(r["mean"] == "" for f in (tmp_path / "bins").glob("*.csv") for r in csv.DictReader(f.open()))
    S.write_summaries(points.groupBy("cloud_id").agg(F.struct(F.count("*").alias("n"), F.max("distance").alias("max")).alias("stats")), str(tmp_path / "summary"))
    read = [json.loads(x) for f in (tmp_path / "summary").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((r["cloud_id"], r["stats"]["n"], r["stats"]["max"]) for r in read) == [("a", 1, 0.5), ("b", 2, 1.5)]


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([("a", 93, math.nan), ("b", 100, 1.0)], "bag_id string, score int, coverage_pct double")
    issues = spark.createDataFrame([("a", "X", "warning", math.inf), ("a", "Y", "notice", 2.0)], "bag_id string, issue_id string, severity string, value double")
    topics = spark.createDataFrame([("a", "/t", 3), ("b", "/u", 4)], "bag_id string, topic string, messages long")
    rules.write_report(str(tmp_path / "report"), summary, issues, topics)
    read = {r["bag_id"]: r for f in (tmp_path / "report").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert "NaN" not in str(read) and "Infinity" not in str(read)
    assert read["a"].get("coverage_pct") is None and [i["issue_id"] for i in read["a"]["issues"]] == ["X", "Y"]
    assert read["a"]["issues"][0].get("value") is None and read["b"]["topics"] == [{"messages": 4, "topic": "/u"}]
