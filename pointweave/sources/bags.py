"""Robot logs of one or several split files: metadata, splits, and the message index of SQLite splits.

Metadata is read as a tree by indentation.  A bag's identity is its folder; its splits are the files that the metadata lists, or
those in the folder.  Messages come from ``format("bag_messages")``, whose partitions are ranges of message ids of a split,
so a large split is read by many tasks and payloads stay unread.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranged import BATCH

MESSAGES = "bag_id string, seq long, topic string, msgtype string, storage_ns long"
TOPIC = "struct<topic:string,msgtype:string,serialization_format:string,qos:string,declared_count:bigint>"
METADATA = f"bag_id string, version int, storage string, start_ns long, duration_ns long, declared_count long, compression_format string, compression_mode string, topics array<{TOPIC}>, splits array<string>, error string"
#: Message ids of a range; bits of a sequence number that hold the id within a split.
RANGE_IDS, ID_BITS = 1_000_000, 40


def _scalar(text: str) -> object:
    """A plain or quoted scalar."""
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text in ("[]", "{}"):
        return [] if text == "[]" else {}
    return None if text in ("", "~", "null") else text


def tree(text: str) -> object:
    """Mappings, lists, scalars and literal blocks of an indented text; ``ValueError`` for a line that is none of these."""
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines()]
    rows = [r for r in rows if r[1] not in ("---", "...") and not r[1].startswith("#")]

    def block(at: int, least: int) -> tuple[str, int]:
        out = []
        while at < len(rows) and (rows[at][0] >= least or not rows[at][1]):
            out.append(" " * (rows[at][0] - least) + rows[at][1])
            at += 1
        return "\n".join(out).rstrip("\n") + "\n", at

    def value(head: str, at: int, indent: int, in_list: bool) -> tuple[object, int]:
        """What stands behind a key or a dash: on the line, or in the deeper lines below."""
        if head in ("|", "|-", "|+", ">", ">-"):
            below = rows[at][0] if at < len(rows) else 0
            made, at = block(at, below) if below > indent else ("", at)
            return made.rstrip("\n") if head.endswith("-") else made, at
        if head:
            return _scalar(head), at
        if at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- ") and not in_list)):
            return node(at, rows[at][0])
        return None, at

    def node(at: int, indent: int) -> tuple[object, int]:
        made: object = None
        while at < len(rows):
            if not rows[at][1]:
                at += 1
                continue
            depth, line = rows[at]
            if depth != indent:
                if depth > indent:
                    raise ValueError(f"a line is indented too far: {line[:40]}")
                break
            if line == "-" or line.startswith("- "):
                made = [] if made is None else made
                if not isinstance(made, list):
                    break
                rest = line[2:].strip()
                if re.match(r"[\w./-]+:(\s|$)", rest):  # a mapping starts on the dash's line
                    rows[at] = (indent + 2, rest)
                    found, at = node(at, indent + 2)
                else:
                    found, at = value(rest, at + 1, indent, True)
                made.append(found)
                continue
            key = re.match(r"""("[^"]*"|'[^']*'|[^\s:][^:]*?)\s*:(?:\s+(.*))?$""", line)
            if not key:
                raise ValueError(f"a line is no mapping: {line[:40]}")
            made = {} if made is None else made
            if not isinstance(made, dict):
                break
            made[str(_scalar(key[1]))], at = value((key[2] or "").strip(), at + 1, indent, False)
        return made, at

    start = next((r[0] for r in rows if r[1]), 0)
    return node(0, start)[0]


def _whole(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def metadata(path: str, text: str) -> dict:
    """One row of METADATA; ``error`` says why a text is not read."""
    folder = path.rsplit("/", 1)[0]
    row: dict = dict.fromkeys(c.split()[0] for c in re.sub(r"<.*?>", "", METADATA).split(", ")) | {"bag_id": folder, "topics": [], "splits": []}
    try:
        known = tree(text)
        known = known.get("rosbag2_bagfile_information", known) if isinstance(known, dict) else None
        if not isinstance(known, dict):
            raise ValueError("the metadata is no mapping")
        listed = known.get("topics_with_message_count") or []
        for entry in listed if isinstance(listed, list) else []:
            topic = entry.get("topic_metadata") if isinstance(entry, dict) else None
            if isinstance(topic, dict) and topic.get("name"):
                qos = topic.get("offered_qos_profiles")
                row["topics"].append({"topic": str(topic["name"]), "msgtype": str(topic.get("type") or ""), "serialization_format": str(topic.get("serialization_format") or ""), "qos": qos if isinstance(qos, str) else json.dumps(qos) if qos else "", "declared_count": _whole(entry.get("message_count")) or 0})

        def nested(key: str, inner: str) -> int | None:
            return _whole(known[key].get(inner)) if isinstance(known.get(key), dict) else None

        paths = known.get("relative_file_paths") or []
        row |= {
            "version": _whole(known.get("version")), "storage": str(known.get("storage_identifier") or "sqlite3"), "declared_count": _whole(known.get("message_count")) or 0,
            "start_ns": nested("starting_time", "nanoseconds_since_epoch"), "duration_ns": nested("duration", "nanoseconds") or 0,
            "compression_format": str(known.get("compression_format") or ""), "compression_mode": str(known.get("compression_mode") or ""),
            "splits": [f"{folder}/{p}" for p in paths] if isinstance(paths, list) else [],
        }
    except ValueError as e:
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def scan_bag_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each metadata file, with its topics, splits and fault."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic = pa.struct([("topic", pa.string()), ("msgtype", pa.string()), ("serialization_format", pa.string()), ("qos", pa.string()), ("declared_count", pa.int64())])
        kinds = {"version": pa.int32(), "start_ns": pa.int64(), "duration_ns": pa.int64(), "declared_count": pa.int64(), "topics": pa.list_(topic), "splits": pa.list_(pa.string())}
        for b in batches:
            rows = [metadata(p, t or "") for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.record_batch([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in rows[0]], names=list(rows[0]))

    return texts.mapInArrow(run, METADATA)


def _local(path: str) -> str:
    found = re.match(r"(?:file:/*)?(?=/)(/.*)|file:/*(.*)", path)
    if not found:
        raise ValueError("SQLite reads files of a shared or local file system only")
    return found[1] or f"/{found[2]}"


def scan_splits(bags: DataFrame) -> DataFrame:
    """``bag_id, nth, path, error`` of the splits of bags (rows of METADATA); a split that is not there has an error.

    Bags whose metadata list none have the database files of their folder, by name.
    """
    names = ["bag_id", "nth", "path", "error"]

    def rows(bag: str, splits: list[str]) -> Iterator[tuple]:
        try:
            if not splits:
                inside = fs.LocalFileSystem().get_file_info(fs.FileSelector(_local(bag)))
                splits = sorted(x.path for x in inside if x.path.endswith(".db3"))
                if not splits:
                    yield bag, None, None, "FileNotFoundError: the bag has no split"
            for nth, path in enumerate(splits):
                there = fs.LocalFileSystem().get_file_info(_local(path)).type == fs.FileType.File
                yield bag, nth, path, None if there else "FileNotFoundError: the split is not there"
        except (ValueError, OSError) as e:
            yield bag, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for bag, splits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(bag, splits or [])]
            yield pa.record_batch([pa.array([r[i] for r in out], pa.int32() if n == "nth" else pa.string()) for i, n in enumerate(names)], names=names)

    return bags.where("error is null").select("bag_id", "splits").mapInArrow(run, "bag_id string, nth int, path string, error string")


@dataclass(frozen=True)
class IdRange(InputPartition):
    bag_id: str
    nth: int
    path: str
    low: int
    high: int


def _connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{_local(path).replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


class MessageReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.columns, self.splits, self.ids = columns, json.loads(options["splits"]), int(options.get("range_ids", RANGE_IDS))

    def partitions(self) -> list[IdRange]:
        out = []
        for bag, nth, path in self.splits:
            try:
                db = _connected(path)
                low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()  # two look-ups in the key
                db.close()
            except (sqlite3.Error, ValueError):
                low, high = 0, -1  # the range says why when it is read
                out.append(IdRange(bag, nth, path, low, high))
                continue
            out += [IdRange(bag, nth, path, a, min(a + self.ids, high + 1) - 1) for a in range(low, high + 1, self.ids)] if low is not None else []
        return out or [IdRange("", 0, "", 0, -1)]

    def read(self, r: IdRange) -> Iterator[pa.RecordBatch]:
        kinds = {"bag_id": pa.string(), "seq": pa.int64(), "topic": pa.string(), "msgtype": pa.string(), "storage_ns": pa.int64(), "error": pa.string()}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip(("seq", "topic", "msgtype", "storage_ns", "error"), zip(*rows, strict=True), strict=True)) | {"bag_id": [r.bag_id] * len(rows)}
            return pa.record_batch([pa.array(columns[c], kinds[c]) for c in self.columns], names=self.columns)

        if not r.path:
            return
        try:
            db = _connected(r.path)
            try:
                cursor = db.execute("SELECT m.id, t.name, t.type, m.timestamp FROM messages m JOIN topics t ON t.id = m.topic_id WHERE m.id BETWEEN ? AND ? ORDER BY m.id", (r.low, r.high))
                while rows := cursor.fetchmany(BATCH):
                    if "error" not in self.columns:
                        yield batch([((r.nth << ID_BITS) + i, topic, kind, at, None) for i, topic, kind, at in rows])
            finally:
                db.close()
        except (sqlite3.Error, ValueError) as e:
            if "error" in self.columns:
                yield batch([(r.nth << ID_BITS, None, None, None, f"{type(e).__name__}: {e}")])


class BagMessages(DataSource):
    """``format("bag_messages")``: option ``splits`` is a JSON list of bag, place of the split in it, and path."""

    @classmethod
    def name(cls) -> str:
        return "bag_messages"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> MessageReader:
        return MessageReader(self.options, list(schema.names))


def scan_bag_messages(splits: DataFrame, range_ids: int = RANGE_IDS, errors: bool = False) -> DataFrame:
    """The messages of all splits that are there (``bag_id, nth, path, error``), in one bag's order by ``seq``.

    With ``errors``, ``bag_id, seq, error`` of the ranges that could not be read instead.
    """
    spark = splits.sparkSession
    listed = [tuple(r) for r in splits.where("error is null").select("bag_id", "nth", "path").collect()]  # a row a file, as in any listing
    spark.dataSource.register(BagMessages)
    reader = spark.read.format("bag_messages").option("splits", json.dumps(listed)).option("range_ids", str(range_ids))
    return (reader.schema("bag_id string, seq long, error string") if errors else reader).load()


def scan_bag_sqlite(spark: SparkSession, path: str, range_ids: int = RANGE_IDS) -> DataFrame:
    """The message index of SQLite files, each a bag of its own."""
    from .files import files

    splits = files(spark, path).select(F.col("path").alias("bag_id"), F.lit(0).alias("nth"), "path", F.lit(None).cast("string").alias("error"))
    return scan_bag_messages(splits, range_ids)
