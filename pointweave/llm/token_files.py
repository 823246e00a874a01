"""Token ids in binary files of independent zstandard frames, as a Spark data source.

A file is a sequence of data frames, an index frame and a seek table:

* a data frame holds the ids of some whole documents as little-endian unsigned 32-bit integers, compressed by itself, so that any
  zstandard tool turns a file into one flat stream of ids;
* the index frame is a skippable frame with each document's id and number of ids;
* the seek table is the skippable frame of the public seekable format: compressed size, decompressed size and checksum (the low
  half of xxhash64 of the decompressed bytes) of each frame, and a footer from which a reader starts.

Tasks write files of their own range of ids, and the commit writes a manifest with the files' order and totals; files of failed
attempts are in no manifest, so nobody reads them.  A reader seeks: for wanted documents it reads the footer, the seek table and
the index of the files whose range of ids has them, then only the frames that hold them, each checked against its checksum.

Defined results
    * null text: empty, so only the end id.  Null ids come first, in an order of their own (by text).
    * rows that share an id: by a digest of the text; repeated rows all stay.
    * a document longer than a frame has a frame of its own; its ids must fit in a row of Spark.
    * strings of special tokens in a text are ordinary text.  Ids are below 2^31.
    * empty input: a manifest without files, read back as no rows.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .ngram_table import RunTable, Words
from .tokens import slices

SCHEMA = "doc_id long, start long, n_tokens long, tokens array<int>, ids_crc32 long"
MANIFEST = "_manifest.json"
#: Ids in a data frame, from which on it is closed; bytes of a file, likewise.
FRAME_IDS, FILE_BYTES = 1 << 16, 128 << 20
#: Chunks of text whose ids a task remembers, and their longest one.
REMEMBERED, REMEMBERED_BYTES = 400_000, 48
#: Bytes of text that are encoded together, unless one text has more.
SLICE = 1 << 20
#: Magic numbers of the public formats: a skippable frame of ours, that of a seek table, and the seek table's footer.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<u4")])
# Bytes: white space, printable ones, letters, and other printable ones (with and without the apostrophe).
_SPACE, _PRINTED, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRINTED[0x21:0x7F] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = _PRINTED & ~_LETTER
_SIGN_END = _SIGN.copy()
_SIGN_END[ord("'")] = False


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def chunk_starts(raw: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that the tokenizer splits their pieces as it splits the whole.

    A word of the tokenizer never goes on from a printed character to white space, from a letter to another printed ASCII
    character, or back (but for an apostrophe).  Beyond ASCII only two-byte characters are told apart: none from U+00C0 on
    is white space, and those up to U+023F are letters, but for two signs.
    """
    n = len(raw)
    before, lead, follow = (np.zeros(n, np.uint8) for _ in range(3))
    before[1:], lead[2:], follow[:-1] = raw[:-1], raw[:-2], raw[1:]
    two = (lead >= 0xC3) & (lead <= 0xDF) & (before & 0xC0 == 0x80)
    latin_end = _LETTER[before] | (two & (lead <= 0xC8) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))))
    latin_start = _LETTER[raw] | ((raw >= 0xC3) & (raw <= 0xC8) & ~((raw == 0xC3) & ((follow == 0x97) | (follow == 0xB7))))
    return (_SPACE[raw] & (_PRINTED[before] | two)) | (_SIGN[raw] & latin_end) | (latin_start & _SIGN_END[before])


class Encoder:
    """Ids of texts by a tokenizer file.  The different chunks of a batch are found in a table; common ones are remembered."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.end_id = end_id

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        missing = [c for c in chunks if c not in self.known]
        for chunk, found in zip(missing, self.tokenizer.encode_batch_fast([c.decode() for c in missing], add_special_tokens=False), strict=True):
            ids = found.ids
            self.known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        out = [self.known[c] for c in chunks]
        for chunk in missing:
            if len(chunk) > REMEMBERED_BYTES:
                del self.known[chunk]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and each text's first one (with the end as last)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n, data = len(texts), texts.buffers()[2] if len(texts) else None
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        first = chunk_starts(raw)
        first[offsets[:-1][offsets[:-1] < len(raw)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(raw))[: len(start)]
        words = Words(np.append(raw, np.zeros(8, np.uint8)), start, end, np.searchsorted(start, offsets))
        table = RunTable(words, len(start))
        slots, made = table.intern(start, end - start)
        whole, collecting = raw.tobytes(), gc.isenabled()
        gc.disable()  # millions of small objects, none of them in a cycle
        try:
            ids = self._ids([whole[a:b] for a, b in zip(start[made].tolist(), end[made].tolist(), strict=True)])
        finally:
            if collecting:
                gc.enable()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.zeros(table.capacity, np.int64)
        place[slots[made]] = np.arange(len(made))
        kind = place[slots]
        known, known_at, sizes = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, size[kind]
        upto = np.cumsum(sizes)
        flat = known[np.repeat(known_at[kind] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        ends = np.append(0, upto)[words.texts]
        if self.end_id is not None:
            flat, ends = np.insert(flat, ends[1:], self.end_id), ends + np.arange(n + 1)
        return flat, ends


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    return Encoder(path, end_id)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """``doc_id, tokens`` of ``doc_id, text``, in the order and the partitions of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, SLICE):
                flat, ends = encoder(tokenizer, end_id).encode(part.column(1))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens array<int>")


class FileWriter:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.pending: list[bytes] = []
        self.waiting = self.n_ids = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.waiting >= self.frame_ids:
            self._frame()

    def _put(self, packed: bytes, raw: bytes) -> None:
        self.out.write(packed)
        self.n_bytes += len(packed)
        self.entries.append((len(packed), len(raw), checksum(raw)))

    def _frame(self) -> None:
        raw = b"".join(self.pending)
        self._put(self.packer.compress(raw), raw)
        self.pending, self.waiting = [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        index = self.packer.compress(np.array(self.docs, _DOC).tobytes())
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index, b"")
        table = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + _FOOTER.size) + table + _FOOTER.pack(len(self.entries), 1 << 7, FOOTER_MAGIC))
        self.out.close()


class FileReader:
    """Reads one file by seeking; ``frames_read`` counts the data frames that were decompressed."""

    def __init__(self, source, size: int):
        self.source, self.frames_read = source, 0
        count, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != FOOTER_MAGIC or not flags & 1 << 7:
            raise ValueError("the file has no seek table with checksums")
        table = self._at(size - _FOOTER.size - count * _ENTRY.itemsize, count * _ENTRY.itemsize)
        self.entries = np.frombuffer(table, _ENTRY)
        self.places = np.cumsum([0, *self.entries["packed"].tolist()])
        index = self._at(int(self.places[-2]), int(self.entries["packed"][-1]))
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[8:]), _DOC)
        #: The first id of each document in the file, and the first byte of each frame.
        self.starts = np.cumsum([0, *self.docs["n"].tolist()])
        self.frames = np.cumsum([0, *self.entries["size"][:-1].tolist()])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, nth: int) -> bytes:
        self.frames_read += 1
        packed = self._at(int(self.places[nth]), int(self.entries["packed"][nth]))
        raw = zstandard.ZstdDecompressor().decompress(packed, int(self.entries["size"][nth]))
        if checksum(raw) != self.entries["check"][nth]:
            raise ValueError(f"frame {nth} does not agree with its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """Id, first id's place in the file, and ids of the documents, in order; a frame without wanted ones stays unread."""
        rows = np.arange(len(self.docs))
        if wanted is not None:
            rows = np.flatnonzero(np.isin(self.docs["doc_id"], np.fromiter(wanted, np.int64, len(wanted))) & (self.docs["has_id"] == 1))
        owner = np.searchsorted(self.frames, self.starts[rows] * 4, side="right") - 1
        nth, raw = -1, b""
        for row, of in zip(rows.tolist(), owner.tolist(), strict=True):
            low, n = int(self.starts[row]), int(self.docs["n"][row])
            if n and of != nth:
                nth, raw = of, self.frame(of)
            at = low * 4 - int(self.frames[of]) if n else 0
            yield int(self.docs["doc_id"][row]) if self.docs["has_id"][row] else None, low, raw[at : at + 4 * n]


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: their order, names, totals and least and greatest id."""

    files: list[tuple]


@dataclass
class OneFile(InputPartition):
    name: str
    start: int
    size: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = fs.FileSystem.from_uri(self.path)
        where.create_dir(folder, recursive=True)
        part, files, own = TaskContext.get().partitionId(), [], None
        name, low, high = "", None, None

        def close() -> None:
            own.close()
            files.append((part, len(files), name, own.n_ids, len(own.docs), low, high))

        for b in iterator:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("tokens"), strict=True):
                if own is None or own.n_bytes >= FILE_BYTES:
                    if own is not None:
                        close()
                    name, low, high = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids.zst", None, None
                    own = FileWriter(where.open_output_stream(f"{folder}/{name}", compression=None))
                if doc_id is not None:
                    low, high = doc_id if low is None else min(low, doc_id), doc_id if high is None else max(high, doc_id)
                own.add(doc_id, ids.values.to_numpy().astype("<u4").tobytes())
        if own is not None:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, folder = fs.FileSystem.from_uri(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        starts = np.cumsum([0, *(f[3] for f in files)]).tolist()
        listed = [{"name": f[2], "start": s, "n_ids": f[3], "n_docs": f[4], "low": f[5], "high": f[6]} for f, s in zip(files, starts, strict=False)]
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"format": 1, "files": listed}).encode())


class TokenReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], wanted: set[int] | None):
        self.path, self.columns, self.wanted = path, columns, wanted

    def partitions(self) -> list[OneFile]:
        where, folder = fs.FileSystem.from_uri(self.path)
        with where.open_input_stream(f"{folder}/{MANIFEST}") as source:
            files = json.loads(source.read())["files"]
        if self.wanted is not None:
            files = [f for f in files if f["low"] is not None and any(f["low"] <= i <= f["high"] for i in self.wanted)]
        sizes = [x.size for x in where.get_file_info([f"{folder}/{f['name']}" for f in files])] if files else []
        return [OneFile(f["name"], f["start"], n) for f, n in zip(files, sizes, strict=True)] or [OneFile("", 0, 0)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "tokens": pa.list_(pa.int32()), "ids_crc32": pa.int64()}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            made = {"doc_id": [r[0] for r in rows], "start": [partition.start + r[1] for r in rows], "n_tokens": [len(r[2]) // 4 for r in rows]}
            if "ids_crc32" in self.columns:
                made["ids_crc32"] = [zlib.crc32(r[2]) for r in rows]
            if "tokens" in self.columns:
                made["tokens"] = [np.frombuffer(r[2], "<i4") for r in rows]
            return pa.record_batch([pa.array(made[c], kinds[c]) for c in self.columns], names=self.columns)

        if partition.name:
            where, folder = fs.FileSystem.from_uri(self.path)
            with where.open_input_file(f"{folder}/{partition.name}") as source:
                rows, size = [], 0
                for row in FileReader(source, partition.size).documents(self.wanted):
                    rows.append(row)
                    size += len(row[2])
                    if size > 1 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class TokenFrames(DataSource):
    """``format("token_frames")``: options ``path`` and, to read, ``doc_ids`` (a JSON list); a narrower schema reads less."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        wanted = self.options.get("doc_ids")
        return TokenReader(self.options["path"], list(schema.names), None if wanted is None else set(json.loads(wanted)))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"])


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in ranges of ascending ids, sorted; rows of one id may fill many ranges."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"by": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("by"), F.col("nth")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None) -> None:
    """Encodes ``doc_id, text`` and writes the ids to a new folder."""
    docs.sparkSession.dataSource.register(TokenFrames)
    encode(in_order(docs), tokenizer, end_id).write.format("token_frames").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "tokens"), doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The documents of a folder, or those with the given ids; ``start`` counts the ids of all documents before."""
    spark.dataSource.register(TokenFrames)
    known = dict(c.split() for c in SCHEMA.split(", "))
    reader = spark.read.format("token_frames").schema(", ".join(f"{c} {known[c]}" for c in columns))
    if doc_ids is not None:
        reader = reader.option("doc_ids", json.dumps(sorted(set(doc_ids))))
    return reader.load(path)
