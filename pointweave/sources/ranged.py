"""Reading parts of files by seeking: point file headers and ranges, and walks over frame headers.

Nothing here holds a whole file.  Files are opened through pyarrow's file systems, from local paths or URIs.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINTS = "cloud_id string, frame_id long, ordinal long, x double, y double, z double, r smallint, g smallint, b smallint, a smallint, intensity double"
#: Bytes of a range, rows of an output batch, bytes of a header at most, and what a header walk reads at once.
RANGE_BYTES, BATCH, HEADER_BYTES, WALK_BYTES = 64 << 20, 65_536, 1 << 20, 4096
#: What a reader reports as a fault of the file.
FAULTS = (ValueError, KeyError, IndexError, OSError, OverflowError, StopIteration, struct.error)

# Fixed values of the formats.
_DTYPES = {("F", 4): "f4", ("F", 8): "f8", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4"}
_PLY = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: A frame's header: id, seconds, count or size.  Points of a frame and bytes of an image, at most.
FRAME_HEAD = struct.Struct("<IdI")
MOST_POINTS, MOST_IMAGE_BYTES = 50_000_000, 256 << 20


def opened(path: str) -> pa.NativeFile:
    """A seekable file."""
    local = re.match(r"(?:file:/*)?(/.*)|file:/*(.*)", path)
    if local:
        return fs.LocalFileSystem().open_input_file(local[1] or f"/{local[2]}")
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def read_at(source, at: int, size: int) -> bytes:
    source.seek(at)
    return source.read(size)


@dataclass(frozen=True)
class Layout:
    """How a point file's body is read: ``fields`` are names, formats and counts, ``n`` records from ``offset`` on."""

    mode: str
    fields: tuple[tuple[str, str, int], ...]
    n: int
    offset: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, f, (c,)) if c > 1 else (n, f) for n, f, c in self.fields])


def pcd_layout(head: bytes) -> Layout:
    """The layout that a PCD header states, ascii or binary."""
    found = re.match(rb"(?s)(.*?^DATA[ \t]+(\w+)[ \t]*\r?\n)", head, re.M)
    if not found:
        raise ValueError("no PCD header")
    said = {k.decode(): v.decode().split() for k, v in re.findall(rb"(?m)^([A-Z]+)[ \t]*([^\r\n]*)", found[1])}
    names = said["FIELDS"]
    repeat = said.get("COUNT") or ["1"] * len(names)
    if not len(names) == len(said["SIZE"]) == len(said["TYPE"]) == len(repeat):
        raise ValueError("FIELDS, SIZE, TYPE and COUNT differ in length")
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("x, y or z is missing")
    mode = found[2].decode()
    if mode not in ("ascii", "binary"):
        raise ValueError(f"DATA {mode} is not read")
    fields = tuple((n, "<" + _DTYPES[k, int(s)], int(c)) for n, s, k, c in zip(names, said["SIZE"], said["TYPE"], repeat, strict=True))
    return Layout(mode, fields, _count(said["POINTS"][0]), found.end())


def ply_layout(head: bytes) -> Layout:
    """The layout of the vertices that a PLY header states, ascii or binary of either byte order; faces are left out."""
    found = re.match(rb"(?s)ply\r?\n.*?end_header\r?\n", head)
    if not found:
        raise ValueError("no PLY header")
    lines = [x.split() for x in found[0].decode("ascii").splitlines() if x.strip()]
    modes = [x[1] for x in lines if x[0] == "format" and len(x) > 1]
    if not modes:
        raise ValueError("no format line")
    order = ">" if modes[0] == "binary_big_endian" else "<"
    fields, count, inside, elements = [], None, False, 0
    for x in lines:
        if x[0] == "element":
            inside, elements = x[1] == "vertex", elements + 1
            if inside:
                count = _count(x[2])
                if elements > 1:
                    raise ValueError("vertices must come first")
        elif inside and x[0] == "property":
            if x[1] == "list":
                raise ValueError("vertices with lists are not read")
            fields.append((x[2], order + _PLY[x[1]], 1))
    if count is None or not {"x", "y", "z"} <= {n for n, _, _ in fields}:
        raise ValueError("x, y or z is missing")
    return Layout("ascii" if modes[0] == "ascii" else "binary", tuple(fields), count, found.end())


def _count(text: str) -> int:
    if int(text) < 0:
        raise ValueError("a negative number of points")
    return int(text)


LAYOUTS = {"pcd": pcd_layout, "ply": ply_layout}


@dataclass(frozen=True)
class Range(InputPartition):
    """Records ``first`` to ``last`` of a binary body, or the lines that start in ``start`` to ``stop`` of an ascii one."""

    path: str
    layout: Layout | None = None
    first: int = 0
    last: int = 0
    start: int = 0
    stop: int = 0
    error: str | None = None


def plan(path: str, kind: str, range_bytes: int) -> list[Range]:
    """The ranges of a file from its header, or one range that carries its fault."""
    try:
        with opened(path) as source:
            size = source.size()
            layout = LAYOUTS[kind](read_at(source, 0, min(size, HEADER_BYTES)))
        if layout.mode == "ascii":
            starts = range(layout.offset, max(size, layout.offset + 1), range_bytes)
            return [Range(path, layout, 0, layout.n, a, min(a + range_bytes, size)) for a in starts]
        record = layout.dtype.itemsize
        if size - layout.offset < layout.n * record:
            raise ValueError("the file is cut short")
        step = max(1, range_bytes // record)
        return [Range(path, layout, a, min(a + step, layout.n), layout.offset + a * record) for a in range(0, max(layout.n, 1), step)]
    except FAULTS as e:
        return [Range(path, error=f"{type(e).__name__}: {e}")]


def lines_between(source, data: int, start: int, stop: int, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The non-blank lines that start in a range, block by block; the last one is read to its end."""
    at, rest = start, b""
    source.seek(max(start - 1, data))
    if start > data:  # the line that runs into the range belongs to the one before
        while (head := source.read(block)) and b"\n" not in head:
            at += len(head)
        cut = head.find(b"\n") + 1
        at, rest = at - 1 + cut, head[cut:]
        if not head:
            return
    while True:
        read = source.read(block)
        lines = (rest + read).split(b"\n")
        rest = lines.pop() if read else b""
        out = []
        for line in lines:
            if at >= stop:
                break
            if line.strip():
                out.append(line)
            at += len(line) + 1
        if out:
            yield out
        if at >= stop or not read:
            return


def parsed(lines: list[bytes], layout: Layout) -> np.ndarray:
    """Records of ascii lines; a line that lacks a value or holds no number is a fault."""
    dtype = layout.dtype
    rows = [line.split() for line in lines]
    if any(len(r) < sum(c for _, _, c in layout.fields) for r in rows):
        raise ValueError("a line lacks values")
    out, at = np.zeros(len(rows), dtype), 0
    for name, form, count in layout.fields:
        number = float if "f" in form else lambda v: int(float(v))
        out[name] = [number(r[at]) for r in rows] if count == 1 else [[number(v) for v in r[at : at + count]] for r in rows]
        at += count
    return out


def first_bad(lines: list[bytes], layout: Layout) -> tuple[int, str] | None:
    """The first line that can't be parsed, and why."""
    try:
        parsed(lines, layout)
    except FAULTS as e:
        if len(lines) == 1:
            return 0, f"{type(e).__name__}: {e}"
        half = len(lines) // 2
        found = first_bad(lines[:half], layout)
        if found:
            return found
        at, why = first_bad(lines[half:], layout) or (0, "")
        return half + at, why
    return None


def colours(rec: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Packed colours as r, g and b, long names as short ones."""
    packed = rec.pop("rgba", None) if "rgba" in rec else rec.pop("rgb", None)
    if packed is not None:
        v = packed.astype(np.float32).view(np.uint32) if packed.dtype.kind == "f" else packed.astype(np.uint32)
        rec |= {"r": v >> 16 & 255, "g": v >> 8 & 255, "b": v & 255}
    return {({"red": "r", "green": "g", "blue": "b", "alpha": "a"}.get(k, k)): v for k, v in rec.items()}


def point_batch(cloud: str, rec: dict[str, np.ndarray], first: int, frame: int = 0) -> pa.RecordBatch:
    n = len(rec["x"])
    full = lambda v, t: pa.array(np.full(n, v, t))
    colour = [pa.array(rec[c].astype(np.int16)) if c in rec else full(d, np.int16) for c, d in zip("rgba", (205, 215, 225, 255), strict=True)]
    intensity = pa.array(rec["intensity"].astype(np.float64)) if "intensity" in rec else pa.nulls(n, pa.float64())
    return pa.record_batch([pa.array([cloud] * n, pa.string()), full(frame, np.int64), pa.array(np.arange(first, first + n)), *[pa.array(rec[c].astype(np.float64)) for c in "xyz"], *colour, intensity], names=[f.split()[0] for f in POINTS.split(", ")])


def point_batches(cloud: str, rec: dict[str, np.ndarray], first: int = 0, frame: int = 0) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rec["x"]), BATCH):
        yield point_batch(cloud, {k: v[at : at + BATCH] for k, v in rec.items()}, first + at, frame)


def _columns(rec: np.ndarray) -> dict[str, np.ndarray]:
    return colours({n: rec[n].astype(rec[n].dtype.newbyteorder("=")) for n in rec.dtype.names if rec[n].ndim == 1})


def read_records(source, dtype: np.dtype, at: int, n: int) -> Iterator[np.ndarray]:
    """n records from a place on, in batches."""
    source.seek(at)
    while n:
        take = min(n, BATCH)
        raw = source.read(take * dtype.itemsize)
        if len(raw) < take * dtype.itemsize:
            raise ValueError("the file is cut short")
        yield np.frombuffer(raw, dtype)
        n -= take


class CloudReader(DataSourceReader):
    """Ranges of point files.  ``lines`` states, for ascii files of several ranges, each range's first record; ``skip`` the faulty ones."""

    def __init__(self, options: dict, columns: list[str]):
        self.columns, self.kind, self.range_bytes = columns, options["kind"], int(options.get("range_bytes", RANGE_BYTES))
        self.paths, self.skip = json.loads(options["paths"]), set(json.loads(options.get("skip", "[]")))
        self.lines = {(p, s): n for p, s, n in json.loads(options.get("lines", "[]"))}

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(16) as pool:
            ranges = [r for found in pool.map(lambda p: plan(p, self.kind, self.range_bytes), self.paths) for r in found if r.path not in self.skip]
        return [replace(r, first=self.lines.get((r.path, r.start), r.first)) for r in ranges] or [Range("", error="")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.columns[-1] == "error":
            return iter([self.checked(partition)] if partition.path else [])
        return iter(()) if partition.error is not None else self.points(partition)

    def checked(self, r: Range) -> pa.RecordBatch:
        """One row: the lines of an ascii range, the first one that can't be parsed, the records that the file needs, and the fault."""
        n, bad, error = 0, None, r.error
        is_ascii = r.layout is not None and r.layout.mode == "ascii"
        if error is None and is_ascii:
            try:
                with opened(r.path) as source:
                    for lines in lines_between(source, r.layout.offset, r.start, r.stop):
                        if bad is None and (found := first_bad(lines, r.layout)):
                            bad, error = n + found[0], found[1]
                        n += len(lines)
            except FAULTS as e:
                error = f"{type(e).__name__}: {e}"
        known = {"cloud_id": (r.path, pa.string()), "start": (r.start, pa.int64()), "lines": (n, pa.int64()), "bad": (bad, pa.int64()), "wanted": (r.layout.n if is_ascii else None, pa.int64()), "error": (error, pa.string())}
        return pa.record_batch([pa.array([known[c][0]], known[c][1]) for c in self.columns], names=self.columns)

    def points(self, r: Range) -> Iterator[pa.RecordBatch]:
        with opened(r.path) as source:
            if r.layout.mode == "binary":
                first = r.first
                for rec in read_records(source, r.layout.dtype, r.start, r.last - r.first):
                    yield point_batch(r.path, _columns(rec), first)
                    first += len(rec)
                return
            left, first = r.layout.n - r.first, r.first
            for lines in lines_between(source, r.layout.offset, r.start, r.stop):
                for at in range(0, min(len(lines), max(left, 0)), BATCH):
                    rec = parsed(lines[at : min(at + BATCH, left)], r.layout)
                    yield point_batch(r.path, _columns(rec), first + at)
                left, first = left - len(lines), first + len(lines)


class PointFiles(DataSource):
    """``format("point_files")``: options ``paths`` (a JSON list), ``kind`` (pcd, ply), ``range_bytes``, ``lines`` and ``skip``.

    The schema is POINTS, or a choice of ``cloud_id, start, lines, bad, wanted, error`` with ``error`` last to check the files.
    """

    @classmethod
    def name(cls) -> str:
        return "point_files"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> CloudReader:
        return CloudReader(self.options, list(schema.names))


def walk(source, size: int, record: int, least_count: int = 0, most_count: int = MOST_POINTS) -> tuple[list[tuple[int, float, int, int]], int]:
    """Id, seconds, count and payload offset of the frames before the first bad one, and where that one starts (the size if none is bad).

    Only headers are read, a few kilobytes at a time where frames are small; payloads of ``record`` bytes a count are skipped.
    """
    out, at, held, held_at = [], 0, b"", 0
    while at + FRAME_HEAD.size <= size:
        if not held_at <= at <= held_at + len(held) - FRAME_HEAD.size:
            held, held_at = read_at(source, at, WALK_BYTES), at
        frame, seconds, count = FRAME_HEAD.unpack_from(held, at - held_at)
        end = at + FRAME_HEAD.size + count * record
        if not (math.isfinite(seconds) and seconds >= 0) or not least_count <= count <= most_count or end > size:
            break
        out.append((frame, seconds, count, at + FRAME_HEAD.size))
        at = end
    return out, at


def _good_prefix(source, size: int, frames: list[tuple], end: int) -> tuple[int, bool, list[tuple], int]:
    """Frames up to the last one with points, how many have some, and whether a header that goes on in time follows them."""
    while frames and not frames[-1][2]:
        end = frames.pop()[3] - FRAME_HEAD.size
    head = read_at(source, end, FRAME_HEAD.size) if frames and end + FRAME_HEAD.size <= size else b""
    follows = len(head) == FRAME_HEAD.size and frames[-1][1] <= FRAME_HEAD.unpack(head)[1] < frames[-1][1] + 86_400
    return sum(1 for f in frames if f[2]), follows, frames, end


def frame_walk(source, size: int) -> tuple[int, list[tuple[int, float, int, int]], str | None]:
    """Record size (16 or 15 bytes), frames and fault.

    The size is the one that fits the whole file; else the one with more good frames before the bad tail, or the
    one whose tail begins with a header that goes on in time.
    """
    tried = []
    for record in (16, 15):
        frames, end = walk(source, size, record)
        if end == size and any(f[2] for f in frames):
            return record, frames, None
        tried.append((*_good_prefix(source, size, frames, end), record))
    n, _, frames, end, record = max(tried, key=lambda t: (t[0], t[1], t[4]))
    return record, frames, f"ValueError: no whole frame at byte {end if n else 0} of {size}"
