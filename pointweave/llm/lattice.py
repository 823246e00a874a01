"""Embedding near-duplicates by E8 lattice hashing.

Each table projects unit vectors onto 8 random orthonormal directions, scales them, and decodes the point to the nearest
point of the E8 lattice: its home cell.  A vector is also entered in the ``PROBES`` neighbouring cells (of the 240 at
least distance) that its point lies nearest to.  Within a cell every entry is held against the vectors at
home there, in blocks of at most ``BLOCK`` by ``BLOCK`` vectors that are dealt over tasks, by cosine in double
precision; a block emits each vector's number of links and links that join components, no pairs.  Exact copies are one class and
are entered once.

Hashing finds pairs by chance, so recall is below 1; it is measured in the tests (and in the README).  Every
vector is indexed, and no cell is capped.

Defined results
    * null vectors, and vectors that are empty, zero, of another length than ``dim``, or hold null or non-finite
      components: no links, kept, a component of their own.
    * exact copies: linked with each other and with all that any of them links with.
    * null id: takes part in links of others as a vector; its component is null and it is not kept.
    * repeated rows: copies.  Empty input: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

TABLES, PROBES, SCALE, BLOCK, SEED = 4, 6, 6.0, 1024, 20240
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: of D8, or of D8 moved by one half in all coordinates."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    take = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(take[:, None], whole, half)


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    rows = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            rows.append(v)
    rows += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(rows)


@functools.cache
def projections(dim: int, tables: int) -> tuple[list[np.ndarray], np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim] for _ in range(tables)], rng.uniform(0, 1, (tables, 8))


def cell_keys(points: np.ndarray, nth: int) -> np.ndarray:
    """64-bit keys of lattice points in a table; equal keys of different cells only add comparisons."""
    h = ((2 * points).astype(np.int64).view(np.uint64) * _M).sum(axis=-1, dtype=np.uint64) + np.uint64(nth * int(_M[0]) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * _M[1]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _product(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``x @ m`` summed in one order, so that a row's result does not depend on the rows beside it."""
    out = np.zeros((len(x), m.shape[1]))
    for j in range(m.shape[0]):
        out += x[:, j : j + 1] * m[j]
    return out


def entries(unit: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell keys by vector: for each table the home cell, then the probed ones."""
    directions, shifts = projections(unit.shape[1], tables)
    out = []
    for nth, (q, shift) in enumerate(zip(directions, shifts, strict=True)):
        y = _product(unit, q) * scale + shift
        home = nearest_e8(y)
        toward = np.argsort(-_product(y - home, neighbours().T), axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([home[:, None, :], home[:, None, :] + neighbours()[toward]], axis=1)
        out.append(cell_keys(cells, nth))
    return np.stack(out, axis=1)


def _valid(vector: list | None, dim: int) -> bytes | None:
    """A vector's components as bytes, or None if it can't be compared."""
    if vector is None or len(vector) != dim or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64) + 0.0  # no negative zero
    return v.tobytes() if np.isfinite(v).all() and v.any() else None


def unit_rows(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def earliest_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first cell, by table and then by key, that holds both vectors of each pair and is home to one; by their entries."""
    owner, known = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for nth in range(a.shape[1]):
        home_a, home_b = a[:, nth, 0], b[:, nth, 0]
        in_b, in_a = (b[:, nth] == home_a[:, None]).any(axis=1), (a[:, nth] == home_b[:, None]).any(axis=1)
        cell = np.where(in_a & in_b, np.minimum(home_a, home_b), np.where(in_b, home_a, home_b))
        first = ~known & (in_a | in_b)
        owner[first], known = cell[first], known | first
    return owner


def _least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (x, y) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(reps: DataFrame, least: float, tables: int, probes: int, scale: float) -> DataFrame:
    """``a, b, n`` of vectors that meet in a cell and have at least that cosine; ``reps``: rep, copies, raw.

    A block emits what grows with its vectors, not with its links: rows ``a, b`` that join its components, and for each vector
    ``a`` the number ``n`` of vectors (copies included) that it links with here.  A pair that meets in several cells counts in the
    earliest one, and if both are at home there, once.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = entries(unit_rows(b.column(1).to_pylist()), tables, probes, scale)
            n = keys.shape[1] * keys.shape[2]
            home = np.zeros(keys.shape, bool)
            home[:, :, 0] = True
            yield pa.record_batch([pa.array(np.repeat(np.asarray(b.column(0)), n)), pa.array(keys.ravel()), pa.array(home.ravel())], names=["rep", "cell", "home"])

    placed = cut(reps.select("rep", "raw").mapInArrow(place, "rep long, cell long, home boolean"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("h > 0 and n > 1")
    sizes = sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("h") / BLOCK).cast("int").alias("cols"))
    known = placed.join(sizes, "cell")
    # an entry goes to its row of blocks; one at home also to its column of blocks
    left = known.select("cell", "rep", F.pmod(F.xxhash64("rep"), "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"))
    right = known.where("home").select("cell", "rep", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), "cols").cast("int").alias("j"), F.lit(1).alias("side"))
    both = left.unionByName(right).groupBy("cell", "i", "j", "rep").agg(F.max(F.col("side") == 0).alias("row"), F.max(F.col("side") == 1).alias("col"))
    dealt = both.join(reps, "rep").select("cell", "i", "j", "rep", "row", "col", "copies", "raw").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def compare(cells: np.ndarray, cuts: list[int], ids: np.ndarray, row: np.ndarray, col: np.ndarray, copies: np.ndarray, raw: list[bytes]) -> list[np.ndarray]:
        found = []
        unit = unit_rows(raw)
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            r, c = np.flatnonzero(row[at:end]) + at, np.flatnonzero(col[at:end]) + at
            if not (len(r) and len(c)):
                continue
            x, y = np.nonzero(unit[r] @ unit[c].T >= least)
            x, y = r[x], c[y]
            x, y = x[ids[x] != ids[y]], y[ids[x] != ids[y]]
            if not len(x):
                continue
            label = _least_labels(end - at, x - at, y - at)
            joined = np.flatnonzero(label != np.arange(end - at))
            found.append(np.stack([ids[at + joined], ids[at + label[joined]], np.full(len(joined), -1)]))
            here = entries(unit[at:end], tables, probes, scale)
            at_home = (here[:, :, 0] == cells[at]).any(axis=1)
            degree = np.zeros(end - at, np.int64)
            for lo in range(0, len(x), 1 << 16):
                p, q = x[lo : lo + (1 << 16)] - at, y[lo : lo + (1 << 16)] - at
                # both at home: the pair comes twice, in this block or another one of the cell
                own = (earliest_meeting(here[p], here[q]) == cells[at]) & (~at_home[p] | (ids[at + p] < ids[at + q]))
                np.add.at(degree, p[own], copies[at + q[own]])
                np.add.at(degree, q[own], copies[at + p[own]])
            some = np.flatnonzero(degree)
            found.append(np.stack([ids[at + some], np.full(len(some), -1), degree[some]]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def links(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([t.column(k).to_numpy() for k in ("cell", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
            found = compare(key[0], cuts, *(t.column(k).to_numpy() for k in ("rep", "row", "col", "copies")), t.column("raw").to_pylist())
            rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            return pa.record_batch([pa.array(rows[0]), *(pa.array(v, mask=v < 0) for v in rows[1:])], names=["a", "b", "n"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            cell = [t.column(k).to_numpy() for k in ("cell", "i", "j")]
            same = np.logical_and.reduce([c == c[-1] for c in cell])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if whole:
                yield links(t.slice(0, whole))
            kept = t.slice(whole)
        if kept is not None and kept.num_rows:
            yield links(kept)

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, dim: int, least: float = 0.9, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """``vec_id, embedding`` to ``vec_id, n_links, component_id, kept``."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [_valid(v, dim) for v in b.column(1).to_pylist()]
            digests = [hashlib.md5(r).digest() if r else None for r in raw]
            yield pa.record_batch([b.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "digest", "raw"])

    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(clean, "vec_id long, digest binary, raw binary"))
    # classes go by numbers of their own, so any id will do; the numbers are written with them
    classes = cut(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")).withColumn("key", F.monotonically_increasing_id()))
    found = cut(near_links(classes.select(F.col("key").alias("rep"), "copies", "raw"), least, tables, probes, scale))
    degree = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("others"))
    known = components(found.where("b is not null").select("a", "b")).withColumnRenamed("component_id", "part")
    info = classes.select("digest", "key", "rep", "copies").join(degree, F.col("key") == F.col("a"), "left").join(known, F.col("key") == F.col("id"), "left")
    info = info.select("digest", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("part", "key").alias("part"))
    named = info.groupBy("part").agg(F.min("rep").alias("component_id"))  # the smallest id; null ids name none
    info = info.join(named, "part").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", "digest").join(info, "digest", "left")
    component = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
