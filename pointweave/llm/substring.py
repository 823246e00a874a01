"""Substring deduplication: seed and extend on winnowed anchors.

A window is ``LENGTH`` consecutive words.  Every window owns one anchor: of the ``SEED``-word seeds inside it, the one
of least hash (the leftmost of equals), so that equal windows own equal anchors at equal offsets and a text has about one anchor
for each 20 words.

1. Seeds.  Anchors of all documents meet by hash; anchors of one document only are dropped.
2. Extension of whole reaches.  The reach of an anchor is the text from the first to the last window that owns
   it, i.e. as far as it can extend both ways.  Occurrences with equal reaches form a class, and each is a
   repeat of the class's smallest document at full length: one row a class, however many copies there are.
3. Extension of partial reaches.  Where the classes of an anchor differ, one document of each class extends
   the anchor word by word; its windows, as fingerprints, meet those of the other classes, and the smallest document
   of each window is found by a pre-aggregated minimum.
4. Windows that also start in a smaller document join to maximal repeats, the words of which are removed.

No step pairs occurrences with each other, so a passage in a third of all documents costs one row an occurrence.

Defined results
    * null, empty or short text (fewer than LENGTH words): nothing removed.
    * a passage repeated in one document only: kept.  Exact copies: the smallest id keeps its words.
    * null id: never removed from, never the reason for a removal.
    * rows that share an id: each is judged by its own text, their windows count for the one id.
    * empty input: no rows.  ``remove_repeats`` reads no extra columns; ``without_repeats`` keeps all columns.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bitmap_split, cut, cut_table, fresh

#: Words of a window, and of a seed.
LENGTH, SEED = 50, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX, _S31 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BACK):
        p = np.full(size, base)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Words:
    """Hashes of any run of words of one text in constant time, from the hashes of its words."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        powers, self.back = _powers(max(1 << 14, 1 << n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start up to end."""
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        h = (h ^ (h >> _S31)) * _MIX
        return h ^ (h >> _S31)

    def anchors(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Seed position, seed hash, first and last owning window of each anchor."""
        none = np.zeros(0, np.int64)
        if self.n < length:
            return none, none.view(np.uint64), none, none
        at = np.arange(self.n - seed + 1)
        seeds = self.runs(at, at + seed)
        width = length - seed + 1
        owner = np.lib.stride_tricks.sliding_window_view(seeds, width).argmin(axis=1) + np.arange(self.n - length + 1)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        return owner[first], seeds[owner[first]], first, last


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, part, text``: rows of one id differ in ``part`` if they differ in text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("part"), "text")


def _columns(parts: list[list[np.ndarray]], kinds: Sequence[type], names: Sequence[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c).astype(k)) for c, k in zip(parts, kinds, strict=True)], names=list(names))


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """``doc, part, anchor, reach, first, last``: all anchors; first and last are window starts."""
    names = ["doc", "part", "anchor", "reach", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch in tokens.slices(b, 2):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                hashes, ends = tokens.word_hashes(batch.column(2))
                for doc, part, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True):
                    if hi - lo < length:
                        continue
                    own = Words(hashes[lo:hi])
                    at, anchor, first, last = own.anchors(length, seed)
                    if not len(at):
                        continue
                    # the offset of the seed tells apart reaches of equal words but other windows
                    reach = own.runs(first, last + length) + (at - first).astype(np.uint64) * _MIX
                    for column, values in zip(columns, (np.full(len(at), doc), np.full(len(at), part), anchor.view(np.int64), reach.view(np.int64), first, last), strict=True):
                        column.append(values)
                if columns[0]:
                    yield _columns(columns, [np.int64] * 4 + [np.int32] * 2, names)

    return _keyed(docs).where(F.col("doc").isNotNull()).mapInArrow(run, "doc long, part long, anchor long, reach long, first int, last int")


def _windows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``doc, part, anchor, window, start`` of all windows of the wanted anchors (``doc, part, anchor, first, last``)."""
    names = ["doc", "part", "anchor", "window", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch in tokens.slices(b, 2):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                hashes, ends = tokens.word_hashes(batch.column(2))
                for doc, part, lo, hi, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1], ends[1:], batch.column(3).to_pylist(), strict=True):
                    own = Words(hashes[lo:hi])
                    for x in listed:
                        start = np.arange(x["first"], min(x["last"], own.n - length) + 1)
                        for column, values in zip(columns, (np.full(len(start), doc), np.full(len(start), part), np.full(len(start), x["anchor"]), own.runs(start, start + length).view(np.int64), start), strict=True):
                            column.append(values)
                if columns[0]:
                    yield _columns(columns, [np.int64] * 4 + [np.int32], names)

    listed = wanted.groupBy("doc", "part").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("listed"))
    maybe, _ = bitmap_split(_keyed(docs), "doc", listed)
    return maybe.join(listed, ["doc", "part"]).select("doc", "part", "text", "listed").mapInArrow(run, "doc long, part long, anchor long, window long, start int")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc, part, spans``: for each text with windows that a smaller document has too, their first and last starts."""
    seeds = cut_table(_seeds(docs, length, seed))
    shared = seeds.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("reach").alias("r_low"), F.max("reach").alias("r_high")).where("low < high")
    shared = cut_table(shared.select("anchor", (F.col("r_low") != F.col("r_high")).alias("differ")))
    found = cut_table(seeds.join(shared, "anchor"))
    classes = found.groupBy("anchor", "reach").agg(F.min("doc").alias("lead"))
    placed = found.join(classes, ["anchor", "reach"])
    whole = placed.where("doc > lead").select("doc", "part", "first", "last")
    leads = placed.where("doc = lead and differ").select("doc", "part", "anchor", "first", "last")
    windows = cut_table(_windows(docs, leads, length))
    least = windows.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    partial = windows.join(least, ["anchor", "window"]).where("doc > least").select("doc", "part", F.col("start").alias("first"), F.col("start").alias("last"))
    # a set, so that repeated rows add nothing
    return cut(whole.unionByName(partial).groupBy("doc", "part").agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def covered(spans: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Which of n words lie in the given windows."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[min(s["last"] + length, n)] -= 1
    return np.cumsum(edge[:n]) > 0


def _with_spans(docs: DataFrame, found: DataFrame, key: str) -> tuple[DataFrame, str]:
    """Documents with their spans (null for none), and that column's name; only documents that may have some are shuffled."""
    doc, part, spans = (fresh(docs, c) for c in ("__doc", "__part", "__spans"))
    found = found.select(F.col("doc").alias(doc), F.col("part").alias(part), F.col("spans").alias(spans))
    maybe, never = bitmap_split(docs, key, found.withColumnRenamed(doc, key))
    hit = maybe.join(found, (maybe[key] == found[doc]) & (F.xxhash64(maybe["text"]) == found[part]), "left").drop(doc, part)
    return hit.unionByName(never.withColumn(spans, F.lit(None).cast(found.schema[spans].dataType))), spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``; the digest is of the kept words joined by one space."""
    found = repeats(docs, length, seed)
    rows, spans_col = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), found, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, digests = [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = split_words(text.as_py())
                gone = 0
                if spans:
                    out = covered(spans, len(words), length)
                    gone = int(out.sum())
                    words_kept = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                else:
                    words_kept = words
                counts.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words_kept)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", spans_col).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, spans: list[dict], length: int) -> str:
    """A text without the words of the spans; the space before each removed word goes with it."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out = covered(spans, len(at), length).tolist()
    kept, end = [], 0
    for (start, stop), gone in zip(at, out, strict=True):
        if not gone:
            kept.append(raw[end:stop])
        end = stop
    kept.append(raw[end:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents with all columns, their texts cut; a text of which no word stays goes, a clean one is unchanged."""
    rows, spans_col = _with_spans(docs, repeats(docs, length, seed), "doc_id")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_text(t, s, length) for t, s in zip(b.column("text").to_pylist(), b.column(spans_col).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.record_batch(columns, names=names)

    changed = rows.where(F.col(spans_col).isNotNull() & F.col("text").isNotNull()).mapInArrow(run, docs.schema)
    changed = changed.where(F.regexp_like("text", F.lit("[^ \\t-\\r]")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    same = rows.where(F.col(spans_col).isNull() | F.col("text").isNull()).select(*docs.columns)
    return same.unionByName(changed)
