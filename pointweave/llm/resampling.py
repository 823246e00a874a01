"""Importance resampling toward a target corpus, by hashed word runs.

Features of a text are its runs of 1 to 3 words, repeats counted, each in one of ``BUCKETS`` buckets.  A bucket's gain says how
much more often the target has it than the source.  A document's weight is the sum of its features' gains, and Gumbel noise
from a hash of its id makes the draw of the highest scores a weighted draw without replacement that any rerun repeats.

One pass counts the buckets of both corpora (at most BUCKETS rows leave a task, and as many reach the driver),
a second one sums gains.  Both intern the runs of a batch in the table of ``ngram_table``.  The drawn documents get
their ranks from range partitions, so no task holds them all.

Defined results
    * null or wordless text: no features, weight 0; it is not among the documents that can be drawn.
    * null id: the noise is that of an empty id; it loses ties.
    * rows that share an id: each has its own weight and the same noise; ties go to the greater weight, then to more
      features, and repeated rows get ranks of their own.
    * empty target: gains come from its absence (all t and T are 0).  Empty input: no rows.
    * extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import dense_position
from .common import cut_table
from .ngram_table import NgramTable, find_words
from .tokens import slices

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Words that a document needs to be drawn.
LEAST_WORDS = 20


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b, 0):
                total += NgramTable(find_words(part.column(0)), buckets, LONGEST).histogram()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; ``source`` and ``target`` hold ``bucket, n`` (at most so many rows as there are buckets)."""
    both = [np.zeros(buckets), np.zeros(buckets)]
    for counts, df in zip(both, (source, target), strict=True):
        for row in df.collect():
            counts[row["bucket"]] = row["n"]
    s, t = both
    all_s, all_t = float(s.sum()), float(t.sum())
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                words = find_words(part.column(1))
                number, weight = NgramTable(words, len(gain), LONGEST).sums(gain)
                drawn = np.fromiter((noise(i, seed) for i in part.column(0).to_pylist()), np.int64, part.num_rows)
                yield pa.record_batch([part.column(0), *map(pa.array, (np.diff(words.texts), number, weight, weight + drawn))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of all documents; the drawn ones have ranks from 1 on.

    ``percent`` of the documents with enough words are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = cut_table(scores(docs, gain))
    can = F.col("n_words") >= least_words
    wanted = percent * scored.where(can).count() // 100
    keyed = scored.select(
        "*", (~can).cast("int").alias("k1"), (-F.col("score")).alias("k2"), F.col("doc_id").isNull().alias("k3"), F.coalesce("doc_id", F.lit(0)).alias("k4"),
        (-F.col("weight")).alias("k5"), (-F.col("n_features")).alias("k6"), F.monotonically_increasing_id().alias("k7"),
    )
    placed = dense_position(keyed, [f"k{i}" for i in range(1, 8)])
    rank = F.when((F.col("k1") == 0) & (F.col("position") < wanted), F.col("position") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
