"""Best-fit packing of documents into sequences of fixed capacity under conflicts.

Documents longer than the capacity are cut into pieces, so whole texts are packed.  Pieces are dealt by hash
into groups of about ``rows_per_group`` rows (a bound that does not depend on sources or copies), and each
group is packed by itself, longest piece first.  Open bins stand in lists by residual capacity with a bitmap
of the residuals in use; each bin carries a bitmap of its sources and one of its duplicate clusters.
A piece goes to the tightest bin that has room and no conflict: the successor search walks up the
residuals until a compatible bin is found, and a new bin opens only when none is.

Defined results
    * null or wordless text: length 0, no bin (``bin_id`` null, ``slot`` null); such rows pass the packer by.
    * null ids stay null, and all others are exact.
    * null source: conflicts with nothing.  Null cluster: likewise.
    * repeated rows: packed as they come; equal clusters keep them in different bins.
    * a piece as long as the capacity fills a bin of its own.
    * ties in length: by document id, then piece.
    * empty input: no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_count

SCHEMA = "doc_id long, piece int, start long, n_words long, bin_id long, slot int, bin_words long"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, in the order given; items conflict if they share a source or a cluster."""

    def bits(keys: list) -> list[int]:
        seen: dict = defaultdict(list)
        for i, k in enumerate(keys):
            if k is not None:
                seen[k].append(i)
        out, bit = [0] * len(keys), 1
        for members in seen.values():
            if len(members) > 1:  # a lone key cannot conflict and needs no bit
                for i in members:
                    out[i] = bit
                bit <<= 1
        return out

    source_bit, cluster_bit = bits(sources), bits(clusters)
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    has_source: list[int] = []
    has_cluster: list[int] = []
    placed = []
    for length, s, c in zip(lengths, source_bit, cluster_bit, strict=True):
        at, higher = None, in_use >> length << length
        while higher and at is None:
            residual = (higher & -higher).bit_length() - 1
            for k, b in enumerate(by_residual[residual]):
                if not (has_source[b] & s or has_cluster[b] & c):
                    at = (residual, k)
                    break
            else:
                higher &= higher - 1
        if at is None:
            b, residual = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        else:
            residual, k = at
            b = by_residual[residual].pop(k)
            if not by_residual[residual]:
                in_use &= ~(1 << residual)
        has_source[b] |= s
        has_cluster[b] |= c
        if residual > length:
            by_residual[residual - length].append(b)
            in_use |= 1 << (residual - length)
        placed.append(b)
    return placed


def pack(docs: DataFrame, *, length: Column, cluster: Column, capacity: int = 2048, rows_per_group: int = 8192, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row for each piece of each document with its bin; see the module for the cases."""
    if capacity < 1 or rows_per_group < 1:
        raise ValueError("capacity and rows_per_group must be at least 1")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster"), length.cast("long").alias("total"), F.monotonically_increasing_id().alias("nth_row"))
    pieces = (
        base.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / capacity)), F.lit(1).cast("long"))).alias("piece", "nth"))
        .withColumn("start", F.col("nth") * capacity)
        .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("start")))
    )
    n_pieces = base.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)))).first()[0] or 0
    n_groups = max(1, -(-n_pieces // rows_per_group))
    # the row's number deals rows that repeat each other
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "nth_row"), F.lit(n_groups)).cast("long"))

    def pack_group(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = batch["n_words"].to_pylist()
        sources = [s if n < capacity else None for s, n in zip(batch["source"].to_pylist(), lengths, strict=True)]  # a full piece shares its bin with none
        placed = best_fit(lengths, sources, batch["cluster"].to_pylist(), capacity)
        words, slots, grp = Counter(), [], batch["grp"][0].as_py()
        used: Counter = Counter()
        for b, n in zip(placed, lengths, strict=True):
            words[b] += n
            slots.append(used[b])
            used[b] += 1
        columns = {"bin_id": [b * n_groups + grp for b in placed], "slot": slots, "bin_words": [words[b] for b in placed]}
        made = [pa.array(v, pa.int32() if c == "slot" else pa.int64()) for c, v in columns.items()]
        return pa.table([*(batch[c] for c in ("doc_id", "piece", "start", "n_words")), *made], names=["doc_id", "piece", "start", "n_words", *columns])

    packed = pieces.where("n_words > 0").select("doc_id", "source", "cluster", "piece", "start", "n_words", "grp").groupBy("grp").applyInArrow(pack_group, SCHEMA)
    none = {c: F.lit(None).cast("int" if c == "slot" else "long").alias(c) for c in ("bin_id", "slot", "bin_words")}
    blank = pieces.where(~F.coalesce(F.col("n_words") > 0, F.lit(False)))
    return packed.unionByName(blank.select("doc_id", "piece", "start", "n_words", *none.values()))


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """Documents with ``doc_id, text, source``: words are the tokens, equal texts one cluster."""
    return pack(docs, length=word_count(F.col("text")), cluster=F.xxhash64(F.lower(F.col("text"))), capacity=capacity)
