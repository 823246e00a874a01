"""N-gram Jaccard self-join by prefix filters under several global token orders.

Sets are the distinct k-word shingles of a text.  Two sets of Jaccard similarity t share at least ``ceil(t n)``
tokens of either, so under any global order of tokens their prefixes must meet; and if prefixes are lengthened
by l tokens, they must meet in l of them.

1. Texts with equal sets form a class; only its smallest id goes on (copies are never paired).
2. Order by token hash.  A prefix must hold l tokens that the prefix of another class holds too; documents with
   fewer have no partner and leave.  This is one counted join of tokens, without pairs.
3. What is left gets prefixes under two independent orders, each with the tokens that step 2 found frequent moved to the
   end.  Each order splits the documents that may still be partners into finer groups (``refine``): a group is what shared
   prefix tokens connect, less each document's l - 1 most frequent ones.  The next order splits only within the
   groups of the one before, so the groups are the intersection of the filters.  Documents alone in a group leave.
4. Groups are verified in blocks of bounded documents and bytes.  In a block, two documents of
   different components that fit in size and share prefix tokens under both orders are compared by exact counts; only
   links that join two components leave it.
5. A group of several blocks is first searched inside its blocks, then between the components found (one
   document of each), and then block by block, where documents of one component lie together and blocks of one and the same
   component never meet.

No pair is emitted but such links, and no other pair can join two components, so components are exact.

Defined results
    * null, empty or blank text: no shingles, linked with nothing, its own component.
    * fewer words than k: the whole word sequence is the one shingle.
    * null id: no part in links; component null.  Rows that share an id are one node of the graph.
    * repeated rows: each returned, with equal results.  Empty input: no rows.
    * ties: the smallest id names a component.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, bitmap_split, cut_table
from .components import components

#: Frequent tokens that are moved to the end of both orders, at most.
FREQUENT = 100_000
#: l, the tokens that prefixes of similar sets must share, is half of what a set may lack, or this if it is more.
LEAST_SHARED = 6
#: Documents, and bytes of text unless one text has more, of a block's side.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(hashes) - k + 1
    h = hashes[:n].copy()
    for i in range(1, k):
        h = (h ^ (h >> _S29)) * _M1 + hashes[i : n + i]
    h = (h ^ (h >> _S32)) * _M2
    return h ^ (h >> _S29)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; A-Z are lowered, words end at ASCII white space."""
    hashes, at = tokens.word_hashes(texts, lower=True)
    whole = rolled(hashes, k) if len(hashes) >= k else hashes[:0]
    bounds = at.tolist()
    return [np.unique(whole[a : b - k + 1] if b - a >= k else rolled(hashes[a:b], b - a) if b > a else hashes[:0]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def order_b(own: np.ndarray) -> np.ndarray:
    """The rank of tokens in the second global order."""
    return (own ^ (own >> _S32)) * _M3


def _may_miss(n, percent: int):
    """Tokens of a set of n that a partner may lack."""
    return n - (-(-(n * percent) // 100))


def long_prefix(n: int, percent: int) -> int:
    """The tokens of a set of n that its prefix holds; none if no other set can be similar to it."""
    if 100 * n < percent * (n + 1):
        return 0
    miss = _may_miss(n, percent)
    return miss + max(min(LEAST_SHARED, n - miss), miss // 2)


def _needed(n: Column, percent: int) -> Column:
    """Shared tokens that the long prefix of a set of n must hold: l for its smallest partner."""
    smallest = F.ceil(n * percent / 100)
    similar = F.ceil(smallest * percent / 100)
    return F.greatest(F.least(F.lit(LEAST_SHARED), similar), F.floor((smallest - similar) / 2))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, prefix``: size and digest of each set and its long prefix under the order by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tokens.slices(whole, 1):
                sets = shingle_sets(b.column(1), k)
                digest = np.frombuffer(b"".join(hashlib.md5(own.tobytes()).digest() for own in sets), np.int64).reshape(-1, 2)
                first = _lists([own[: long_prefix(len(own), percent)] for own in sets])
                yield pa.record_batch([b.column(0), pa.array([len(own) for own in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), first], names=["doc_id", "n", "s1", "s2", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>")


def in_orders(own: np.ndarray, is_late: np.ndarray, rank_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` of a set's sorted tokens under either order; the late ones come last."""
    soon, late = own[~is_late], own[is_late]
    b = np.concatenate([soon[np.argsort(rank_b[~is_late], kind="stable")], late[np.argsort(rank_b[is_late], kind="stable")]])
    return np.concatenate([soon, late])[:size], b[:size]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    return known[np.searchsorted(known, values).clip(0, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def candidates(docs: DataFrame, late, k: int, percent: int) -> DataFrame:
    """``doc, n, n_bytes, a, b``: the long prefixes of each set under both orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 1):
                sets = shingle_sets(batch.column(1), k)
                two = [in_orders(own, among(own, late.value), order_b(own), long_prefix(len(own), percent)) for own in sets]
                n_bytes = pc.binary_length(batch.column(1)).cast(pa.int64())
                yield pa.record_batch([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), n_bytes, _lists([a for a, _ in two]), _lists([b for _, b in two])], names=["doc", "n", "n_bytes", "a", "b"])

    return docs.mapInArrow(run, "doc long, n long, n_bytes long, a array<long>, b array<long>")


def size_class(n: Column, percent: int) -> Column:
    """Sets of similar texts are of equal or neighbouring size classes."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / min(percent, 99))) + 1e-9).cast("int")


def refine(members: DataFrame, needs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, grp`` of the documents that may have partners within their group, in finer groups.

    ``members`` has ``grp, doc, size, token`` and ``needs`` the least number of shared tokens (``doc, need``).  Only tokens count that
    documents of equal or neighbouring size classes share.  A document that must share so many may leave out its need - 1
    most frequent ones: if all it shares with a partner are ranked by frequency, the rarest one stays with both.
    A token ties its documents to the smallest one of their size class and of the class below.
    """
    by_size = members.groupBy("grp", "token", "size").agg(F.count("*").alias("df"), F.min("doc").alias("leader"))
    # as many entries as size classes have the token: a number that the length of texts bounds
    shared = by_size.groupBy("grp", "token").agg(F.sum("df").alias("df"), F.collect_list(F.struct("size", "df", "leader")).alias("sizes")).where("df > 1")
    near = F.filter("sizes", lambda x: F.abs(x["size"] - F.col("size")) <= 1)
    rows = members.join(shared, ["grp", "token"]).withColumn("near", near).where(F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x["df"]) > 1)
    leaders = F.transform(F.filter("near", lambda x: x["size"] <= F.col("size")), lambda x: x["leader"])
    held = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token", leaders.alias("leaders")))).alias("t"))
    kept = held.join(needs, "doc").where(F.size("t") >= F.col("need"))
    first = F.slice("t", F.lit(1), F.size("t") - F.col("need").cast("int") + 1)
    edges = scratch.cut(kept.select("doc", F.array_sort(F.array_distinct(F.flatten(F.transform(first, lambda x: x["leaders"])))).alias("leaders")))
    least = F.col("leaders")[0]
    pairs = edges.select(F.explode(F.concat(F.array("doc"), "leaders")).alias("a"), least.alias("b"))
    known = components(pairs)
    found = edges.select(F.col("doc").alias("id")).join(known, "id").select(F.col("id").alias("doc"), F.col("component_id").alias("grp"))
    several = found.groupBy("grp").agg(F.count("*").alias("c")).where("c > 1").select("grp")
    return scratch.cut(found.join(several, "grp"))


def block_links(ids: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], late: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between left and right documents that join different components; ``comps`` are the known ones."""
    n = np.array([len(x) for x in sets], np.int64)
    if (n == 0).any():  # another row of a document's id may have no words
        some = n > 0
        ids, comps, left, right, n, sets = ids[some], comps[some], left[some], right[some], n[some], [x for x in sets if len(x)]
    if len(ids) < 2 or not left.any() or not right.any():
        return []
    kinds, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.split(where, np.cumsum(n)[:-1])
    is_late, rank_b = among(kinds, late), order_b(kinds)
    two = [in_orders(x, is_late[x], rank_b[x], _may_miss(len(x), percent) + 1) for x in own]
    flats = [np.concatenate(x) for x in zip(*two, strict=True)]
    at = [np.cumsum([0, *map(len, x)])[:-1] for x in zip(*two, strict=True)]
    own = [np.append(x[count[x] > 1], len(kinds)) for x in own]  # tokens of one document are never shared; the mark of the end stays off
    flat, ends = np.concatenate(own), np.cumsum([0, *map(len, own)])
    mark = np.zeros(len(kinds) + 1, bool)
    root = np.unique(comps, return_inverse=True)[1]
    found, index, both_sides = [], np.arange(len(ids)), left & right
    for x in np.flatnonzero(left):
        maybe = right & (root != root[x]) & (n * 100 >= n[x] * percent) & (n[x] * 100 >= n * percent)
        if both_sides[x]:
            maybe &= ~both_sides | (index > x)
        for order in (0, 1):
            if not maybe.any():
                break
            mark[two[x][order]] = True
            maybe &= np.logical_or.reduceat(mark[flats[order]], at[order])
            mark[two[x][order]] = False
        rows = np.flatnonzero(maybe)
        if not len(rows):
            continue
        mark[own[x][:-1]] = True
        if len(rows) > 64:
            shared = np.add.reduceat(mark[flat], ends[:-1], dtype=np.int64)[rows]
        else:
            shared = np.array([np.count_nonzero(mark[own[y]]) for y in rows])
        mark[own[x][:-1]] = False
        for y in rows[100 * shared >= percent * (n[x] + n[rows] - shared)]:
            if root[y] != root[x]:
                found.append((int(ids[x]), int(ids[y])))
                root[root == root[y]] = root[x]
    return found


def verified(dealt: DataFrame, docs: DataFrame, late, k: int, percent: int) -> DataFrame:
    """``a, b``: the links found in blocks (``block, doc, comp, left, right``) of the documents (``doc, text``)."""
    rows = dealt.join(docs, "doc").select("block", "doc", "comp", "left", "right", "text").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, sets = None, [], []

        def found() -> pa.RecordBatch:
            links: list = []
            if own:
                ids, comps, left, right = (np.concatenate(x) for x in zip(*own, strict=True))
                links = block_links(ids, comps, left, right, sets, late.value, percent)
            return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for whole in batches:
            for b in tokens.slices(whole, 5):
                block, *columns = (np.asarray(b.column(c)) if c in (0, 1, 2) else b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
                texts = shingle_sets(b.column(5), k)
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if at != block[lo]:
                        yield found()
                        at, own, sets = block[lo], [], []
                    own.append([c[lo:hi].copy() for c in columns])
                    sets.extend(texts[lo:hi])
        yield found()

    return rows.mapInArrow(run, "a long, b long")


def _pieces(rows: Column, n_bytes: Column) -> Column:
    """How many blocks such rows need."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n_bytes / BLOCK_BYTES)).cast("int")


def grid(placed: DataFrame) -> DataFrame:
    """``block, doc, comp, left, right``: the blocks that compare the components of each group; ``placed``: grp, size, doc, comp, n_bytes.

    Documents of a size class lie together, and those of a component that is large there have chunks of their own.  Two chunks
    meet if their size classes are equal or neighbours, unless all documents of both are of one component.
    """
    key = ["grp", "size"]
    comps = placed.groupBy(*key, "comp").agg(_pieces(F.count("*"), F.sum("n_bytes")).alias("parts"), F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
    rest = comps.where("parts = 1").groupBy(*key).agg(_pieces(F.sum("c"), F.sum("b")).alias("bins"))
    comps = comps.join(rest, key, "left").select(*key, "comp", "parts", "bins")
    chunk = F.when(F.col("parts") > 1, F.xxhash64("comp", F.pmod(F.xxhash64("doc"), "parts"))).otherwise(F.pmod(F.xxhash64("comp"), "bins").cast("long"))
    at = placed.join(comps, [*key, "comp"]).select(*key, "doc", "comp", chunk.alias("chunk"))
    chunks = at.groupBy(*key, "chunk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = chunks.select("grp", *[F.col(c).alias(f"{c}2") for c in ("size", "chunk", "low", "high")])
    met = chunks.join(other, "grp").where("(size2 = size + 1 or size2 = size and chunk <= chunk2) and not (low = high and low2 = high2 and low = low2)")
    met = met.select(*key, "chunk", "size2", "chunk2")
    block = F.xxhash64("grp", "size", "chunk", "size2", "chunk2").alias("block")
    same = (F.col("size") == F.col("size2")) & (F.col("chunk") == F.col("chunk2"))
    own = at.join(met, [*key, "chunk"]).select(block, "doc", "comp", F.lit(True).alias("left"), same.alias("right"))
    partner = at.withColumnsRenamed({"size": "size2", "chunk": "chunk2"}).join(met.where(~same), ["grp", "size2", "chunk2"]).select(block, "doc", "comp", F.lit(False).alias("left"), F.lit(True).alias("right"))
    return own.unionByName(partner)


def group_links(groups: DataFrame, sizes: DataFrame, docs: DataFrame, late, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: links that make the components of all documents in ``groups`` (``doc, grp``); ``sizes``: doc, size, n_bytes."""
    both = F.lit(True)
    known = groups.join(sizes, "doc")
    parts = known.groupBy("grp").agg(_pieces(F.count("*"), F.sum("n_bytes")).alias("parts"))
    by_size = known.groupBy("grp", "size").agg(_pieces(F.count("*"), F.sum("n_bytes")).alias("own_parts"))
    block = F.when(F.col("parts") == 1, F.xxhash64("grp")).otherwise(F.xxhash64("grp", "size", F.pmod(F.xxhash64("doc"), "own_parts")))
    placed = scratch.cut(known.join(parts, "grp").join(by_size, ["grp", "size"]).withColumn("block", block))
    texts, _ = bitmap_split(docs, "doc", placed)
    texts = scratch.cut(texts)
    one = placed.groupBy("block", "doc").agg(F.lit(1)).select("block", "doc", F.col("doc").alias("comp"), both.alias("left"), both.alias("right"))
    links = scratch.cut(verified(one, texts, late, k, percent))
    large = placed.where("parts > 1").drop("parts", "own_parts")
    if large.isEmpty():
        return links

    def with_comp(links: DataFrame) -> DataFrame:
        found = components(links).select(F.col("id").alias("doc"), "component_id")
        return scratch.cut(large.join(found, "doc", "left").withColumn("comp", F.coalesce("component_id", "doc")).drop("component_id"))

    leads = with_comp(links).groupBy("grp", "block", "comp").agg(F.count("*").alias("c"), F.min(F.struct("doc", "n_bytes")).alias("lead")).where("c > 1").select("grp", "comp", "lead.doc", "lead.n_bytes")
    parts = leads.groupBy("grp").agg(_pieces(F.count("*"), F.sum("n_bytes")).alias("parts"))
    dealt = leads.join(parts, "grp").select(F.xxhash64("grp", F.pmod(F.xxhash64("doc"), "parts")).alias("block"), "doc", "comp", both.alias("left"), both.alias("right"))
    links = links.unionByName(scratch.cut(verified(dealt, texts, late, k, percent)))
    return links.unionByName(scratch.cut(verified(grid(with_comp(links)), texts, late, k, percent)))


def similar_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: similarity is at least ``percent`` hundredths."""
    spark = docs.sparkSession
    first, scratch = Scratch(spark), Scratch(spark)
    with_prefix = first.cut(prefixes(docs, k, percent))
    base = cut_table(with_prefix.drop("prefix"))
    some = base.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut_table(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    held = with_prefix.where("doc_id is not null").select("doc_id", "s1", F.explode("prefix").alias("token"))
    counted = held.groupBy("token").agg(F.count("*").alias("df"), F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high")
    counted = first.cut(counted.select("token", "df"))  # tokens of several classes
    most = max(64, (counted.agg(F.sum("df")).first()[0] or 0) // FREQUENT)
    frequent = counted.where(F.col("df") > most).select("token").toArrow().column(0).to_numpy()  # fewer than FREQUENT rows
    late = spark.sparkContext.broadcast(np.sort(frequent.astype(np.int64).view(np.uint64)))
    needs = classes.select(F.col("rep").alias("doc"), _needed(F.col("n"), percent).alias("need")).groupBy("doc").agg(F.min("need").cast("int").alias("need"))
    held = held.select("doc_id", "token").join(counted.select("token"), "token").groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("held"))
    left = scratch.cut(held.join(needs, "doc").where("held >= need").select("doc", "need"))
    first.drop()
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    sets = scratch.cut(candidates(bitmap_split(own, "doc", left)[0], late, k, percent))  # the few that are not in ``left`` go in refine
    sets = sets.withColumn("size", size_class(F.col("n"), percent))
    groups = refine(sets.select(F.lit(0).alias("grp"), "doc", "size", F.explode("a").alias("token")), left, scratch)
    groups = refine(sets.join(groups, "doc").select("grp", "doc", "size", F.explode("b").alias("token")), left, scratch)
    links = cut_table(group_links(groups, sets.select("doc", "size", "n_bytes"), own, late, k, percent, scratch))
    scratch.drop()
    ids = some.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select("doc_id", "s1", "s2", "rep")
    shared = ids.groupBy("doc_id").agg(F.min("rep").alias("r"), F.max("rep").alias("r2")).where("r < r2")  # rows of one id and several classes
    same = ids.join(shared.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    known = components(links.unionByName(same)).withColumnRenamed("id", "rep")
    named = classes.join(known, "rep", "left").select("s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return base.join(named, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with their columns, less those that are not the smallest id of their component.

    Of rows that repeat both id and text (null ids too) one stays; rows of one id and several texts stay or go together.
    """
    drop = similar_components(docs, k, percent).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    some, single = bitmap_split(kept, "doc_id", again)
    return single.unionByName(some.dropDuplicates(["doc_id", "text"]))
