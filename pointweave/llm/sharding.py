"""Extendible hashing: shards of bounded bytes from a directory of hash-prefix bits.

Every row has a string of hash bits.  A bucket is a bit prefix; it is a shard as soon as its bytes fit the
limit, and otherwise splits on one more bit.  The sizes of all prefixes down to the directory's depth come from
one aggregation of a pre-aggregated table, and rows reach their shard by an equi-join on the directory
index, so neither the rows nor the directory pass through the driver.

Defined results
    * null key: hashed as the empty string; null content: zero bytes.
    * rows with an equal key: told apart by bits of ``tie`` (their content) after the 60 bits of the key.
    * a single row above the limit: a shard of its own, ``oversize`` true.
    * rows equal in key and content: they share one shard, ``oversize`` true if they exceed the limit together.
    * empty input: no rows.
    * extra columns stay, also when they are named like the result: the result's column then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Hash bits used of the key, and again of the content.
KEY_BITS = 60
#: How many bits below the expected depth the directory is first built for.
SLACK_BITS = 6
RESULT = ("shard", "local_depth", "n_bytes", "shard_bytes", "shard_rows", "oversize")


def hash_bits(value: Column) -> Column:
    """60 well-mixed bits of a value as a string of 0 and 1."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), KEY_BITS, "0")


def extendible_shards(df: DataFrame, key: str, content: str, limit_bytes: int) -> DataFrame:
    """Adds to each row its shard (a bit prefix, ``""`` being the whole), the shard's depth, bytes and rows."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be at least 1")
    bits, cell, leaf = (fresh(df, c) for c in ("__bits", "__cell", "__leaf"))
    size = F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long")
    rows = df.drop(*RESULT).withColumns({"n_bytes": size, bits: F.concat(hash_bits(F.col(key)), hash_bits(F.col(content)))})
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(2 * KEY_BITS, max(0, (total // limit_bytes).bit_length()) + SLACK_BITS)
    start, done, left = 0, None, rows
    while True:
        cells = cut(left.groupBy(F.substring(bits, 1, depth).alias(cell)).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        nodes = (
            cells.select(F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"), cell, "b", "n")
            .groupBy(F.expr(f"substring({cell}, 1, d)").alias("node"), "d")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        )
        last = depth >= 2 * KEY_BITS
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_rows") == 1) | (F.lit(last) & (F.col("d") == depth))
        directory = (
            cells.select(F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"), cell)
            .withColumn("node", F.expr(f"substring({cell}, 1, d)"))
            .join(nodes.where(fits), ["node", "d"])
            .groupBy(cell)
            .agg(F.min_by(F.struct("node", "d", "shard_bytes", "shard_rows"), "d").alias(leaf))
        )
        directory = cut(directory)
        keyed = left.withColumn(cell, F.substring(bits, 1, depth))
        found = keyed.join(directory, cell).select(
            *[c for c in left.columns],
            F.col(f"{leaf}.node").alias("shard"),
            F.col(f"{leaf}.d").cast("int").alias("local_depth"),
            F.col(f"{leaf}.shard_bytes").alias("shard_bytes"),
            F.col(f"{leaf}.shard_rows").alias("shard_rows"),
            (F.col(f"{leaf}.shard_bytes") > limit_bytes).alias("oversize"),
        )
        done = found if done is None else done.unionByName(found)
        if last or cells.join(directory, cell, "left_anti").isEmpty():
            return done.drop(bits)
        left = keyed.join(directory, cell, "left_anti").drop(cell)
        start, depth = depth + 1, min(2 * KEY_BITS, depth + 12)
