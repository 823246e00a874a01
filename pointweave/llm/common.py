"""Helpers shared by the corpus operators: words, local bindings, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the five ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    A one-element ``transform`` keeps the value in a lambda variable, so that the optimizer cannot
    copy its expression into an inner loop.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; a local master may go without and gets a new folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _write(df: DataFrame) -> str:
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet beside the checkpoints, in the shared folder, and read from there."""
    return df.sparkSession.read.parquet(_write(df))


class Scratch:
    """Tables that are needed for a while only: ``cut`` writes one as ``cut_table`` does, ``drop`` deletes them all.

    Drop them once everything that reads them is itself written; a lost executor then needs none of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        self.paths.append(_write(df))
        return self.spark.read.parquet(self.paths[-1])

    def drop(self) -> None:
        context = self.spark.sparkContext
        for path in self.paths:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        self.paths.clear()


#: Bits of the filter that goes before a join, and so eight times the bytes that are broadcast.
FILTER_BITS = 1 << 26


def bitmap_split(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key may be in ``wanted``, and those whose key surely is not.

    The filter has one hash and a fixed size, and is broadcast.  It only spares a following join the
    shuffle of rows that have no partner; with more keys than bits it lets more rows through.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    bucket, bit, bits, hit = (fresh(df, c) for c in ("__bucket", "__bit", "__bits", "__hit"))
    made = wanted.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias(bucket)).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias(bits))
    placed = df.withColumn(bit, place).withColumn(bucket, F.expr(f"bitmap_bucket_number({bit})"))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(bitmap_bit_position({bit}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({bit}) % 8 as int))")) != 0, F.lit(False))
    flagged = placed.join(F.broadcast(made), bucket, "left").withColumn(hit, on)
    return flagged.where(F.col(hit)).select(*df.columns), flagged.where(~F.col(hit)).select(*df.columns)
