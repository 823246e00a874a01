"""Ordered rows: previous rows, intervals, runs, dense positions, strides, exact ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Width of a segment: rows of one key are cut into ranges of so many values of their order.
BUCKET_ROWS = 1_000_000


def _orders(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _segmented(df: DataFrame, order: str | Sequence[str], bucket_rows: int) -> DataFrame:
    """Adds ``__bucket``: the segment of the (first) order, an integer."""
    return df.withColumn("__bucket", F.floor(F.col(_orders(order)[0]) / bucket_rows).cast("long"))


def with_previous(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], columns: dict[str, str], bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Adds the previous row's values: ``columns`` maps new names to old ones.

    The rows of a key are cut into segments of ``bucket_rows`` values of ``order`` (an integer first), so that one
    huge key spreads over many tasks; the last row of each segment is carried to the next one.  None: no segments.
    """
    by = _orders(order)
    kept = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(columns.values())])
    if bucket_rows is None:
        out = df.withColumn("__prev", F.lag(kept).over(Window.partitionBy(*keys).orderBy(*by)))
    else:
        cut = _segmented(df, order, bucket_rows)
        own = Window.partitionBy(*keys, "__bucket").orderBy(*by)
        last = cut.groupBy(*keys, "__bucket").agg(F.max_by(kept, F.struct(*by)).alias("__last"))
        carried = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
        out = _joined(cut.withColumn("__own", F.lag(kept).over(own)), carried, [*keys, "__bucket"]).withColumn("__prev", F.coalesce("__own", "__carry")).drop("__bucket", "__own", "__carry")
    return out.withColumns({new: F.col(f"__prev.p{i}") for i, new in enumerate(columns)}).drop("__prev")


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join by keys that may be null."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    on = None
    for k, n in names.items():
        same = F.col(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return rows.join(carried.withColumnsRenamed(names), on, "left").drop(*names.values())


#: Parts over which the rows of a key are dealt when they meet the one row of their key.
PARTS = 32


def with_key_row(rows: DataFrame, each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``each``, a table of one row a key; rows whose key is not in it go.

    The table is written once, and is there for each of PARTS parts of the rows: small, it is sent to all tasks and the rows stay
    where they are; large, a key with most of the rows spreads over so many tasks.
    """
    dealt = rows.withColumn("__part", (F.monotonically_increasing_id() % PARTS).cast("int"))
    every = written(each).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(every, [*keys, "__part"]).drop("__part")


def running_sums(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], columns: dict[str, Column], bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Adds sums of whole numbers over all rows up to each one, by key: a sum within each segment, and what earlier segments carry."""
    by, zero = _orders(order), F.lit(0).cast("long")
    values = {n: F.coalesce(c.cast("long"), zero) for n, c in columns.items()}
    upto = (Window.unboundedPreceding, 0)
    if bucket_rows is None:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(*upto)
        return df.withColumns({n: F.sum(v).over(w) for n, v in values.items()})
    cut = _segmented(df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())}), order, bucket_rows)
    own = Window.partitionBy(*keys, "__bucket").orderBy(*by).rowsBetween(*upto)
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "__bucket").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(values))])
    carried = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__t{i}").over(earlier), zero).alias(f"__c{i}") for i in range(len(values))])
    out = _joined(cut.withColumns({f"__s{i}": F.sum(f"__v{i}").over(own) for i in range(len(values))}), carried, [*keys, "__bucket"])
    out = out.withColumns({n: F.col(f"__s{i}") + F.col(f"__c{i}") for i, n in enumerate(values)})
    return out.drop("__bucket", *[f"__{c}{i}" for c in "vsc" for i in range(len(values))])


def last_and_next(df: DataFrame, keys: Sequence[str], time: str, value: Column, width: float | None = 3600.0) -> DataFrame:
    """Adds ``before`` and ``after``: the last value that is not null up to each row's time and the first one from it on, equal times both.

    Rows are cut into segments of ``width`` of the time; each segment's first and last value are carried to the others.
    """
    keys = list(keys)
    cut = df.withColumn("__value", value).withColumn("__bucket", F.lit(0).cast("long") if width is None else F.floor(F.col(time) / width).cast("long"))
    own = Window.partitionBy(*keys, "__bucket").orderBy(time)
    ends = cut.where(F.col("__value").isNotNull()).groupBy(*keys, "__bucket").agg(F.max_by("__value", time).alias("__last"), F.min_by("__value", time).alias("__first"))
    every = _joined(cut.select(*keys, "__bucket").distinct(), ends, [*keys, "__bucket"])
    buckets = Window.partitionBy(*keys).orderBy("__bucket")
    carried = every.select(
        *keys, "__bucket",
        F.last("__last", True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__first", True).over(buckets.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    marked = cut.withColumns({"before": F.last("__value", True).over(own.rangeBetween(Window.unboundedPreceding, 0)), "after": F.first("__value", True).over(own.rangeBetween(0, Window.unboundedFollowing))})
    out = _joined(marked, carried, [*keys, "__bucket"])
    return out.withColumns({"before": F.coalesce("before", "__before"), "after": F.coalesce("after", "__after")}).drop("__value", "__bucket", "__before", "__after")


def intervals(df: DataFrame, keys: Sequence[str], order: str, time: str, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Adds ``dt``, the time since the previous row in recorded order, and its class."""
    out = with_previous(df, keys, order, {"__before": time}, bucket_rows)
    dt = F.col(time) - F.col("__before")
    kind = F.when(dt.isNull(), None).when(dt == 0, "duplicate").when(dt < 0, "reversal").otherwise("positive")
    return out.withColumns({"dt": dt, "interval_class": kind}).drop("__before")


def time_reversals(df: DataFrame, keys: Sequence[str], order: str, time: str) -> DataFrame:
    """The number of rows with a time before the previous row's, by key."""
    return intervals(df, keys, order, time).groupBy(*keys).agg(F.count_if(F.col("dt") < 0).alias("time_reversals"))


def longest_runs(df: DataFrame, keys: Sequence[str], order: str, value: str, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """By key: repeats of the previous value and the longest run of repeats; rows of null or empty value are skipped.

    A run that goes on over segments keeps its number, which is a running sum, and so is counted as one.
    """
    some = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    marked = with_previous(some, keys, order, {"__old": value}, bucket_rows)
    numbered = running_sums(marked, keys, order, {"__run": ~F.col(value).eqNullSafe(F.col("__old"))}, bucket_rows)
    runs = numbered.groupBy(*keys, "__run").agg((F.count("*") - 1).alias("repeats"))
    return runs.groupBy(*keys).agg(F.sum("repeats").alias("repeated_samples"), F.max("repeats").alias("max_repeat_run"))


def dense_position(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``position`` from 0: by key through a window, else over all rows through range partitions.

    Without keys the rows are dealt by range of their order and written once, sorted, with their partition and place; counts
    and positions both come from that one copy, so that no task holds all rows and none is lost or met twice.
    """
    if keys:
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    # partition number in the upper bits, place within the partition in the lower 33
    at = F.monotonically_increasing_id()
    dealt = written(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.withColumn("position", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__before")


def stride_sample(df: DataFrame, order: Sequence[str], limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every k-th row in order, the first included, k being the least that gives at most ``limit`` rows."""
    placed = dense_position(df, order, keys)
    if keys:
        sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / limit)).alias("__k"))
        placed = placed.join(sizes, list(keys))
    else:
        placed = placed.withColumn("__k", F.lit(max(1, -(-df.count() // limit))))
    return placed.where(F.col("position") % F.col("__k") == 0).drop("__k")


def ranks(df: DataFrame, value: str, at: Sequence[int]) -> DataFrame:
    """The values at given positions of the sorted column, found in range partitions: exact at any size."""
    return dense_position(df.select(value).where(F.col(value).isNotNull()), [value]).where(F.col("position").isin(*at)).select("position", value)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """``p, value``: quantiles with linear interpolation at p * (n - 1), for columns too large for one group."""
    n = df.where(F.col(value).isNotNull()).count()
    wanted = [(float(p), int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1), p * (n - 1) - int(p * (n - 1))) for p in probabilities] if n else []
    spark = df.sparkSession
    asked = spark.createDataFrame(wanted, "p double, low long, high long, part double")
    got = ranks(df, value, sorted({i for w in wanted for i in w[1:3]})) if wanted else spark.createDataFrame([], f"position long, `{value}` double")
    low = got.select(F.col("position").alias("low"), F.col(value).cast("double").alias("a"))
    high = got.select(F.col("position").alias("high"), F.col(value).cast("double").alias("b"))
    return asked.join(low, "low").join(high, "high").select("p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(value))


#: One part in so many is the error of the sketch that brackets a quantile.
SKETCH = 10_000


def keyed_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Exact quantiles by key, interpolated at p * (n - 1): a column of each name, an array in the order of its probabilities.

    ``wanted`` names columns with their probabilities; nulls don't count, and keys without any value have no row.  A sketch brackets
    each quantile; then rows below the bracket are counted, and only the different values inside it (a few in SKETCH of a key's
    rows) are put in order.  So no task holds the values of a key, however many it has.
    """
    keys = list(keys)
    names = list(wanted)
    values = [c.cast("double").alias(f"v{i}") for i, (c, _) in enumerate(wanted.values())]
    v = df.select(*keys, *values)
    margin, edges = 2.0 / SKETCH, []
    for i, (_, probabilities) in enumerate(wanted.values()):
        around = [min(1.0, max(0.0, p + side * margin)) for p in probabilities for side in (-1, 1)]
        edges += [F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", around, SKETCH).alias(f"e{i}")]
    known = v.groupBy(*keys).agg(*edges)
    asked = []
    for i, (_, probabilities) in enumerate(wanted.values()):
        for j, p in enumerate(probabilities):
            at = F.lit(float(p)) * (F.col(f"n{i}") - 1)
            asked.append(F.when(F.col(f"n{i}") > 0, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"e{i}")[2 * j].alias("low"), F.col(f"e{i}")[2 * j + 1].alias("high"), at.alias("at"))))
    known = known.select(*keys, F.array_compact(F.array(*asked)).alias("asked"))
    value = F.get(F.array(*[f"v{i}" for i in range(len(names))]), F.col("a.i"))
    each = with_key_row(v, known, keys).select("*", F.explode("asked").alias("a")).withColumn("x", value).where(F.col("x").isNotNull())
    side = F.when(F.col("x") < F.col("a.low"), -1).when(F.col("x") > F.col("a.high"), 1).otherwise(0)
    each = each.select(*keys, F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.col("a.at").alias("at"), side.alias("side"), "x")
    # all below the bracket are one row with their greatest value, all above one with their least: next to it, if it is that narrow
    counted = each.groupBy(*keys, "i", "j", "at", "side", F.when(F.col("side") == 0, F.col("x")).alias("inside")).agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
    counted = counted.withColumn("x", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    upto = F.sum("c").over(Window.partitionBy(*keys, "i", "j", "at").orderBy("side", "x"))
    first = counted.withColumn("upto", upto).groupBy(*keys, "i", "j", "at").agg(*[F.min(F.when(F.col("upto") > f("at"), F.col("x"))).alias(c) for c, f in (("a", F.floor), ("b", F.ceil))])
    part = F.col("at") - F.floor("at")
    found = F.struct("j", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("x"))
    arrays = [F.transform(F.array_sort(F.collect_list(F.when(F.col("i") == i, found))), lambda x: x["x"]) for i in range(len(names))]
    return first.groupBy(*keys).agg(*[F.when(F.size(a) > 0, a).alias(n) for n, a in zip(names, arrays, strict=True)])


def moving_sums(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, Column], rows: int, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """Adds sums of whole numbers over the last so many rows of a key: running sums less those of the row so many places before."""
    keys = list(keys)
    sums = running_sums(df, keys, order, {"__nth": F.lit(1), **columns}, bucket_rows)
    earlier = sums.select(*keys, (F.col("__nth") + rows).alias("__nth"), *[F.col(n).alias(f"__e{i}") for i, n in enumerate(columns)])
    out = _joined(sums, earlier, [*keys, "__nth"])
    return out.withColumns({n: F.col(n) - F.coalesce(f"__e{i}", F.lit(0)) for i, n in enumerate(columns)}).drop("__nth", *[f"__e{i}" for i in range(len(columns))])
