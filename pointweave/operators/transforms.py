"""The transform graph of a log: edge figures, parents, components, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.telemetry import frame_name
from ..functions.vectors import magnitude, minus, quaternion_angle, vec
from ..session import shared_folder, written
from .sequences import keyed_quantiles, with_previous

EDGE = ("bag_id", "parent", "child", "is_static")
STATIC_MOVE, STATIC_TURN = 1e-5, 0.01


def explode_transforms(records: DataFrame) -> DataFrame:
    """Records with an array of transforms to one row each."""
    return records.select("bag_id", "seq", "topic", "storage_ns", F.posexplode("transforms").alias("nth", "t")).select("bag_id", "seq", "nth", "topic", "storage_ns", "t.*")


def _typed(transforms: DataFrame) -> DataFrame:
    q = F.struct(*[F.col(f"q{k}").cast("double").alias(k) for k in "xyzw"])
    good = finite(*[F.col(c) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    stamp = F.when(F.coalesce("stamp_ns", F.lit(0)) != 0, F.col("stamp_ns")).otherwise(F.col("storage_ns"))
    return transforms.select(
        "bag_id", "seq", frame_name(F.col("parent")).alias("parent"), frame_name(F.col("child")).alias("child"), F.col("topic").endswith("tf_static").alias("is_static"),
        stamp.alias("ts"), vec(F.col("tx"), F.col("ty"), F.col("tz")).alias("t"), q.alias("q"), good.alias("good"),
    )


def steps(transforms: DataFrame) -> DataFrame:
    """Valid transforms with the move, turn, time and speed since the edge's previous one."""
    s = with_previous(_typed(transforms).where("good").withColumn("now", F.struct("t", "q", "ts")), EDGE, ("seq", "ts"), {"p": "now"}).drop("now")
    move = F.when(F.col("p").isNotNull(), magnitude(minus(F.col("t"), F.col("p.t"))))
    turn = F.when(F.col("p").isNotNull(), quaternion_angle(F.col("p.q"), F.col("q")))
    dt = F.col("ts") - F.col("p.ts")
    return s.withColumns({"step_m": move, "step_deg": turn, "dt": dt, "speed_mps": F.when(dt > 0, move / (dt / 1e9)), "norm_error": F.abs(magnitude(F.col("q"), "xyzw") - 1)})


def edge_summary(transforms: DataFrame) -> DataFrame:
    """Path, steps, periods, gaps, speed and faults of every edge."""
    ends = F.struct("t", "q")
    at = F.struct("seq", "ts")
    rows = written(steps(transforms))  # read three times
    out = rows.groupBy(*EDGE).agg(
        F.count("*").alias("samples"), F.min_by(ends, at).alias("a"), F.max_by(ends, at).alias("b"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("path_m"),
        F.coalesce(F.max("step_m"), F.lit(0.0)).alias("max_step_m"), F.coalesce(F.max("step_deg"), F.lit(0.0)).alias("max_step_deg"),
        F.count("step_m").alias("step_count"), F.max(F.when(F.col("dt") > 0, F.col("dt"))).alias("g"),
        F.coalesce(F.max("speed_mps"), F.lit(0.0)).alias("max_speed_mps"), F.count_if(F.col("dt") < 0).alias("reversals"),
        F.count_if(F.col("is_static") & ((F.col("step_m") > STATIC_MOVE) | (F.col("step_deg") > STATIC_TURN))).alias("static_changes"),
    )
    p = keyed_quantiles(rows, EDGE, {"p_m": (F.col("step_m"), (0.5, 0.95)), "p_deg": (F.col("step_deg"), (0.5, 0.95)), "p_norm": (F.col("norm_error"), (0.95,)), "p_dt": (F.when(F.col("dt") > 0, F.col("dt")), (0.5,))})
    p = p.select(
        *EDGE, F.col("p_m")[0].alias("median_step_m"), F.col("p_m")[1].alias("p95_step_m"), F.col("p_deg")[0].alias("median_step_deg"), F.col("p_deg")[1].alias("p95_step_deg"),
        F.col("p_norm")[0].alias("p95_norm_error"), F.col("p_dt")[0].alias("m"),
    )
    out = out.join(p, list(EDGE), "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("median_step_m", "median_step_deg")})
    bad = _typed(transforms).groupBy(*EDGE).agg(F.count_if(~F.col("good")).alias("invalid"))
    out = bad.join(out, list(EDGE), "left").withColumns({"samples": F.coalesce("samples", F.lit(0)), "net_m": magnitude(minus(F.col("b.t"), F.col("a.t"))), "net_deg": quaternion_angle(F.col("a.q"), F.col("b.q")), "median_period_ms": F.col("m") / 1e6, "max_gap_ms": F.col("g") / 1e6})
    return out.drop("a", "b", "m", "g")


def inventory(transforms: DataFrame) -> DataFrame:
    t = _typed(transforms)
    frames = t.select("bag_id", F.explode(F.array("parent", "child")).alias("frame")).groupBy("bag_id").agg(F.count_distinct("frame").alias("frames"))
    return t.groupBy("bag_id").agg(F.count("*").alias("transforms"), F.count_if(~F.col("good")).alias("invalid"), F.count_distinct("parent", "child").alias("edges")).join(frames, "bag_id")


def multiple_parents(edges: DataFrame) -> DataFrame:
    """Children with more than one parent, and those parents in order."""
    return edges.groupBy("bag_id", "child").agg(F.array_sort(F.collect_set("parent")).alias("parents")).where(F.size("parents") > 1)


def components(edges: DataFrame) -> DataFrame:
    """``bag_id, frame, component``: weakly connected frames share their least name.

    Least names spread along edges and jump to their own component's name, so rounds grow with the logarithm of
    the graph's diameter; lineage is cut in each round by a checkpoint in the shared folder.
    """
    e = edges.select("bag_id", "parent", "child").distinct()
    both = _cut(e.select("bag_id", F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(e.select("bag_id", F.col("child").alias("a"), F.col("parent").alias("b"))))
    now = _cut(both.groupBy("bag_id", F.col("a").alias("frame")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        seen = both.join(now.select("bag_id", F.col("frame").alias("b"), F.col("component").alias("c")), ["bag_id", "b"]).groupBy("bag_id", F.col("a").alias("frame")).agg(F.min("c").alias("c"))
        spread = now.join(seen, ["bag_id", "frame"], "left").select("bag_id", "frame", F.least("component", F.coalesce("c", "component")).alias("to"), F.col("component").alias("old"))
        jump = now.select("bag_id", F.col("frame").alias("to"), F.col("component").alias("further"))
        new = _cut(spread.join(jump, ["bag_id", "to"], "left").select("bag_id", "frame", F.least("to", F.coalesce("further", "to")).alias("component"), "old"))
        changed = not new.where("component != old").isEmpty()
        now = new.drop("old")
        if not changed:
            return now


def edge_order(edges: DataFrame) -> DataFrame:
    """Edges by log, parent, child and whether they are static."""
    return edges.orderBy("bag_id", "parent", "child", "is_static")


def component_order(parts: DataFrame) -> DataFrame:
    """Components with their frames, largest first."""
    out = parts.groupBy("bag_id", "component").agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    return out.withColumn("size", F.size("frames")).orderBy("bag_id", F.desc("size"), "component")


def cycles(edges: DataFrame) -> DataFrame:
    """``bag_id, cycle, frames``: directed cycles, empty if and only if there is none.

    Frames that nothing enters or leaves are peeled off until none is left.  Of the rest each frame keeps its least
    successor; following those long enough ends on cycles only.
    """
    e = _cut(edges.select("bag_id", F.col("parent").alias("a"), F.col("child").alias("b")).distinct())
    while True:
        entered = e.select("bag_id", F.col("b").alias("a")).distinct()
        left = e.select("bag_id", F.col("a").alias("b")).distinct()
        core = _cut(e.join(entered, ["bag_id", "a"], "left_semi").join(left, ["bag_id", "b"], "left_semi"))
        if core.count() == e.count():
            break
        e = core
    step = e.groupBy("bag_id", "a").agg(F.min("b").alias("to"))
    jump, n = step, max(1, step.count())
    for _ in range(n.bit_length()):
        jump = _cut(jump.join(jump.select("bag_id", F.col("a").alias("to"), F.col("to").alias("further")), ["bag_id", "to"]).select("bag_id", "a", F.col("further").alias("to")))
    on_cycle = jump.select("bag_id", F.col("to").alias("a")).distinct()
    own = on_cycle.join(step, ["bag_id", "a"]).select("bag_id", F.col("a").alias("parent"), F.col("to").alias("child"))
    return components(own).groupBy("bag_id", F.col("component").alias("cycle")).agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
