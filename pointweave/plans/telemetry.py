"""Sensor, transform-graph and issue queries; role tables are derived from the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import sensors as S
from ..operators import sequences as Q
from ..operators import timing as O
from ..operators import transforms as G
from ..session import written
from . import issues as I
from .tables import MESSAGES, messages, rounded, table

OPTIONS = R.DiagnosticOptions()


def _vec(x, y, z):
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _bytes(n):
    return F.expr(f"cast(repeat('a', cast({n} as int)) as binary)")


def _role(spark, sf_dir, role):
    """The event log as messages of a sensor role."""
    m = messages(spark, sf_dir).select("bag_id", "topic", "seq", "storage_ns", "header_ns", "value")
    nan = F.when(F.col("seq") % 40 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    zero, one = F.lit(0.0), F.lit(1.0)
    columns = {
        "imu": {"linear_acceleration": _vec(nan, F.col("value") / 2, F.lit(9.8)), "angular_velocity": _vec(F.col("value") / 100, zero, F.lit(0.1)), "orientation": F.struct(zero.alias("x"), zero.alias("y"), zero.alias("z"), (one + F.col("value") / 1000).alias("w"))},
        "scan": {"ranges": F.when(F.col("seq") % 30 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("value"), F.col("value") * 2, nan, F.lit(-1.0))), "range_min": zero, "range_max": F.lit(100.0)},
        "pointcloud": {"width": F.floor(F.col("value")).cast("int"), "height": F.lit(1), "point_step": F.when(F.col("seq") % 25 == 0, 0).otherwise(16), "row_step": F.lit(0), "data": _bytes("floor(value) * 16 - if(seq % 20 = 0, 1, 0)")},
        "livox": {"point_num": F.when(F.col("seq") % 15 == 0, 3).otherwise(2), "timebase": F.col("storage_ns"), "points": F.array(*[F.struct(a.alias("x"), (F.col("value") * 0).alias("y"), zero.alias("z"), b.alias("reflectivity")) for a, b in ((F.col("value"), one), (nan * 2, F.lit(3.0)))])},
        "image": {"width": F.lit(4), "height": F.lit(2), "step": F.lit(12), "data": _bytes("24 - if(seq % 10 = 0, 5, 0)")},
        "odometry": {"pose": F.struct(_vec(nan, F.col("value") / 10, zero).alias("position"))},
        "joint_state": {"name": F.array(F.lit("a"), F.lit("b")), "position": F.when(F.col("seq") % 9 == 0, F.array(F.col("value"))).otherwise(F.array(F.col("value"), nan)), "velocity": F.array().cast("array<double>")},
        "gnss": {"latitude": F.col("value"), "longitude": nan, "altitude": zero, "status": F.when(F.col("seq") % 12 == 0, -1).otherwise(0), "position_covariance": F.array(F.col("value"), F.col("value") * 3, nan)},
        "battery": {"voltage": F.when(F.col("seq") % 33 == 0, 0.0).otherwise(F.col("value") + 1), "current": -F.col("value"), "percentage": F.col("value") / 400, "temperature": F.col("value")},
    }[role]
    return m.withColumns(columns)


def _features(role):
    def query(spark, sf_dir):
        return rounded(S.scalar_summary(S.long_metrics(S.ROLES[role](_role(spark, sf_dir, role)))), 9)

    query.__name__ = f"{role}_features"
    return query


def scalar_summary(spark, sf_dir):
    return rounded(S.scalar_summary(messages(spark, sf_dir).select("bag_id", "topic", F.lit("value").alias("metric"), "value")), 9)


def _all_features(spark, sf_dir):
    """The figures of all roles in one table, written once, so that one job sums them up."""
    return written(reduce(DataFrame.unionByName, [f(_role(spark, sf_dir, role)).withColumn("role", F.lit(role)) for role, f in S.ROLES.items()]))


def sensor_counters(spark, sf_dir):
    by_topic = S.counters(_all_features(spark, sf_dir), ("role", *S.KEYS))
    return by_topic.groupBy("role").agg(*[F.sum(c).alias(c) for c in ("samples", *S.FLAGS, "repeated_samples")], F.max("max_repeat_run").alias("max_repeat_run"))


def _diagnostics(spark, sf_dir):
    entry = F.struct((F.floor(F.col("value")) % 4).cast("int").alias("level"), F.col("topic").alias("name"), F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")).alias("message"))
    return messages(spark, sf_dir).select("bag_id", F.array(entry).alias("status"))


def hardware_faults(spark, sf_dir):
    return S.hardware_faults(_diagnostics(spark, sf_dir))


def mad(spark, sf_dir):
    return rounded(S.scalar_summary(messages(spark, sf_dir).select("bag_id", "topic", F.lit("v").alias("metric"), "value")).select("bag_id", "topic", "mad"))


def prev_vector_delta(spark, sf_dir):
    return rounded(S.long_metrics(S.odometry(_role(spark, sf_dir, "odometry"))).select("bag_id", "topic", "seq", F.col("value").alias("step")))


def _transforms(spark, sf_dir):
    """The event log as transforms: bags of users, edges by topic and a third of the rows static."""
    m = messages(spark, sf_dir)
    static = F.col("seq") % 10 == 0
    return m.select(
        "bag_id", "seq", F.when(static, "/tf_static").otherwise("/tf").alias("topic"), "storage_ns", F.col("header_ns").alias("stamp_ns"),
        F.when(static, "/map").otherwise(" base").alias("parent"), F.col("topic").alias("child"), (F.col("value") / 10).alias("tx"), (F.col("value") / 20).alias("ty"), F.lit(0.0).alias("tz"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("value") / 100).alias("qz"), F.when(F.col("seq") % 70 == 0, F.lit(float("nan"))).otherwise(F.cos(F.col("value") / 100)).alias("qw"),
    )


def tf_edge_summary(spark, sf_dir):
    return rounded(G.edge_summary(_transforms(spark, sf_dir)), 4)


def tf_steps(spark, sf_dir):
    return rounded(G.steps(_transforms(spark, sf_dir)).where("dt is not null").select("bag_id", "child", "is_static", "seq", "step_m", "dt"), 6)


def tf_inventory(spark, sf_dir):
    return G.inventory(_transforms(spark, sf_dir))


def multiple_parents(spark, sf_dir):
    out = G.multiple_parents(_transforms(spark, sf_dir).select("bag_id", F.trim("parent").alias("parent"), "child"))
    return out.select("bag_id", "child", F.array_join("parents", ",").alias("parents"))


def _graph(spark, sf_dir):
    """Customers' nations as a graph: suppliers under nations, nations in chains by name, one chain closed."""
    n = table(spark, sf_dir, "nation")
    chain = n.select(F.col("n_regionkey").cast("string").alias("bag_id"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("parent"), F.concat(F.lit("n"), F.lpad(F.pmod(F.col("n_nationkey") + F.when(F.col("n_regionkey") < 3, 5).otherwise(1), F.lit(25)).cast("string"), 2, "0")).alias("child"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return chain.unionByName(s.select(F.col("n_regionkey").cast("string").alias("bag_id"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("parent"), F.col("s_name").alias("child")))


def tf_components(spark, sf_dir):
    return G.components(_graph(spark, sf_dir))


def component_order(spark, sf_dir):
    return G.component_order(G.components(_graph(spark, sf_dir))).select("bag_id", "component", "size")


def tf_cycles(spark, sf_dir):
    loop = table(spark, sf_dir, "nation").select(F.lit("loop").alias("bag_id"), F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("parent"), F.concat(F.lit("n"), F.lpad(F.pmod(F.col("n_nationkey") + 5, F.lit(25)).cast("string"), 2, "0")).alias("child"))
    return G.cycles(_graph(spark, sf_dir).unionByName(loop)).select("bag_id", "cycle", F.array_join("frames", ",").alias("frames"))


def _summary(spark, sf_dir):
    m = messages(spark, sf_dir)
    return O.interval_summary(m).join(m.select("bag_id", "topic", "msgtype").distinct(), ["bag_id", "topic"])


def _bags(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("bag_id").agg((F.count("*") + F.when(F.col("bag_id") == "3", 5).otherwise(0)).alias("declared_count"))


def timing_issues(spark, sf_dir):
    return R.timing_issues(_summary(spark, sf_dir), OPTIONS)


def header_issues(spark, sf_dir):
    return R.header_issues(O.header_lag(messages(spark, sf_dir)), OPTIONS)


def clock_domain_issues(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("header_ns", F.when(F.col("topic") < "/purchase", F.col("header_ns") % 86400000000000).otherwise(F.col("header_ns")))
    return R.clock_issues(O.header_lag(m), m.where("bag_id = '1'").select("bag_id").distinct())


def _qos(spark, sf_dir):
    text = F.when(F.col("bag_id") < "3", "reliability: reliable reliability: best_effort").when(F.col("bag_id") < "6", "durability: volatile").otherwise("")
    return messages(spark, sf_dir).select("bag_id", "topic").distinct().withColumns({"topic": F.when(F.col("topic") == "/view", "/tf_static").otherwise(F.col("topic")), "qos_text": text, "ros_version": F.lit(2)})


def qos_issues(spark, sf_dir):
    return R.qos_issues(_qos(spark, sf_dir))


def bag_issues(spark, sf_dir):
    return R.bag_issues(_bags(spark, sf_dir), O.inventory(messages(spark, sf_dir)))


def coverage_issues(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = m.groupBy("bag_id").agg(F.count_distinct("topic").alias("total_topics"), F.count_distinct(F.when(F.length("topic") < 6 + F.col("bag_id").cast("int") % 3, F.col("topic"))).alias("decoded_topics"), (F.max("bag_id") == "2").alias("sampled"))
    return R.coverage_issues(c)


def transform_issues(spark, sf_dir):
    t = _transforms(spark, sf_dir)
    graph = _graph(spark, sf_dir)
    return R.transform_issues(G.edge_summary(t), G.multiple_parents(graph), G.components(graph), G.cycles(graph), _bags(spark, sf_dir), OPTIONS)


def sensor_issues(spark, sf_dir):
    keys = ("role", *S.KEYS)
    x = _all_features(spark, sf_dir)
    judged = S.long_metrics(x, keys).where(F.col("metric").isin(*R.JUDGED))
    return R.dedupe(R.sensor_issues(S.counters(x, keys), S.scalar_summary(judged, keys)))


def hardware_issues(spark, sf_dir):
    return R.hardware_issues(S.hardware_faults(_diagnostics(spark, sf_dir)))


def _issues(spark, sf_dir):
    return R.union([timing_issues(spark, sf_dir), header_issues(spark, sf_dir), qos_issues(spark, sf_dir), bag_issues(spark, sf_dir)])


def dedupe_issues(spark, sf_dir):
    twice = R.union([_issues(spark, sf_dir), _issues(spark, sf_dir).withColumn("severity", F.lit("notice"))])
    return R.dedupe(twice).select("bag_id", "issue_id", "severity")


def issue_order(spark, sf_dir):
    return R.ordered(R.dedupe(_issues(spark, sf_dir))).select("bag_id", "rank", "category", "title", "issue_id")


def issue_topic_status(spark, sf_dir):
    return R.topic_status(messages(spark, sf_dir).select("bag_id", "topic").distinct(), _issues(spark, sf_dir))


def top_recommendations(spark, sf_dir):
    return R.recommendations(_issues(spark, sf_dir))


def report_summary(spark, sf_dir):
    topics = messages(spark, sf_dir).groupBy("bag_id", "topic").agg(F.count("*").alias("messages"), F.count_if(F.col("topic").isin("/view", "/click")).alias("decoded"))
    return rounded(R.summary(_bags(spark, sf_dir), R.dedupe(_issues(spark, sf_dir)), topics), 6)


QUERIES = {f.__name__: f for f in (*map(_features, S.ROLES), scalar_summary, sensor_counters, hardware_faults, mad, prev_vector_delta, tf_edge_summary, tf_steps, tf_inventory, multiple_parents, tf_components, component_order, tf_cycles, timing_issues, header_issues, clock_domain_issues, qos_issues, bag_issues, coverage_issues, transform_issues, sensor_issues, hardware_issues, dedupe_issues, issue_order, issue_topic_status, top_recommendations, report_summary)}


def _metrics_sql(values: str, before: str = f"{MESSAGES}, ") -> str:
    """Summary SQL of ``metric, value`` rows made by ``values``; ``before`` holds the tables they need."""
    return f"""WITH {before}v AS ({values}), f AS (SELECT bag_id, topic, metric, count(*) FILTER (isfinite(value)) AS samples, count(*) FILTER (NOT isfinite(value)) AS invalid, min(value) FILTER (isfinite(value)) AS lo, max(value) FILTER (isfinite(value)) AS hi,
avg(value) FILTER (isfinite(value)) AS mean, median(value) FILTER (isfinite(value)) AS med, quantile_cont(value, 0.95) FILTER (isfinite(value)) AS p95 FROM v WHERE value IS NOT NULL GROUP BY ALL),
d AS (SELECT bag_id, topic, metric, median(abs(value - med)) FILTER (isfinite(value)) AS mad FROM v JOIN f USING (bag_id, topic, metric) WHERE value IS NOT NULL GROUP BY ALL)
SELECT bag_id, topic, metric, samples, invalid, round(lo, 9) AS min, round(hi, 9) AS max, round(mean, 9) AS mean, round(med, 9) AS median, round(p95, 9) AS p95, round(mad, 9) AS mad FROM f JOIN d USING (bag_id, topic, metric)"""


#: The graph of nations and suppliers, and what is reached from each frame along edges in either direction.
_GRAPH = """g AS (SELECT n_regionkey::VARCHAR AS bag_id, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS parent, 'n' || lpad(((n_nationkey + CASE WHEN n_regionkey < 3 THEN 5 ELSE 1 END) % 25)::VARCHAR, 2, '0') AS child FROM nation
UNION ALL SELECT n_regionkey::VARCHAR, 'n' || lpad(s_nationkey::VARCHAR, 2, '0'), s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_REACH = """u AS (SELECT bag_id, parent AS a, child AS b FROM g UNION SELECT bag_id, child, parent FROM g),
w AS (SELECT bag_id, a, a AS b FROM u UNION SELECT w.bag_id, w.a, u.b FROM w JOIN u ON w.bag_id = u.bag_id AND w.b = u.a)"""
_DIAG = "d AS (SELECT bag_id, topic AS name, (floor(value)::BIGINT % 4)::INT AS level, 'm' || (seq % 3) AS message FROM m)"
_TF = "t AS (SELECT bag_id, seq, seq % 10 = 0 AS is_static, ltrim(topic, '/') AS child, CASE WHEN header_ns <> 0 THEN header_ns ELSE storage_ns END AS ts, value / 10 AS tx, value / 20 AS ty, seq % 70 <> 0 AS good FROM m)"
#: Metrics by role that a rule judges, for summaries of all of them at once.
_IMU = """SELECT bag_id, topic, unnest(['acceleration','angular_velocity','orientation_norm','orientation_norm_error','acceleration_step','angular_velocity_step']) AS metric,
unnest([sqrt(value**2 + (value / 2)**2 + 9.8**2), sqrt((value / 100)**2 + 0.1**2), 1 + value / 1000, value / 1000, sqrt((value - a)**2 + (value / 2 - a / 2)**2), abs(value / 100 - a / 100)]) AS value
FROM (SELECT *, lag(value) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS a FROM m WHERE seq % 40 <> 0)"""
_BATTERY = "SELECT bag_id, topic, unnest(['voltage','current','percentage','temperature']) AS metric, unnest([CASE WHEN seq % 33 = 0 THEN 0 ELSE value + 1 END, -value, value / 400, value]) AS value FROM m"
_GNSS = "SELECT bag_id, topic, unnest(['no_fix','max_covariance']) AS metric, unnest([(seq % 12 = 0)::INT::DOUBLE, value * 3]) AS value FROM m"
_SCAN = "SELECT bag_id, topic, unnest(['points','invalid_pct']) AS metric, unnest([4.0, 25.0 * (1 + (value > 100)::INT + (value * 2 > 100)::INT + (seq % 40 <> 0 AND value > 100)::INT + (seq % 40 = 0)::INT)]::DOUBLE[]) AS value FROM m WHERE seq % 30 <> 0"
_ODOMETRY = "SELECT bag_id, topic, 'position_step' AS metric, sqrt((value - a)**2 + ((value - a) / 10)**2) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS a FROM m WHERE seq % 40 <> 0)"
_SENSORS = I.union([
    I.issue("counts", "SENSOR_INVALID", "invalid > 0", I.graded("invalid > 0.2 * samples"), "sensors", "Invalid samples", "invalid"),
    I.issue("counts", "SENSOR_EMPTY_OR_MALFORMED", "empty + malformed > 0", "'warning'", "sensors", "Empty or malformed samples", "empty + malformed"),
    I.issue("counts", "SENSOR_SATURATION", "saturated > 0", "'warning'", "sensors", "Saturated samples", "saturated"),
    I.issue("counts", "SENSOR_FROZEN", "max_repeat_run >= 10", "CASE WHEN role IN ('odometry', 'joint_state') THEN 'notice' ELSE 'warning' END", "sensors", "Values stand still", "max_repeat_run"),
    I.issue("figures", "IMU_QUATERNION_NORM", "metric = 'orientation_norm_error' AND p95 > 0.05", "'warning'", "sensors", "Orientation is not of unit length", I.shown("p95", 4)),
    I.issue("figures", "IMU_HIGH_SHORT_TERM_VARIATION", "(metric = 'acceleration_step' AND mad > 1) OR (metric = 'angular_velocity_step' AND mad > 0.2)", "'notice'", "sensors", "Noisy inertial data", I.shown("mad", 4)),
    I.issue("figures", "LIDAR_INVALID_RANGES", "metric = 'invalid_pct' AND p95 > 30", "'warning'", "sensors", "Many invalid ranges", I.shown("p95", 1)),
    I.issue("figures", "ODOMETRY_POSITION_JUMP", "metric = 'position_step' AND max > 2", "'warning'", "sensors", "The position jumps", I.shown("max", 2)),
    I.issue("figures", "GNSS_NO_FIX", "metric = 'no_fix' AND max > 0", "'warning'", "sensors", "No position fix at times", I.shown("mean", 4)),
    I.issue("figures", "BATTERY_LOW", "metric = 'percentage' AND min >= 0 AND min < 0.1", "'warning'", "sensors", "Battery is low", I.shown("min", 3)),
    I.issue("figures", "BATTERY_TEMPERATURE_HIGH", "metric = 'temperature' AND max > 60", I.graded("max > 80"), "sensors", "Battery is hot", I.shown("max", 1)),
])
_RINGS = """reached AS (SELECT bag_id, parent AS a, child AS b FROM g UNION SELECT r.bag_id, r.a, g.child FROM reached r JOIN g ON r.bag_id = g.bag_id AND r.b = g.parent),
rings AS (SELECT DISTINCT bag_id, min(b) AS cycle, string_agg(b, ', ' ORDER BY b) AS frames FROM (SELECT x.bag_id, x.a, x.b FROM reached x JOIN reached y ON x.bag_id = y.bag_id AND x.a = y.b AND x.b = y.a) GROUP BY bag_id, a)"""
ORACLES = I.ORACLES | {
    "transform_issues": f"WITH RECURSIVE {MESSAGES}, {I.EDGES}, {_GRAPH}, {_REACH}, parts AS (SELECT bag_id, a, min(b) AS component FROM w GROUP BY ALL), {_RINGS} {I.TRANSFORMS}",
    "imu_features": _metrics_sql(_IMU),
    "sensor_issues": f"WITH {MESSAGES}, {I.COUNTERS}, figures AS ({_metrics_sql(' UNION ALL '.join((_IMU, _BATTERY, _GNSS, _SCAN, _ODOMETRY)), '').strip()}), every AS ({_SENSORS}) {I.least('every')}",
    "scalar_summary": _metrics_sql("SELECT bag_id, topic, 'value' AS metric, value FROM m"),
    "mad": f"WITH {MESSAGES} SELECT bag_id, topic, round(mad(value), 6) AS mad FROM m GROUP BY ALL",
    "battery_features": _metrics_sql(_BATTERY),
    "gnss_features": _metrics_sql(_GNSS),
    "image_features": _metrics_sql("SELECT bag_id, topic, unnest(['pixels','payload_bytes']) AS metric, unnest([8.0, CASE WHEN seq % 10 = 0 THEN 19 ELSE 24 END]::DOUBLE[]) AS value FROM m"),
    "pointcloud_features": _metrics_sql("SELECT bag_id, topic, 'points' AS metric, floor(value) AS value FROM m"),
    "scan_features": _metrics_sql(_SCAN),
    "odometry_features": _metrics_sql(_ODOMETRY),
    "joint_state_features": _metrics_sql("SELECT bag_id, topic, 'joints' AS metric, 2.0::DOUBLE AS value FROM m"),
    "prev_vector_delta": f"WITH {MESSAGES} SELECT bag_id, topic, seq, round(sqrt((value - a)**2 + ((value - a) / 10)**2), 6) AS step FROM (SELECT *, lag(value) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS a FROM m WHERE seq % 40 <> 0) WHERE a IS NOT NULL",
    "hardware_faults": f"WITH {MESSAGES}, {_DIAG} SELECT bag_id, name, level, message, count(*) AS n FROM d WHERE level >= 1 GROUP BY ALL",
    "hardware_issues": f"WITH {MESSAGES}, {_DIAG} SELECT bag_id, 'HARDWARE_DIAGNOSTIC:' || name AS issue_id, CASE WHEN level >= 2 THEN 'critical' ELSE 'warning' END AS severity, 'hardware' AS category, name AS topic, 'A component reports a fault' AS title, message || ': ' || count(*) AS evidence, '' AS suggestion, 'medium' AS confidence FROM d WHERE level >= 1 GROUP BY bag_id, name, level, message",
    "tf_inventory": f"WITH {MESSAGES}, {_TF} SELECT bag_id, count(*) AS transforms, count(*) FILTER (NOT good) AS invalid, count(DISTINCT child || is_static) AS edges, count(DISTINCT child) + count(DISTINCT is_static) AS frames FROM t GROUP BY 1",
    "tf_steps": f"""WITH {MESSAGES}, {_TF}, s AS (SELECT *, lag(tx) OVER w AS px, lag(ty) OVER w AS py, ts - lag(ts) OVER w AS dt FROM t WHERE good WINDOW w AS (PARTITION BY bag_id, is_static, child ORDER BY seq))
SELECT bag_id, child, is_static, seq, round(sqrt((tx - px)**2 + (ty - py)**2), 6) AS step_m, dt FROM s WHERE dt IS NOT NULL""",
    "multiple_parents": f"WITH {MESSAGES} SELECT bag_id, topic AS child, '/map,base' AS parents FROM m GROUP BY ALL HAVING bool_or(seq % 10 = 0) AND bool_or(seq % 10 <> 0)",
    "bag_issues": f"WITH {MESSAGES} SELECT bag_id, 'BAG_METADATA' AS issue_id, 'warning' AS severity, 'bag' AS category, NULL::VARCHAR AS topic, 'Declared and stored counts differ' AS title, (count(*) + 5) || '/' || count(*) AS evidence, '' AS suggestion, 'medium' AS confidence FROM m WHERE bag_id = '3' GROUP BY 1",
    "tf_cycles": f"""WITH RECURSIVE {_GRAPH}, every AS (SELECT * FROM g UNION ALL SELECT 'loop', 'n' || lpad(n_nationkey::VARCHAR, 2, '0'), 'n' || lpad(((n_nationkey + 5) % 25)::VARCHAR, 2, '0') FROM nation),
w AS (SELECT bag_id, parent AS a, child AS b FROM every UNION SELECT w.bag_id, w.a, e.child FROM w JOIN every e ON w.bag_id = e.bag_id AND w.b = e.parent),
c AS (SELECT x.bag_id, x.a, x.b FROM w x JOIN w y ON x.bag_id = y.bag_id AND x.a = y.b AND x.b = y.a)
SELECT DISTINCT bag_id, min(b) AS cycle, string_agg(b, ',' ORDER BY b) AS frames FROM c GROUP BY bag_id, a""",
    "tf_components": f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT bag_id, a AS frame, min(b) AS component FROM w GROUP BY ALL",
    "component_order": f"WITH RECURSIVE {_GRAPH}, {_REACH}, c AS (SELECT bag_id, a, min(b) AS component FROM w GROUP BY ALL) SELECT bag_id, component, count(*)::INT AS size FROM c GROUP BY ALL",
}
