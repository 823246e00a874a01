"""DuckDB SQL of the issue table: every rule over the same figures as the telemetry queries."""

from __future__ import annotations

from .tables import MESSAGES
from .timing import lag_sql, summary_sql


def issue(src: str, rule: str, when: str, severity: str, category: str, title: str, evidence: str, suggestion: str = "", confidence: str = "medium", subject: str | None = "topic") -> str:
    """The rows of one rule; ``severity`` and ``evidence`` are SQL, the other texts plain."""
    quoted = suggestion.replace("'", "''")
    name = f"{subject}::VARCHAR" if subject else "NULL::VARCHAR"
    ident = f"'{rule}:' || {subject}" if subject else f"'{rule}'"
    return f"SELECT bag_id, {ident} AS issue_id, {severity} AS severity, '{category}' AS category, {name} AS topic, '{title}' AS title, ({evidence})::VARCHAR AS evidence, '{quoted}' AS suggestion, '{confidence}' AS confidence FROM {src} WHERE {when}"


def graded(critical: str) -> str:
    return f"CASE WHEN {critical} THEN 'critical' ELSE 'warning' END"


def shown(figure: str, digits: int) -> str:
    return f"round(round({figure}, {digits + 6}), {digits})::DECIMAL(38, {digits})"


def union(rules: list[str]) -> str:
    return "\nUNION ALL ".join(rules)


# no topic of the event log is static, event-driven or a control topic
SUMMARY = f"sums AS (WITH {summary_sql().strip()} SELECT *, CASE topic WHEN '/view' THEN 50 WHEN '/click' THEN 10 WHEN '/purchase' THEN 5 END AS least FROM s)"
TIMING = union([
    issue("sums", "TOPIC_SINGLE_MESSAGE", "message_count = 1", "'notice'", "rate", "Only one message", "message_count", "Check that the topic is published once by design."),
    issue("sums", "TOPIC_RATE_LOW", "mean_hz + greatest(0.01, least * 0.005) < least", graded("mean_hz < least / 2"), "rate", "Rate below its baseline", shown("mean_hz", 2), "Check timers, load and queues."),
    issue("sums", "TOPIC_JITTER", "message_count >= 10 AND jitter_cv_pct > 20", graded("jitter_cv_pct > 60"), "rate", "Unsteady period", shown("jitter_cv_pct", 1), "Check blocking callbacks and priorities.", "high"),
    issue("sums", "TOPIC_GAPS", "drop_pct > 1", graded("drop_pct > 5"), "loss", "Messages seem to be missing", shown("drop_pct", 2), "Compare with the publisher's counters."),
    issue("sums", "STORAGE_TIME_BACKWARDS", "reversals > 0", "'critical'", "stamps", "Storage time runs backwards", "reversals", "Check clock jumps.", "high"),
    issue("sums", "STORAGE_TIME_DUPLICATE", "message_count > 1 AND duplicates / (message_count - 1) > 0.01", "'warning'", "stamps", "Many equal storage times", "duplicates", "Check the resolution of stamps."),
])
HEADERS = union([
    issue("lags", "HEADER_STAMP_MISSING", "missing_or_zero > 0.05 * decoded", "'warning'", "stamps", "Header stamps are missing", "missing_or_zero"),
    issue("lags", "HEADER_STAMP_BACKWARDS", "backward_stamps > 0", "'critical'", "stamps", "Header time runs backwards", "backward_stamps"),
    issue("lags", "HEADER_STORAGE_LAG", "clock_relation = 'aligned' AND lag_p95_abs_ms > 100", graded("lag_p95_abs_ms > 10000"), "stamps", "Storage lags behind the header", shown("lag_p95_abs_ms", 1)),
])
CLOCKS = f"""c AS (SELECT * REPLACE (CASE WHEN topic < '/purchase' THEN header_ns % 86400000000000 ELSE header_ns END AS header_ns) FROM m), {lag_sql("c")},
apart AS (SELECT bag_id, string_agg(topic, ', ' ORDER BY topic) AS names FROM lags WHERE clock_relation = 'separate_epoch' GROUP BY 1)"""
CLOCK = issue("apart", "HEADER_STORAGE_CLOCK_DOMAIN", "true", "CASE bag_id WHEN '1' THEN 'notice' ELSE 'warning' END", "stamps", "Header and storage clocks differ", "names", subject=None)
# texts of the bags 0 to 2 name two reliabilities, those of 3 to 5 a volatile durability, the rest none
QOS_ROWS = """q AS (SELECT DISTINCT bag_id, CASE topic WHEN '/view' THEN '/tf_static' ELSE topic END AS topic, CASE WHEN bag_id < '3' THEN 'mixed' WHEN bag_id >= '6' THEN 'unknown' WHEN topic = '/view' THEN 'risky' ELSE 'recorded' END AS status FROM m),
unset AS (SELECT bag_id, string_agg(topic, ', ' ORDER BY topic) AS names FROM q WHERE status = 'unknown' GROUP BY 1)"""
QOS = union([
    issue("unset", "QOS_METADATA_MISSING", "true", "'notice'", "QoS", "QoS was not recorded", "names", subject=None),
    issue("q", "QOS_RISK", "status IN ('mixed', 'risky')", "'warning'", "QoS", "Playback may not match subscribers", "status"),
])
BAG_ROWS = "bags AS (SELECT bag_id, count(*) AS n, count(*) + CASE bag_id WHEN '3' THEN 5 ELSE 0 END AS declared FROM m GROUP BY 1)"
BAGS = issue("bags", "BAG_METADATA", "declared <> n", "'warning'", "bag", "Declared and stored counts differ", "declared || '/' || n", subject=None)
COVERED = "cover AS (SELECT bag_id, count(DISTINCT topic) AS n, count(DISTINCT topic) FILTER (length(topic) < 6 + bag_id::INT % 3) AS k FROM m GROUP BY 1)"
COVERAGE = union([
    issue("cover", "DEEP_ANALYSIS_DISABLED", "k = 0", "'notice'", "coverage", "No payload was decoded", "n", subject=None),
    issue("cover", "PAYLOAD_DECODE_PARTIAL", "k > 0 AND k < n", "'notice'", "coverage", "Some topics were not decoded", "k || '/' || n", subject=None),
    issue("cover", "TF_TIMING_SAMPLED", "bag_id = '2'", "'notice'", "coverage", "Transforms were sampled", "'sampled'", subject=None),
])
EDGES = """t AS (SELECT bag_id, seq, seq % 10 = 0 AS is_static, CASE WHEN seq % 10 = 0 THEN 'map' ELSE 'base' END AS parent, ltrim(topic, '/') AS child, CASE WHEN header_ns <> 0 THEN header_ns ELSE storage_ns END AS ts, value / 10 AS tx, value / 20 AS ty, sin(value / 100) AS qz, cos(value / 100) AS qw, seq % 70 <> 0 AS good FROM m),
lagged AS (SELECT *, lag(tx) OVER w AS px, lag(ty) OVER w AS py, lag(qz) OVER w AS pz, lag(qw) OVER w AS pw, ts - lag(ts) OVER w AS dt FROM t WHERE good WINDOW w AS (PARTITION BY bag_id, parent, child, is_static ORDER BY seq)),
moved AS (SELECT *, sqrt((tx - px)**2 + (ty - py)**2) AS step_m, CASE WHEN px IS NOT NULL THEN degrees(2 * acos(least(1, abs(qz * pz + qw * pw) / (sqrt(qz**2 + qw**2) * sqrt(pz**2 + pw**2))))) END AS step_deg, abs(sqrt(qz**2 + qw**2) - 1) AS off FROM lagged),
ends AS (SELECT bag_id, parent, child, is_static, count(*) AS samples, sum(step_m) AS path_m, median(step_m) AS median_step_m, quantile_cont(step_m, 0.95) AS p95_step_m, max(step_m) AS max_step_m,
    median(step_deg) AS median_step_deg, quantile_cont(step_deg, 0.95) AS p95_step_deg, max(step_deg) AS max_step_deg, count(step_m) AS step_count, quantile_cont(off, 0.95) AS p95_norm_error,
    median(dt) FILTER (dt > 0) / 1e6 AS median_period_ms, max(dt) FILTER (dt > 0) / 1e6 AS max_gap_ms, max(step_m / (dt / 1e9)) FILTER (dt > 0) AS max_speed_mps, count(*) FILTER (dt < 0) AS reversals,
    count(*) FILTER (is_static AND (step_m > 1e-5 OR step_deg > 0.01)) AS static_changes, arg_min({'x': tx, 'y': ty, 'z': qz, 'w': qw}, seq) AS a, arg_max({'x': tx, 'y': ty, 'z': qz, 'w': qw}, seq) AS b FROM moved GROUP BY ALL),
edges AS (SELECT bag_id, parent, child, is_static, invalid, coalesce(samples, 0) AS samples, CASE WHEN samples > 0 THEN coalesce(path_m, 0) END AS path_m, CASE WHEN samples > 0 THEN coalesce(median_step_m, 0) END AS median_step_m, p95_step_m, CASE WHEN samples > 0 THEN coalesce(max_step_m, 0) END AS max_step_m,
    CASE WHEN samples > 0 THEN coalesce(median_step_deg, 0) END AS median_step_deg, p95_step_deg, CASE WHEN samples > 0 THEN coalesce(max_step_deg, 0) END AS max_step_deg, step_count, p95_norm_error, median_period_ms, max_gap_ms,
    CASE WHEN samples > 0 THEN coalesce(max_speed_mps, 0) END AS max_speed_mps, reversals, static_changes, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS net_m, CASE WHEN samples > 0 THEN degrees(2 * acos(least(1, abs(a.z * b.z + a.w * b.w) / (sqrt(a.z**2 + a.w**2) * sqrt(b.z**2 + b.w**2))))) END AS net_deg
    FROM (SELECT bag_id, parent, child, is_static, count(*) FILTER (NOT good) AS invalid FROM t GROUP BY ALL) LEFT JOIN ends USING (bag_id, parent, child, is_static))"""
EDGE_FIGURES = "path_m median_step_m p95_step_m max_step_m median_step_deg p95_step_deg max_step_deg p95_norm_error max_speed_mps net_m net_deg median_period_ms max_gap_ms".split()


def _jump(figure: str, least: float) -> str:
    return f"NOT is_static AND max_{figure} > CASE WHEN step_count >= 5 THEN greatest({least}, 10 * median_{figure}) ELSE {least} END"


_EDGE = "parent || '->' || child"
TRANSFORMS = union([
    issue("edges", "TF_STATIC_CHANGED", "static_changes > 0", "'warning'", "transforms", "A static transform changes", "static_changes", subject=_EDGE),
    issue("edges", "TF_TIME_BACKWARDS", "reversals > 0", "'critical'", "transforms", "Transform time runs backwards", "reversals", subject=_EDGE),
    issue("edges", "TF_TRANSLATION_JUMP", _jump("step_m", 0.5), "'warning'", "transforms", "Translation jumps", shown("max_step_m", 3), subject=_EDGE),
    issue("edges", "TF_ROTATION_JUMP", _jump("step_deg", 30), "'warning'", "transforms", "Rotation jumps", shown("max_step_deg", 3), subject=_EDGE),
    issue("edges", "TF_SPEED_SPIKE", "NOT is_static AND max_speed_mps > 10", "'warning'", "transforms", "Implausible speed", shown("max_speed_mps", 2), subject=_EDGE),
    issue("edges", "TF_GAP", "NOT is_static AND max_gap_ms > 3 * median_period_ms", "'warning'", "transforms", "A transform pauses", shown("max_gap_ms", 1), subject=_EDGE),
    issue("edges", "TF_QUATERNION_NORM", "p95_norm_error > 0.05", "'warning'", "transforms", "Quaternions are not of unit length", shown("p95_norm_error", 4), subject=_EDGE),
    issue("(SELECT bag_id, child, string_agg(DISTINCT parent, ', ' ORDER BY parent) AS names FROM g GROUP BY ALL HAVING count(DISTINCT parent) > 1)", "TF_MULTIPLE_PARENTS", "true", "'critical'", "transforms", "A frame has several parents", "names", subject="child"),
    issue("(SELECT bag_id, count(DISTINCT component) AS n FROM parts GROUP BY 1)", "TF_DISCONNECTED_GRAPH", "n > 1", "'warning'", "transforms", "The graph falls apart", "n", subject=None),
    issue("rings", "TF_GRAPH_CYCLE", "true", "'critical'", "transforms", "The graph has a cycle", "frames", subject="cycle"),
])
#: Rows ``z`` of a role: which samples are faulty, and ``sig``, equal where the sensor's printed values are equal, null where none are.
_WAS = "CASE WHEN {0} = 0 THEN 0 ELSE round({0} * pow(10, 3 - floor(log10({0})))) / pow(10, 3 - floor(log10({0}))) END"
_ROLE = {
    "imu": ("seq % 40 = 0", "false", "false", "seq % 40 <> 0 AND sqrt(value**2 + (value / 2)**2 + 9.8**2) > 100", "CASE WHEN seq % 40 <> 0 THEN value::VARCHAR END"),
    "scan": ("false", "seq % 30 = 0", "false", "false", "CASE WHEN seq % 30 <> 0 THEN value || ' ' || (seq % 40 = 0) END"),
    "pointcloud": ("false", "floor(value) * 16 - (seq % 20 = 0)::INT <= 0", "seq % 25 = 0 OR (floor(value) > 0 AND seq % 20 = 0)", "false", "greatest(0, floor(value) * 16 - (seq % 20 = 0)::INT)::VARCHAR"),
    "livox": ("seq % 40 = 0", "false", "seq % 15 = 0", "false", f"(seq % 15 = 0) || ' ' || ({_WAS.format('value')}) || ' ' || CASE WHEN seq % 40 = 0 THEN '' ELSE ({_WAS.format('(value * 2)')})::VARCHAR END"),
    "image": ("false", "false", "seq % 10 = 0", "false", "(seq % 10 = 0)::VARCHAR"),
    "odometry": ("seq % 40 = 0", "false", "false", "false", "CASE WHEN seq % 40 <> 0 THEN value::VARCHAR END"),
    "joint_state": ("seq % 9 <> 0 AND seq % 40 = 0", "false", "seq % 9 = 0", "false", "value || ' ' || (seq % 9 = 0) || ' ' || (seq % 9 <> 0 AND seq % 40 = 0)"),
    "gnss": ("seq % 40 = 0", "false", "false", "false", "NULL::VARCHAR"),
    "battery": ("seq % 33 = 0", "false", "false", "false", "NULL::VARCHAR"),
}
_FLAGS = ("invalid", "empty", "malformed", "saturated")
COUNTERS = (
    "z AS (" + " UNION ALL ".join(f"SELECT '{r}' AS role, bag_id, topic, seq, {', '.join(f'{c} AS {n}' for c, n in zip(x, (*_FLAGS, 'sig'), strict=True))} FROM m" for r, x in _ROLE.items())
    + f"""), first_of AS (SELECT *, CASE WHEN sig = lag(sig) OVER (PARTITION BY role, bag_id, topic ORDER BY seq) THEN 0 ELSE 1 END AS new FROM z WHERE sig IS NOT NULL),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY role, bag_id, topic ORDER BY seq) AS run FROM first_of), runs AS (SELECT role, bag_id, topic, run, count(*) - 1 AS n FROM numbered GROUP BY ALL),
longest AS (SELECT role, bag_id, topic, sum(n) AS repeated_samples, max(n) AS max_repeat_run FROM runs GROUP BY ALL),
counts AS (SELECT role, bag_id, topic, samples, invalid, empty, malformed, saturated, coalesce(repeated_samples, 0) AS repeated_samples, coalesce(max_repeat_run, 0) AS max_repeat_run
    FROM (SELECT role, bag_id, topic, count(*) AS samples, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FLAGS)} FROM z GROUP BY ALL) LEFT JOIN longest USING (role, bag_id, topic))"""
)
#: Issues ``i`` of timing, headers, QoS and bags, and one row of each id in ``u``.
ISSUES = f"{SUMMARY}, {lag_sql()}, {QOS_ROWS}, {BAG_ROWS}, i AS ({union([TIMING, HEADERS, QOS, BAGS])})"
RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::BIGINT"


def least(src: str) -> str:
    """One row of each issue id: the most severe, then the first by title and evidence."""
    return f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY bag_id, issue_id ORDER BY {RANK}, title, evidence) = 1"


ORACLES = {
    "timing_issues": f"WITH {MESSAGES}, {SUMMARY} {TIMING}",
    "header_issues": f"WITH {MESSAGES}, {lag_sql()} {HEADERS}",
    "clock_domain_issues": f"WITH {MESSAGES}, {CLOCKS} {CLOCK}",
    "qos_issues": f"WITH {MESSAGES}, {QOS_ROWS} {QOS}",
    "coverage_issues": f"WITH {MESSAGES}, {COVERED} {COVERAGE}",
    "tf_edge_summary": f"WITH {MESSAGES}, {EDGES} SELECT bag_id, parent, child, is_static, invalid, samples, step_count, reversals, static_changes, {', '.join(f'round({c}, 4) AS {c}' for c in EDGE_FIGURES)} FROM edges",
    "sensor_counters": f"WITH {MESSAGES}, {COUNTERS} SELECT role, sum(samples)::BIGINT AS samples, {', '.join(f'sum({c})::BIGINT AS {c}' for c in (*_FLAGS, 'repeated_samples'))}, max(max_repeat_run) AS max_repeat_run FROM counts GROUP BY 1",
    "dedupe_issues": f"WITH {MESSAGES}, {ISSUES}, b AS (SELECT * FROM i UNION ALL SELECT * REPLACE ('notice' AS severity) FROM i) SELECT bag_id, issue_id, severity FROM ({least('b')})",
    "issue_order": f"WITH {MESSAGES}, {ISSUES} SELECT bag_id, {RANK} AS rank, category, title, issue_id FROM ({least('i')})",
    "issue_topic_status": f"""WITH {MESSAGES}, {ISSUES}, r AS (SELECT bag_id, topic, min({RANK}) AS r FROM i GROUP BY ALL)
SELECT bag_id, topic, CASE r WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' WHEN 3 THEN 'notice' ELSE 'normal' END AS status FROM (SELECT DISTINCT bag_id, topic FROM m) LEFT JOIN r USING (bag_id, topic)""",
    "top_recommendations": f"""WITH {MESSAGES}, {ISSUES}, o AS (SELECT *, {RANK} AS r FROM i WHERE suggestion <> '' QUALIFY row_number() OVER (PARTITION BY bag_id, suggestion ORDER BY {RANK}, category, title, issue_id) = 1),
p AS (SELECT bag_id, row_number() OVER (PARTITION BY bag_id ORDER BY r, category, title, issue_id, suggestion)::INT AS position, suggestion FROM o) SELECT * FROM p WHERE position <= 12""",
    "report_summary": f"""WITH {MESSAGES}, {ISSUES}, k AS (SELECT bag_id, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('critical', 'warning', 'notice'))} FROM ({least('i')}) GROUP BY 1),
a AS (SELECT bag_id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(notice, 0) AS notice FROM bags LEFT JOIN k USING (bag_id))
SELECT a.*, greatest(0, least(100, 100 - 18 * critical - 7 * warning - notice)) AS score, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'healthy' END AS status,
    coalesce(o, 0) AS observed_messages, coalesce(d, 0) AS decoded_messages, coalesce(dt, 0) AS decoded_topics, coalesce(t, 0) AS total_topics, coalesce(round(100.0 * dt / t, 6), 0)::DOUBLE AS coverage_pct
FROM a LEFT JOIN (SELECT bag_id, count(*) AS o, count(*) FILTER (topic IN ('/view', '/click')) AS d, count(DISTINCT topic) FILTER (topic IN ('/view', '/click')) AS dt, count(DISTINCT topic) AS t FROM m GROUP BY 1) USING (bag_id)""",
}
