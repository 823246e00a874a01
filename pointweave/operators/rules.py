"""Issue rules: filters over figures that give rows of one issue table; report and score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import telemetry as T

SEVERITIES = ("critical", "warning", "notice")
COLUMNS = ("bag_id", "issue_id", "severity", "category", "topic", "title", "evidence", "suggestion", "confidence")


@dataclass(frozen=True)
class DiagnosticOptions:
    gap_factor: float = 3.0
    jitter_warning: float = 20.0
    jitter_critical: float = 60.0
    drop_warning: float = 1.0
    drop_critical: float = 5.0
    control_hz: float = 20.0
    lag_warning_ms: float = 100.0
    jump_m: float = 0.5
    jump_deg: float = 30.0
    speed_mps: float = 10.0

    def __post_init__(self) -> None:
        if min(self.gap_factor, self.jitter_warning, self.drop_warning, self.control_hz, self.jump_m, self.speed_mps) <= 0:
            raise ValueError("thresholds must be positive")
        if self.jitter_critical < self.jitter_warning or self.drop_critical < self.drop_warning:
            raise ValueError("a critical threshold is below its warning")


def issue(rows: DataFrame, rule: str, when: Column, severity: Column | str, category: Column | str, title: str, evidence: Column, suggestion: str = "", confidence: str = "medium", subject: str | None = "topic") -> tuple[DataFrame, Column]:
    """Rows and the issue that each of them makes if it meets the condition, else null."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    name = F.col(subject).cast("string") if subject else F.lit(None).cast("string")
    values = (F.concat_ws(":", F.lit(rule), name), lit(severity), lit(category), name, F.lit(title), evidence.cast("string"), F.lit(suggestion), F.lit(confidence))
    return rows, F.when(F.coalesce(when, F.lit(False)), F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS[1:], strict=True)]))


def union(issues: Sequence[tuple[DataFrame, Column] | DataFrame]) -> DataFrame:
    """The issue table; all rules on the same rows are one pass over them."""
    shared: dict[int, tuple[DataFrame, list[Column]]] = {}
    parts = []
    for i in issues:
        if isinstance(i, DataFrame):
            parts.append(i)
        else:
            shared.setdefault(id(i[0]), (i[0], []))[1].append(i[1])
    parts += [rows.select("bag_id", F.explode(F.array_compact(F.array(*made))).alias("i")).select("bag_id", "i.*") for rows, made in shared.values()]
    return reduce(DataFrame.unionByName, parts)


def shown(figure: Column | str, digits: int) -> Column:
    """A figure in plain decimals, whatever its size; one that floating point puts just below a tie rounds as the tie."""
    return F.round(F.round(figure, digits + 6), digits).cast(f"decimal(38,{digits})").cast("string")


def _graded(critical: Column) -> Column:
    return F.when(critical, "critical").otherwise("warning")


def timing_issues(summary: DataFrame, o: DiagnosticOptions) -> DataFrame:
    """Rules on ``interval_summary`` joined with ``msgtype``."""
    topic, kind, n = F.col("topic"), F.col("msgtype"), F.col("message_count")
    s = summary.withColumns({"expected": T.least_rate(topic, kind, o.control_hz), "static": T.is_static(topic), "event": T.is_event_driven(topic), "tf": T.is_transform_stream(topic), "category": F.when(T.is_control(topic, kind), "control").otherwise("rate")})
    steady = ~F.col("event") & ~F.col("tf")
    hz, e, cv, drop, dup = F.col("mean_hz"), F.col("expected"), F.col("jitter_cv_pct"), F.col("drop_pct"), F.col("duplicates")
    return union([
        issue(s, "TOPIC_SINGLE_MESSAGE", (n == 1) & ~F.col("static"), "notice", "rate", "Only one message", n, "Check that the topic is published once by design."),
        issue(s, "TOPIC_RATE_LOW", hz + F.greatest(F.lit(0.01), e * 0.005) < e, _graded(hz < e * 0.5), F.col("category"), "Rate below its baseline", shown(hz, 2), "Check timers, load and queues."),
        issue(s, "TOPIC_JITTER", (n >= 10) & steady & (cv > o.jitter_warning), _graded(cv > o.jitter_critical), F.col("category"), "Unsteady period", shown(cv, 1), "Check blocking callbacks and priorities.", "high"),
        issue(s, "TOPIC_GAPS", steady & (drop > o.drop_warning), _graded(drop > o.drop_critical), "loss", "Messages seem to be missing", shown(drop, 2), "Compare with the publisher's counters."),
        issue(s, "STORAGE_TIME_BACKWARDS", F.col("reversals") > 0, "critical", "stamps", "Storage time runs backwards", F.col("reversals"), "Check clock jumps.", "high"),
        issue(s, "STORAGE_TIME_DUPLICATE", (n > 1) & (dup / (n - 1) > 0.01), "warning", "stamps", "Many equal storage times", dup, "Check the resolution of stamps."),
    ])


def header_issues(lag: DataFrame, o: DiagnosticOptions) -> DataFrame:
    p95 = F.col("lag_p95_abs_ms")
    return union([
        issue(lag, "HEADER_STAMP_MISSING", F.col("missing_or_zero") > 0.05 * F.col("decoded"), "warning", "stamps", "Header stamps are missing", F.col("missing_or_zero")),
        issue(lag, "HEADER_STAMP_BACKWARDS", F.col("backward_stamps") > 0, "critical", "stamps", "Header time runs backwards", F.col("backward_stamps")),
        issue(lag, "HEADER_STORAGE_LAG", (F.col("clock_relation") == "aligned") & (p95 > o.lag_warning_ms), _graded(p95 > max(10_000.0, 100 * o.lag_warning_ms)), "stamps", "Storage lags behind the header", shown(p95, 1)),
    ])


def preview(names: Column, most: int = 6) -> Column:
    """The first names of a set and how many more there are."""
    s = F.array_sort(names)
    return F.concat(F.array_join(F.slice(s, 1, most), ", "), F.when(F.size(s) > most, F.concat(F.lit(" and "), F.size(s) - most, F.lit(" more"))).otherwise(""))


def clock_issues(lag: DataFrame, clock_bags: DataFrame) -> DataFrame:
    """One issue a bag with topics of a separate clock; a notice where the bag has a recorded clock (``bag_id``)."""
    apart = lag.where("clock_relation = 'separate_epoch'").groupBy("bag_id").agg(preview(F.collect_set("topic")).alias("names"))
    marked = apart.join(clock_bags.select("bag_id", F.lit(True).alias("clock")).distinct(), "bag_id", "left")
    return union([issue(marked, "HEADER_STORAGE_CLOCK_DOMAIN", F.lit(True), F.when(F.col("clock"), "notice").otherwise("warning"), "stamps", "Header and storage clocks differ", F.col("names"), subject=None)])


def qos_issues(topics: DataFrame) -> DataFrame:
    """``bag_id, topic, qos_text, ros_version`` to QoS issues."""
    q = topics.withColumn("qos", T.parse_qos(F.col("topic"), F.col("qos_text")))
    missing = q.where((F.col("qos.status") == "unknown") & (F.col("ros_version") == 2)).groupBy("bag_id").agg(preview(F.collect_set("topic")).alias("names"))
    return union([issue(missing, "QOS_METADATA_MISSING", F.lit(True), "notice", "QoS", "QoS was not recorded", F.col("names"), subject=None), issue(q, "QOS_RISK", F.col("qos.status").isin("mixed", "risky"), "warning", "QoS", "Playback may not match subscribers", F.col("qos.status"))])


def bag_issues(bags: DataFrame, inventory: DataFrame) -> DataFrame:
    """Declared counts against observed ones."""
    seen = inventory.where(F.col("topic").isNull()).select("bag_id", F.col("message_count").alias("observed"))
    b = bags.join(seen, "bag_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return union([
        issue(b, "BAG_METADATA", F.col("declared_count") != F.col("observed"), "warning", "bag", "Declared and stored counts differ", F.concat_ws("/", "declared_count", "observed"), subject=None),
        issue(b, "BAG_EMPTY", F.col("observed") == 0, "critical", "bag", "No messages", F.col("observed"), subject=None),
    ])


def coverage_issues(coverage: DataFrame) -> DataFrame:
    """``bag_id, decoded_topics, total_topics, sampled``: what was not looked at."""
    return union([
        issue(coverage, "DEEP_ANALYSIS_DISABLED", F.col("decoded_topics") == 0, "notice", "coverage", "No payload was decoded", F.col("total_topics"), subject=None),
        issue(coverage, "PAYLOAD_DECODE_PARTIAL", (F.col("decoded_topics") > 0) & (F.col("decoded_topics") < F.col("total_topics")), "notice", "coverage", "Some topics were not decoded", F.concat_ws("/", "decoded_topics", "total_topics"), subject=None),
        issue(coverage, "TF_TIMING_SAMPLED", F.col("sampled"), "notice", "coverage", "Transforms were sampled", F.lit("sampled"), subject=None),
    ])


def transform_issues(edges: DataFrame, parents: DataFrame, parts: DataFrame, cycles: DataFrame, bags: DataFrame, o: DiagnosticOptions, complete: bool = True) -> DataFrame:
    e = edges.withColumn("edge", F.concat_ws("->", "parent", "child"))
    moves = ~F.col("is_static")
    many = F.col("step_count") >= 5

    def limit(least: float, median: str) -> Column:
        return F.when(many, F.greatest(F.lit(least), 10 * F.col(median))).otherwise(least)

    several = parts.groupBy("bag_id").agg(F.count_distinct("component").alias("n")).where("n > 1")
    none = bags.join(edges.select("bag_id").distinct(), "bag_id", "left_anti")
    return union([
        issue(none, "TF_NOT_RECORDED", F.lit(True), "notice", "transforms", "No transforms", F.lit("0"), subject=None),
        issue(parents, "TF_MULTIPLE_PARENTS", F.lit(True), "critical", "transforms", "A frame has several parents", F.array_join("parents", ", "), subject="child"),
        issue(e, "TF_STATIC_CHANGED", F.col("static_changes") > 0, "warning", "transforms", "A static transform changes", F.col("static_changes"), subject="edge"),
        issue(e, "TF_TIME_BACKWARDS", F.col("reversals") > 0, "critical", "transforms", "Transform time runs backwards", F.col("reversals"), subject="edge"),
        issue(e, "TF_TRANSLATION_JUMP", moves & (F.col("max_step_m") > limit(o.jump_m, "median_step_m")), "warning", "transforms", "Translation jumps", shown("max_step_m", 3), subject="edge"),
        issue(e, "TF_ROTATION_JUMP", moves & (F.col("max_step_deg") > limit(o.jump_deg, "median_step_deg")), "warning", "transforms", "Rotation jumps", shown("max_step_deg", 3), subject="edge"),
        issue(e, "TF_SPEED_SPIKE", moves & (F.col("max_speed_mps") > o.speed_mps), "warning", "transforms", "Implausible speed", shown("max_speed_mps", 2), subject="edge"),
        issue(e, "TF_GAP", moves & F.lit(complete) & (F.col("max_gap_ms") > o.gap_factor * F.col("median_period_ms")), "warning", "transforms", "A transform pauses", shown("max_gap_ms", 1), subject="edge"),
        issue(e, "TF_QUATERNION_NORM", F.col("p95_norm_error") > 0.05, "warning", "transforms", "Quaternions are not of unit length", shown("p95_norm_error", 4), subject="edge"),
        issue(several, "TF_DISCONNECTED_GRAPH", F.lit(True), "warning", "transforms", "The graph falls apart", F.col("n"), subject=None),
        issue(cycles, "TF_GRAPH_CYCLE", F.lit(True), "critical", "transforms", "The graph has a cycle", F.array_join("frames", ", "), subject="cycle"),
    ])


#: Metrics that the sensor rules judge; ``sensor_issues`` needs the figures of no others.
JUDGED = ("orientation_norm_error", "acceleration_step", "angular_velocity_step", "invalid_pct", "position_step", "no_fix", "percentage", "temperature")


def sensor_issues(counters: DataFrame, metrics: DataFrame) -> DataFrame:
    """``counters`` with ``role``, and ``scalar_summary`` rows."""
    n = F.col("samples")
    slow = F.col("role").isin("odometry", "joint_state")
    m = lambda name: F.col("metric") == name
    return union([
        issue(counters, "SENSOR_INVALID", F.col("invalid") > 0, _graded(F.col("invalid") > 0.2 * n), "sensors", "Invalid samples", F.col("invalid")),
        issue(counters, "SENSOR_EMPTY_OR_MALFORMED", F.col("empty") + F.col("malformed") > 0, "warning", "sensors", "Empty or malformed samples", F.col("empty") + F.col("malformed")),
        issue(counters, "SENSOR_SATURATION", F.col("saturated") > 0, "warning", "sensors", "Saturated samples", F.col("saturated")),
        issue(counters, "SENSOR_FROZEN", F.col("max_repeat_run") >= 10, F.when(slow, "notice").otherwise("warning"), "sensors", "Values stand still", F.col("max_repeat_run")),
        issue(metrics, "IMU_QUATERNION_NORM", m("orientation_norm_error") & (F.col("p95") > 0.05), "warning", "sensors", "Orientation is not of unit length", shown("p95", 4)),
        issue(metrics, "IMU_HIGH_SHORT_TERM_VARIATION", (m("acceleration_step") & (F.col("mad") > 1.0)) | (m("angular_velocity_step") & (F.col("mad") > 0.2)), "notice", "sensors", "Noisy inertial data", shown("mad", 4)),
        issue(metrics, "LIDAR_INVALID_RANGES", m("invalid_pct") & (F.col("p95") > 30), "warning", "sensors", "Many invalid ranges", shown("p95", 1)),
        issue(metrics, "ODOMETRY_POSITION_JUMP", m("position_step") & (F.col("max") > 2), "warning", "sensors", "The position jumps", shown("max", 2)),
        issue(metrics, "GNSS_NO_FIX", m("no_fix") & (F.col("max") > 0), "warning", "sensors", "No position fix at times", shown("mean", 4)),
        issue(metrics, "BATTERY_LOW", m("percentage") & (F.col("min") >= 0) & (F.col("min") < 0.1), "warning", "sensors", "Battery is low", shown("min", 3)),
        issue(metrics, "BATTERY_TEMPERATURE_HIGH", m("temperature") & (F.col("max") > 60), _graded(F.col("max") > 80), "sensors", "Battery is hot", shown("max", 1)),
    ])


def hardware_issues(faults: DataFrame) -> DataFrame:
    return union([issue(faults, "HARDWARE_DIAGNOSTIC", F.lit(True), _graded(F.col("level") >= 2), "hardware", "A component reports a fault", F.concat_ws(": ", "message", "n"), subject="name")])


def rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))


def dedupe(issues: DataFrame) -> DataFrame:
    """One row an issue id: the most severe, then the first by evidence."""
    w = Window.partitionBy("bag_id", "issue_id").orderBy(rank(), "title", "evidence")
    return issues.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered(issues: DataFrame) -> DataFrame:
    return issues.withColumn("rank", rank()).orderBy("bag_id", "rank", "category", "title", "issue_id")


def topic_status(topics: DataFrame, issues: DataFrame) -> DataFrame:
    """The worst severity of each topic, ``normal`` without issues."""
    worst = issues.groupBy("bag_id", "topic").agg(F.min(rank()).alias("r"))
    return topics.select("bag_id", "topic").join(worst, ["bag_id", "topic"], "left").withColumn("status", F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("r") - 1).cast("int")), F.lit("normal"))).drop("r")


def recommendations(issues: DataFrame, most: int = 12) -> DataFrame:
    """The first distinct suggestions of each bag, in issue order."""
    first = issues.where(F.col("suggestion") != "").groupBy("bag_id", "suggestion").agg(F.min(F.struct(rank(), F.col("category"), F.col("title"), F.col("issue_id"))).alias("o"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("bag_id").orderBy("o", "suggestion"))).where(F.col("position") <= most).select("bag_id", "position", "suggestion")


def summary(bags: DataFrame, issues: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Counts by severity, a score of 0 to 100 and a status for each bag; notices alone leave it healthy.

    With ``topics`` (``bag_id, topic, messages, decoded``: messages that there are, and messages that could be read) also
    messages, topics and the share of topics that could be read, in hundredths; 0 without topics.
    """
    counts = issues.groupBy("bag_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    out = bags.select("bag_id").distinct().join(counts, "bag_id", "left").fillna(0, list(SEVERITIES))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 18 * F.col("critical") - 7 * F.col("warning") - F.col("notice")))
    status = F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("healthy")
    out = out.withColumns({"score": score, "status": status})
    if topics is None:
        return out
    read = topics.groupBy("bag_id").agg(F.sum("messages").alias("observed_messages"), F.sum("decoded").alias("decoded_messages"), F.count_if(F.col("decoded") > 0).alias("decoded_topics"), F.count("*").alias("total_topics"))
    out = out.join(read, "bag_id", "left").fillna(0, [c for c in read.columns if c != "bag_id"])
    return out.withColumn("coverage_pct", F.when(F.col("total_topics") > 0, 100.0 * F.col("decoded_topics") / F.col("total_topics")).otherwise(0.0))


def write_report(path: str, summary: DataFrame, issues: DataFrame, topics: DataFrame) -> None:
    """One JSON document a bag with its issues and topics; NaN and infinities become null."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(*[F.when(F.abs(c) < F.lit(float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    def nested(df: DataFrame, name: str) -> DataFrame:
        return plain(df).groupBy("bag_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "bag_id"]))).alias(name))

    plain(summary).join(nested(issues, "issues"), "bag_id", "left").join(nested(topics, "topics"), "bag_id", "left").write.mode("overwrite").json(path)
