"""Topic classes, rates, QoS texts, stamps and payload signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role by the end of the message type (fixed values, in order of precedence).
ROLES = (
    ("imu", "/imu$"),
    ("scan", "/laserscan$"),
    ("pointcloud", "/pointcloud2$|pointcloud"),
    ("livox", "livox.*/custommsg$"),
    ("image", "/(image|compressedimage)$"),
    ("odometry", "/odometry$"),
    ("joint_state", "/jointstate$"),
    ("gnss", "/navsatfix$"),
    ("battery", "/batterystate$"),
)
#: Last parts of topics that publish on events only (fixed values).
EVENT_TOPICS = ("amcl_pose", "clicked_point", "goal", "goal_pose", "initialpose", "parameter_events", "particle_cloud", "path", "plan", "waypoints")
#: Least rate in Hz by the end of the message type (fixed values).
LEAST_RATES = (("/imu$", 50.0), ("/odometry$", 10.0), ("/(laserscan|pointcloud2)$", 5.0))


def _plain(topic: Column) -> Column:
    return F.lower(F.regexp_replace(topic, "/+$", ""))


#: Words that mark topics and types of control (fixed values); they stand between separators.
CONTROL_WORDS = ("cmd_vel", "command", "setpoint", "control", "actuator", "motor")
SEPARATED = r"[/_\s]"


def is_control(topic: Column, kind: Column) -> Column:
    """Whether a word of control stands by itself in a topic or its type."""
    words = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", topic, kind)), F.lit(" "))
    return words.rlike(f"{SEPARATED}(?:{'|'.join(CONTROL_WORDS)}){SEPARATED}")


def is_static(topic: Column) -> Column:
    return (_plain(topic) == "/tf_static") | F.substring_index(_plain(topic), "/", -1).isin("map", "robot_description")


def is_event_driven(topic: Column) -> Column:
    return is_static(topic) | F.substring_index(_plain(topic), "/", -1).isin(*EVENT_TOPICS)


def is_transform_stream(topic: Column) -> Column:
    return F.regexp_replace(topic, "/+$", "") == "/tf"


def role(topic: Column, kind: Column) -> Column:
    """The sensor role of a topic, null for none."""
    out = F.when(F.lower(kind).rlike("/diagnosticarray$") | (F.lower(topic) == "/diagnostics"), "diagnostics")
    for name, pattern in reversed(ROLES):
        out = F.when(F.lower(kind).rlike(pattern), name).otherwise(out)
    return out


def least_rate(topic: Column, kind: Column, control_hz: float = 20.0) -> Column:
    """The least rate expected of a topic in Hz, null for none."""
    out = F.when(F.regexp_replace(topic, "/+$", "").endswith("/tf"), F.lit(10.0))
    for pattern, hz in reversed(LEAST_RATES):
        out = F.when(F.lower(kind).rlike(pattern), F.lit(hz)).otherwise(out)
    return F.when(is_control(topic, kind), F.lit(float(control_hz))).otherwise(out)


def _count(text: Column, token: str) -> Column:
    return F.size(F.split(text, token)) - 1


def parse_qos(topic: Column, text: Column) -> Column:
    """A struct of status, reliability, durability and profile_count from a recorded QoS text."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    reliability = F.array_compact(F.array(*[F.when(upper.contains(t), F.lit(t)) for t in ("RELIABLE", "BEST_EFFORT")]))
    durability = F.array_compact(F.array(*[F.when(upper.contains(t), F.lit(t)) for t in ("TRANSIENT_LOCAL", "VOLATILE")]))
    status = (
        F.when(F.trim(upper) == "", "unknown")
        .when(topic.endswith("tf_static") & upper.contains("VOLATILE"), "risky")
        .when((F.size(reliability) > 1) | (F.size(durability) > 1), "mixed")
        .otherwise("recorded")
    )
    return F.struct(status.alias("status"), reliability.alias("reliability"), durability.alias("durability"), F.greatest(_count(upper, "HISTORY:"), _count(upper, "RELIABILITY:"), F.lit(1)).alias("profile_count"))


def stamp_ns(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds of a two-part stamp; null if a part is null or does not parse."""
    return F.expr("try_cast(null as bigint)") if seconds is None else seconds.try_cast("bigint") * F.lit(1_000_000_000) + nanos.try_cast("bigint")


def ns_to_iso(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.call_function("div", ns, F.lit(1000)).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def frame_name(name: Column) -> Column:
    """A frame id without blanks around and slashes before it."""
    return F.regexp_replace(F.trim(name), "^/+", "")


def payload_signature(payload: Column, ends: int | None = None) -> Column:
    """Length and a hash of the whole payload, or of its first and last ``ends`` bytes (2,048 for a cheap one); ``empty`` for none."""
    read = payload if ends is None else F.concat(F.substring(payload, 1, ends), F.substring(payload, -ends, ends))
    return F.when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, "empty").otherwise(F.concat_ws(":", F.octet_length(payload), F.hex(F.xxhash64(read))))
