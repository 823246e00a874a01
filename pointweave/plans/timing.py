"""Topic timing queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import telemetry as T
from ..operators import sequences as S
from ..operators import timing as O
from .tables import MESSAGES, messages, rounded

# the message figures of one time column, by bag and topic
_SUMMARY = """
d AS (SELECT bag_id, topic, {time} AS t, {time} - lag({time}) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS dt FROM {src}),
f AS (SELECT bag_id, topic, count(*) AS message_count, min(t) AS first_ns, max(t) AS last_ns, count(*) FILTER (dt = 0) AS duplicates,
    count(*) FILTER (dt < 0) AS reversals, max(dt) FILTER (dt > 0) AS max_gap, quantile_cont(dt::DOUBLE, 0.5) FILTER (dt > 0) AS m,
    quantile_cont(dt::DOUBLE, 0.95) FILTER (dt > 0) AS p95, quantile_cont(dt::DOUBLE, 0.99) FILTER (dt > 0) AS p99 FROM d GROUP BY ALL),
g AS (SELECT bag_id, topic, avg(dt) FILTER (dt <= 3 * m) AS mean, stddev_pop(dt) FILTER (dt <= 3 * m) AS std,
    quantile_cont(abs(dt - m), 0.95) FILTER (dt <= 3 * m) AS p95j, count(*) FILTER (dt > 3 * m) AS gap_count,
    coalesce(sum(greatest(1, round_even(dt / m, 0) - 1)) FILTER (dt > 3 * m), 0)::BIGINT AS estimated_drops
    FROM d JOIN f USING (bag_id, topic) WHERE dt > 0 GROUP BY ALL),
s AS (SELECT bag_id, topic, message_count, first_ns, last_ns, (last_ns - first_ns) / 1e9 AS duration_s,
    CASE WHEN last_ns > first_ns AND message_count > 1 THEN (message_count - 1) * 1e9 / (last_ns - first_ns) END AS mean_hz, 1e9 / m AS median_hz,
    mean / 1e6 AS mean_period_ms, m / 1e6 AS median_period_ms, p95 / 1e6 AS p95_period_ms, p99 / 1e6 AS p99_period_ms, std / 1e6 AS jitter_std_ms,
    std / mean * 100 AS jitter_cv_pct, p95j / 1e6 AS p95_jitter_ms, coalesce(max_gap / 1e6, 0) AS max_gap_ms, coalesce(gap_count, 0) AS gap_count,
    coalesce(estimated_drops, 0) AS estimated_drops, coalesce(estimated_drops, 0) / (message_count + coalesce(estimated_drops, 0)) * 100 AS drop_pct, duplicates, reversals
    FROM f LEFT JOIN g USING (bag_id, topic))"""
_FLOATS = "duration_s mean_hz median_hz mean_period_ms median_period_ms p95_period_ms p99_period_ms jitter_std_ms jitter_cv_pct p95_jitter_ms max_gap_ms drop_pct".split()
_SHOWN = "bag_id, topic, message_count, first_ns, last_ns, gap_count, estimated_drops, duplicates, reversals, " + ", ".join(f"round({c}, 4) AS {c}" for c in _FLOATS)


_LAGS = "lag_mean_ms lag_median_ms lag_p95_abs_ms lag_max_abs_ms lag_p95_residual_ms".split()


def lag_sql(src: str = "m") -> str:
    """DuckDB's ``lags``: header stamps of each topic against storage times."""
    return f"""lags AS (WITH h AS (SELECT *, CASE WHEN header_ns <> 0 THEN header_ns END AS h FROM {src}),
b AS (SELECT bag_id, topic, count(*) FILTER (h < p) AS backward_stamps FROM (SELECT bag_id, topic, h, lag(h) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS p FROM h WHERE h IS NOT NULL) GROUP BY ALL),
l AS (SELECT *, (storage_ns - h) / 1e6 AS lag FROM h),
f AS (SELECT bag_id, topic, count(*) AS decoded, count(h) AS valid, count(*) FILTER (h IS NULL) AS missing_or_zero, avg(lag) AS a, median(lag) AS m, quantile_cont(abs(lag), 0.95) AS p, max(abs(lag)) AS x FROM l GROUP BY ALL),
r AS (SELECT bag_id, topic, quantile_cont(abs(lag - m), 0.95) AS r FROM l JOIN f USING (bag_id, topic) GROUP BY ALL)
SELECT bag_id, topic, decoded, valid, missing_or_zero, a AS lag_mean_ms, m AS lag_median_ms, p AS lag_p95_abs_ms, x AS lag_max_abs_ms,
coalesce(backward_stamps, 0) AS backward_stamps, r AS lag_p95_residual_ms, CASE WHEN valid = 0 THEN 'unknown' WHEN abs(m) >= 86400000 THEN 'separate_epoch' ELSE 'aligned' END AS clock_relation
FROM f LEFT JOIN b USING (bag_id, topic) LEFT JOIN r USING (bag_id, topic))"""


def summary_sql(time: str = "storage_ns", src: str = "m") -> str:
    return _SUMMARY.replace("{time}", time).replace("{src}", src)


def interval_summary(spark, sf_dir):
    return rounded(O.interval_summary(messages(spark, sf_dir)), 4)


def interval_summary_bucketed(spark, sf_dir):
    return rounded(O.interval_summary(messages(spark, sf_dir), bucket_rows=500), 4)


def intervals(spark, sf_dir):
    return S.intervals(messages(spark, sf_dir), ["bag_id", "topic"], "seq", "storage_ns").select("bag_id", "topic", "seq", "dt", "interval_class").where("dt is not null")


def gap_drop_estimate(spark, sf_dir):
    return rounded(O.interval_summary(messages(spark, sf_dir), gap_factor=2.0).select("bag_id", "topic", "gap_count", "estimated_drops", "drop_pct"), 4)


def header_lag(spark, sf_dir):
    return rounded(O.header_lag(messages(spark, sf_dir)), 4)


def header_storage_choose(spark, sf_dir):
    out = O.choose_time_basis(messages(spark, sf_dir))
    return rounded(out.select("bag_id", "topic", "time_basis", "timing.message_count", "timing.mean_hz", "timing.median_period_ms"), 4)


def sample_rescale(spark, sf_dir):
    sample = O.payload_stride(messages(spark, sf_dir), 40)
    total = messages(spark, sf_dir).groupBy("bag_id", "topic").agg(F.count("*").alias("total"))
    out = O.rescale_sampled(O.interval_summary(sample).join(total, ["bag_id", "topic"]), F.col("message_count"), F.col("total"))
    return rounded(out.select("bag_id", "topic", "total", "mean_hz", "median_period_ms", "estimated_drops", "drop_pct"), 4)


def bag_inventory(spark, sf_dir):
    return O.inventory(messages(spark, sf_dir))


def _topics(m):
    return m.groupBy("bag_id", "topic").agg(F.max("msgtype").alias("msgtype"), F.max("seq").alias("declared_count"))


def topic_message_join(spark, sf_dir):
    m = messages(spark, sf_dir)
    return O.with_topics(m.select("bag_id", "topic", "seq"), _topics(m).select("bag_id", "topic", "msgtype"))


def topic_left_count(spark, sf_dir):
    m = messages(spark, sf_dir)
    topics = _topics(m).select("bag_id", "topic")
    return O.count_by_topic(topics.unionByName(topics.select("bag_id", F.lit("/unused").alias("topic")).distinct()), m)


def merge_topic_metadata(spark, sf_dir):
    m = messages(spark, sf_dir)
    declared = _topics(m).where(F.col("topic") != "/view").withColumn("declared_count", F.when(F.col("topic") == "/click", 0).otherwise(F.col("declared_count")))
    observed = m.where(F.col("topic") != "/error").groupBy("bag_id", "topic").agg(F.max("msgtype").alias("msgtype"), F.count("*").alias("message_count"))
    return O.merge_topic_metadata(declared, observed)


def classify_topic(spark, sf_dir):
    m = messages(spark, sf_dir)
    shown = m.withColumn("topic", F.concat(F.col("topic"), F.when(F.col("seq") % 3 == 0, "/cmd_vel").when(F.col("seq") % 3 == 1, "/map").otherwise("/plan/"))).select("topic", "msgtype").distinct()
    return O.classify_topics(shown)


def parse_qos(spark, sf_dir):
    text = F.when(F.col("seq") % 4 == 0, "reliability: reliable durability: volatile").when(F.col("seq") % 4 == 1, "reliability: best_effort\nreliability: reliable").when(F.col("seq") % 4 == 2, "history: 1 transient_local").otherwise(" ")
    m = messages(spark, sf_dir).withColumn("qos", T.parse_qos(F.when(F.col("topic") == "/view", "/tf_static").otherwise(F.col("topic")), text))
    return m.groupBy("topic", "qos.status", F.concat_ws("+", "qos.reliability").alias("reliability"), F.concat_ws("+", "qos.durability").alias("durability"), "qos.profile_count").agg(F.count("*").alias("n"))


def stamps(spark, sf_dir):
    m = messages(spark, sf_dir)
    ns = T.stamp_ns(F.floor(F.col("storage_ns") / 1_000_000_000).cast("string"), (F.col("storage_ns") % 1_000_000_000).cast("string"))
    return m.select("seq", ns.alias("stamp_ns"), T.ns_to_iso(F.col("storage_ns")).alias("iso"))


def payload_stride(spark, sf_dir):
    return O.payload_stride(messages(spark, sf_dir), 50).select("bag_id", "topic", "seq")


def repeat_run(spark, sf_dir):
    return S.longest_runs(messages(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 20)), ["bag_id", "topic"], "seq", "v")


def rank_select(spark, sf_dir):
    return rounded(S.exact_quantiles(messages(spark, sf_dir), "value", [0.005, 0.25, 0.5, 0.995]))


QUERIES = {f.__name__: f for f in (interval_summary, interval_summary_bucketed, intervals, gap_drop_estimate, header_lag, header_storage_choose, sample_rescale, bag_inventory, topic_message_join, topic_left_count, merge_topic_metadata, classify_topic, parse_qos, stamps, payload_stride, repeat_run, rank_select)}

_TOPICS = "t AS (SELECT bag_id, topic, max(msgtype) AS msgtype, max(seq) AS declared_count FROM m GROUP BY ALL)"
ORACLES = {
    "interval_summary": f"WITH {MESSAGES}, {summary_sql()} SELECT {_SHOWN} FROM s",
    "interval_summary_bucketed": f"WITH {MESSAGES}, {summary_sql()} SELECT {_SHOWN} FROM s",
    "intervals": f"""WITH {MESSAGES}, d AS (SELECT bag_id, topic, seq, storage_ns - lag(storage_ns) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS dt FROM m)
SELECT bag_id, topic, seq, dt, CASE WHEN dt = 0 THEN 'duplicate' WHEN dt < 0 THEN 'reversal' WHEN dt > 0 THEN 'positive' END AS interval_class FROM d WHERE dt IS NOT NULL""",
    "gap_drop_estimate": f"WITH {MESSAGES}, {summary_sql().replace('3 * m', '2 * m')} SELECT bag_id, topic, gap_count, estimated_drops, round(drop_pct, 4) AS drop_pct FROM s",
    "header_lag": f"WITH {MESSAGES}, {lag_sql()} SELECT bag_id, topic, decoded, valid, missing_or_zero, {', '.join(f'round({c}, 4) AS {c}' for c in _LAGS)}, backward_stamps, clock_relation FROM lags",
    "header_storage_choose": f"""WITH {MESSAGES}, a AS (WITH {summary_sql()} SELECT * FROM s), v AS (SELECT * FROM m WHERE header_ns <> 0),
b AS (WITH {summary_sql("header_ns", "v")} SELECT * FROM s), j AS (SELECT bag_id, topic, coalesce(b.message_count >= 10 AND b.message_count >= 0.8 * a.message_count, false) AS ok, a, b FROM a LEFT JOIN b USING (bag_id, topic))
SELECT bag_id, topic, CASE WHEN ok THEN 'header' ELSE 'storage' END AS time_basis, CASE WHEN ok THEN b.message_count ELSE a.message_count END AS message_count,
round(CASE WHEN ok THEN b.mean_hz ELSE a.mean_hz END, 4) AS mean_hz, round(CASE WHEN ok THEN b.median_period_ms ELSE a.median_period_ms END, 4) AS median_period_ms FROM j""",
    "sample_rescale": f"""WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY bag_id, topic ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY bag_id, topic) AS total FROM m),
a AS (SELECT * FROM k WHERE r % ceil(total / 40)::BIGINT = 0), n AS (SELECT bag_id, topic, max(total) AS total FROM k GROUP BY ALL), {summary_sql(src="a")},
j AS (SELECT *, total / message_count AS scale, round_even(estimated_drops * (total / message_count), 0)::BIGINT AS lost FROM s JOIN n USING (bag_id, topic))
SELECT bag_id, topic, total, round(CASE WHEN duration_s > 0 THEN (total - 1) / duration_s END, 4) AS mean_hz, round(median_period_ms / scale, 4) AS median_period_ms, lost AS estimated_drops, round(lost / (total + lost) * 100, 4) AS drop_pct FROM j""",
    "bag_inventory": f"WITH {MESSAGES} SELECT bag_id, topic, count(*) AS message_count, min(storage_ns) AS first_ns, max(storage_ns) AS last_ns FROM m GROUP BY GROUPING SETS ((bag_id, topic), (bag_id))",
    "topic_message_join": f"WITH {MESSAGES}, {_TOPICS} SELECT bag_id, topic, seq, t.msgtype FROM m JOIN t USING (bag_id, topic)",
    "topic_left_count": f"WITH {MESSAGES}, {_TOPICS} SELECT bag_id, topic, count(*) AS message_count FROM m GROUP BY ALL UNION ALL SELECT DISTINCT bag_id, '/unused', 0 FROM m",
    "merge_topic_metadata": f"""WITH {MESSAGES}, {_TOPICS}, d AS (SELECT * REPLACE (CASE WHEN topic = '/click' THEN 0 ELSE declared_count END AS declared_count) FROM t WHERE topic <> '/view'),
o AS (SELECT bag_id, topic, max(msgtype) AS msgtype, count(*) AS n FROM m WHERE topic <> '/error' GROUP BY ALL)
SELECT bag_id, topic, coalesce(nullif(d.msgtype, ''), o.msgtype) AS msgtype, coalesce(CASE WHEN coalesce(declared_count, 0) = 0 THEN n ELSE declared_count END, 0) AS message_count, coalesce(n, 0) AS observed_count FROM d FULL JOIN o USING (bag_id, topic)""",
    "classify_topic": f"""WITH {MESSAGES}, t AS (SELECT DISTINCT topic || CASE seq % 3 WHEN 0 THEN '/cmd_vel' WHEN 1 THEN '/map' ELSE '/plan/' END AS topic, msgtype FROM m)
SELECT topic, msgtype, topic LIKE '%/cmd_vel' AS is_control, topic LIKE '%/map' AS is_static, topic NOT LIKE '%/cmd_vel' AS is_event,
CASE WHEN msgtype LIKE '%/Imu' THEN 'imu' WHEN msgtype LIKE '%/LaserScan' THEN 'scan' WHEN msgtype LIKE '%/Odometry' THEN 'odometry' WHEN msgtype LIKE '%/DiagnosticArray' THEN 'diagnostics' END AS role,
CASE WHEN topic LIKE '%/cmd_vel' THEN 20.0 WHEN msgtype LIKE '%/Imu' THEN 50.0 WHEN msgtype LIKE '%/Odometry' THEN 10.0 WHEN msgtype LIKE '%/LaserScan' THEN 5.0 END::DOUBLE AS least_hz FROM t""",
    "parse_qos": f"""WITH {MESSAGES}, q AS (SELECT topic, seq % 4 AS k FROM m)
SELECT topic, CASE WHEN k = 3 THEN 'unknown' WHEN k = 0 AND topic = '/view' THEN 'risky' WHEN k = 1 THEN 'mixed' ELSE 'recorded' END AS status,
CASE k WHEN 0 THEN 'RELIABLE' WHEN 1 THEN 'RELIABLE+BEST_EFFORT' ELSE '' END AS reliability, CASE k WHEN 0 THEN 'VOLATILE' WHEN 2 THEN 'TRANSIENT_LOCAL' ELSE '' END AS durability,
CASE k WHEN 1 THEN 2 ELSE 1 END AS profile_count, count(*) AS n FROM q GROUP BY ALL""",
    "stamps": f"WITH {MESSAGES} SELECT seq, storage_ns AS stamp_ns, strftime(make_timestamp(storage_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM m",
    "payload_stride": f"""WITH {MESSAGES}, r AS (SELECT bag_id, topic, seq, row_number() OVER w - 1 AS r, ceil(count(*) OVER (PARTITION BY bag_id, topic) / 50)::BIGINT AS k FROM m WINDOW w AS (PARTITION BY bag_id, topic ORDER BY seq))
SELECT bag_id, topic, seq FROM r WHERE r % k = 0""",
    "repeat_run": f"""WITH {MESSAGES}, v AS (SELECT bag_id, topic, seq, floor(value / 20) AS v FROM m), n AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY bag_id, topic ORDER BY seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY bag_id, topic ORDER BY seq) AS run FROM n), c AS (SELECT bag_id, topic, run, count(*) - 1 AS c FROM r GROUP BY ALL)
SELECT bag_id, topic, sum(c)::BIGINT AS repeated_samples, max(c) AS max_repeat_run FROM c GROUP BY ALL""",
    "rank_select": "SELECT unnest([0.005, 0.25, 0.5, 0.995])::DOUBLE AS p, round(unnest(quantile_cont(value, [0.005, 0.25, 0.5, 0.995])), 6) AS value FROM events",
}
