from pyspark.sql import functions as F

from pointweave.operators import rules as R
from pointweave.operators import timing as O
from pointweave.operators import transforms as G


def log(spark, times_ms, topic="/a", kind="x"):
    return spark.createDataFrame([("b", topic, kind, i, int(t * 1e6), int(t * 1e6)) for i, t in enumerate(times_ms)], "bag_id string, topic string, msgtype string, seq long, storage_ns long, header_ns long")


def test_regular(spark):
    r = O.interval_summary(log(spark, [10 * i for i in range(101)])).first()
    assert (r.mean_hz, r.median_period_ms, r.jitter_cv_pct, r.estimated_drops) == (100.0, 10.0, 0.0, 0)


def test_one_gap(spark):
    r = O.interval_summary(log(spark, [0, 10, 20, 30, 80, 90, 100])).first()
    assert (r.gap_count, r.estimated_drops, r.jitter_cv_pct) == (1, 4, 0.0)


def test_duplicates_and_reversals(spark):
    r = O.interval_summary(log(spark, [100, 110, 110, 105, 120])).first()
    assert (r.duplicates, r.reversals) == (1, 1)


def test_control_rules(spark):
    def ids(times):
        m = log(spark, times, "/cmd_vel", "geometry_msgs/msg/Twist")
        s = O.interval_summary(m).withColumn("msgtype", F.lit("geometry_msgs/msg/Twist"))
        return {r.issue_id.split(":")[0] for r in R.timing_issues(s, R.DiagnosticOptions()).collect()}

    assert not ids([50 * i for i in range(100)]) & {"TOPIC_RATE_LOW", "TOPIC_JITTER", "TOPIC_GAPS"}
    assert {"TOPIC_RATE_LOW", "TOPIC_GAPS", "STORAGE_TIME_BACKWARDS"} <= ids([0, 100, 200, 1200, 1100, 1300])


def test_graph(spark):
    e = spark.createDataFrame([("b", "map", "odom"), ("b", "odom", "base"), ("b", "base", "map"), ("b", "isolated", "camera"), ("b", "x", "base")], "bag_id string, parent string, child string")
    assert {r.component for r in G.components(e).collect()} == {"base", "camera"}
    assert [r.frames for r in G.cycles(e).collect()] == [["base", "map", "odom"]]
    assert G.multiple_parents(e).first().parents == ["odom", "x"]
    assert G.cycles(e.where("parent = 'isolated'")).count() == 0


def test_score(spark):
    bags = spark.createDataFrame([("b",), ("c",)], "bag_id string")
    issues = spark.createDataFrame([("b", "i", "critical"), ("b", "j", "warning")], "bag_id string, issue_id string, severity string")
    assert {r.bag_id: (r.score, r.status) for r in R.summary(bags, issues).collect()} == {"b": (75, "critical"), "c": (100, "healthy")}


def test_topic_message_join_returns_every_message(spark):
    from pointweave.plans import tables, timing

    folder = "/root/testdata/sf0.001"
    out = timing.topic_message_join(spark, folder)
    assert out.exceptAll(tables.messages(spark, folder).select("bag_id", "topic", "seq", "msgtype").select(*out.columns)).isEmpty()
    assert out.count() == tables.table(spark, folder, "events").count()


def test_tf_cycles_reads_all_bags(spark):
    from pointweave.plans import telemetry

    rows = {tuple(r) for r in telemetry.tf_cycles(spark, "/root/testdata/sf0.001").collect()}
    chain = lambda k: ",".join(f"n{k + 5 * i:02}" for i in range(5))
    assert rows == {("loop", f"n{k:02}", chain(k)) for k in range(5)} | {(str(k), f"n{k:02}", chain(k)) for k in range(3)}


def test_signature_reads_the_whole_payload(spark):
    from pointweave.functions.telemetry import payload_signature

    payloads = [b"a" * 5000 + m + b"a" * 5000 for m in (b"x", b"y")]
    df = spark.createDataFrame([(bytearray(p),) for p in payloads], "p binary")
    assert df.select(payload_signature(df.p)).distinct().count() == 2
    assert df.select(payload_signature(df.p, 2048)).distinct().count() == 1


def test_evidence_is_in_plain_decimals(spark):
    from pointweave.operators.rules import shown

    got = spark.createDataFrame([(94806342.04,), (0.00005,), (None,), (float("nan"),)], "v double").select(shown("v", 1).alias("a"), shown("v", 4).alias("b")).collect()
    assert [tuple(r) for r in got] == [("94806342.0", "94806342.0400"), ("0.0", "0.0001"), (None, None), (None, None)]


def test_all_judged_metrics_are_kept():
    import inspect
    import re

    from pointweave.operators import rules

    assert set(re.findall(r'm\("(\w+)"\)', inspect.getsource(rules.sensor_issues))) == set(rules.JUDGED)


def test_imu_steps_go_on_over_segments(spark):
    from pointweave.operators import sensors

    v = "named_struct('x', cast(id % 7 as double), 'y', 0D, 'z', 0D)"
    rows = spark.range(999_990, 1_000_010).selectExpr("'b' AS bag_id", "'/t' AS topic", "id AS seq", f"{v} AS linear_acceleration", f"{v} AS angular_velocity", "named_struct('x', 0D, 'y', 0D, 'z', 0D, 'w', 1D) AS orientation")
    out = sensors.imu(rows)
    assert "__bucket" in out._jdf.queryExecution().analyzed().toString()
    got = {r.seq: r.metrics["acceleration_step"] for r in out.collect()}
    assert got == {i: None if i == 999_990 else float(abs(i % 7 - (i - 1) % 7)) for i in range(999_990, 1_000_010)}
