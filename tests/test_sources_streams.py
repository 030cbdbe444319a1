"""Datasets, manifests, the audit log, and streams that must equal their batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketops.operators import features, monitoring, quality
from marketops.sources import datasets
from marketops.streaming import streams

T0 = datetime(2024, 1, 1)
EVENTS = "venue string, channel string, instrument string, seq long, event_type string, event_ts timestamp, receipt_ts timestamp, persisted_ts timestamp, payload string, schema_version int, dataset_version int"


def make_events(spark, n=300, seed=1):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        at = T0 + timedelta(minutes=7 * seq)
        late = timedelta(seconds=rng.randrange(0, 120))
        rows.append(("v", rng.choice(["book", "trade"]), rng.choice(["A", "A", "B"]), seq, "tick", at, at + late, at + late, "{}", 1, 1))
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_versions_are_immutable_and_pruned(spark, folder):
    events = make_events(spark)
    datasets.write_dataset(events, folder, 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        datasets.write_dataset(events, folder, 1)
    fix = events.where("seq = 7").withColumn("payload", F.lit("fixed"))
    datasets.write_dataset(fix, folder, 2)
    whole = datasets.scan_dataset(spark, folder)
    assert whole.count() == 301
    assert datasets.read_version(whole, 1).where("payload = 'fixed'").count() == 0
    now = datasets.read_version(whole, 2)
    assert now.count() == 300 and now.where("seq = 7").collect()[0].payload == "fixed"
    one = datasets.scan_dataset(spark, folder, venue="v", instruments=["B"], date_from="2024-01-01", date_to="2024-01-01")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert one.select("instrument").distinct().collect()[0][0] == "B"


def test_manifest_ignores_order_and_sees_changes(spark):
    events = make_events(spark).withColumn("meta", F.create_map(F.lit("a"), F.col("channel"), F.lit("b"), F.lit(None)))
    a = datasets.dataset_manifest(events, {"x": 1, "y": 2}).collect()[0]
    b = datasets.dataset_manifest(events.orderBy(F.desc("seq")).repartition(7), {"y": 2, "x": 1}).collect()[0]
    c = datasets.dataset_manifest(events.withColumn("payload", F.when(F.col("seq") == 3, None).otherwise(F.col("payload"))), {"x": 1}).collect()[0]
    assert a == b and a.digest != c.digest and a.config_hash != c.config_hash


def test_audit_log_ignores_retries(spark, folder):
    rows = make_events(spark).select("seq", F.col("event_ts").alias("ts"))
    for batch in (rows.where("seq < 100"), rows.where("seq < 200"), rows, rows):
        datasets.append_audit(batch, f"{folder}/log", ["seq"])
    timeless = rows.where("seq = 1").select((F.col("seq") + 1000).alias("seq"), F.lit(None).cast("timestamp").alias("ts"))
    for _ in range(2):
        datasets.append_audit(timeless, f"{folder}/log", ["seq"])
    log = spark.read.parquet(f"{folder}/log")
    assert log.where("seq = 1001").count() == 1
    log = log.where("seq < 1000")
    assert log.count() == 300 and log.select("seq").distinct().count() == 300


def test_normalize_routes_malformed(spark):
    raw = spark.createDataFrame(
        [(1, '{"bid":"1.5","ask":"2","last":"1.7","volume":"3"}'), (2, "nope"), (3, '{"bid":"NaN","ask":"2","last":"1","volume":"3"}'), (4, None), (5, '{"bid":"1"}')],
        "seq long, payload string",
    )
    good, bad = datasets.normalize_raw(raw)
    assert [r.seq for r in good.collect()] == [1]
    assert {r.seq: r.malformed for r in bad.collect()} == {2: "malformed_json", 3: "bad_number", 4: "malformed_json", 5: "bad_number"}


def as_stream(spark, df, folder, parts, order):
    """The rows as a stream of ``parts`` micro-batches, oldest first."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return streams.stream_events(spark, f"{folder}/in", df.schema, files_per_batch=1)


def drain(spark, df, folder):
    streams.run_to_table(df, f"{folder}/out")
    return spark.read.schema(df.schema).parquet(f"{folder}/out/data")


def rows(df):
    return sorted(map(str, df.collect()))


def sentinel(spark, events):
    """A far-future event that pushes the watermark past everything before it."""
    last = T0 + timedelta(days=900)
    return events.unionByName(spark.createDataFrame([("v", "end", "Z", 10**6, "tick", last, last, last, "{}", 1, 1)], EVENTS))


def test_dedup_stream_equals_batch(spark, folder):
    events = make_events(spark)
    again = events.unionByName(events.where("seq % 3 = 0"))
    got = drain(spark, streams.dedup_stream(as_stream(spark, again, folder, 4, "event_ts"), "1 hour"), folder)
    assert rows(got) == rows(quality.dedup_events(again))


def test_feed_health_stream_equals_batch(spark, folder):
    events = sentinel(spark, make_events(spark))
    stream = as_stream(spark, events, folder, 5, "event_ts").withWatermark("event_ts", "1 hour")
    got = drain(spark, monitoring.feed_health(stream, "6 hours", "60 seconds"), folder)
    whole = monitoring.feed_health(events, "6 hours", "60 seconds").where("channel <> 'end'")
    assert rows(got) == rows(monitoring.feed_health(events, "6 hours", "60 seconds", edges=False).where("channel <> 'end'"))
    # A batch also sees the holes between windows; no number is missing twice.
    spans = events.where("channel <> 'end'").groupBy("venue", "channel").agg((F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("n"))
    assert whole.agg(F.sum("missing")).first()[0] == spans.agg(F.sum("n")).first()[0]


def test_bars_stream_equals_batch(spark, folder):
    events = sentinel(spark, make_events(spark)).select("instrument", F.col("event_ts").alias("ts"), "seq", (F.col("seq") % 17).cast("decimal(18,8)").alias("last"), F.lit(2).cast("decimal(18,8)").alias("volume"))
    stream = as_stream(spark, events, folder, 3, "ts").withWatermark("ts", "1 hour")
    got = drain(spark, features.bars(stream, "6 hours"), folder)
    assert rows(got) == rows(features.bars(events, "6 hours").where("instrument <> 'Z'"))


def test_sticky_quality_stream_equals_batch(spark, folder):
    rng = random.Random(6)
    data = [(rng.choice("AB"), T0 + timedelta(minutes=i), i, rng.choice(["live", "live", "live", "delayed", "stale", "invalid", "odd", None]), rng.choice([True, False, False, None])) for i in range(200)]
    df = spark.createDataFrame(data, "instrument string, ts timestamp, seq long, quality string, is_snapshot boolean")
    got = drain(spark, streams.sticky_quality_stream(as_stream(spark, df, folder, 4, "ts")), folder)
    want = quality.sticky_quality(df)
    assert rows(got.select("instrument", "seq", "effective_quality")) == rows(want.select("instrument", "seq", "effective_quality"))


def test_sessions_leave_the_silences(spark, folder):
    events = sentinel(spark, make_events(spark).where("seq % 50 > 5"))
    got = drain(spark, streams.session_activity(as_stream(spark, events, folder, 3, "event_ts"), "30 minutes", "1 hour", ["venue"], "event_ts"), folder)
    silences = quality.feed_silence(events.where("channel <> 'end'"), "29 minutes", feed=["venue"])
    assert got.count() == silences.count() + 1


def test_missing_decisions_stream(spark, folder):
    sig = spark.createDataFrame([(f"s{i}", T0 + timedelta(minutes=i)) for i in range(50)] + [("end", T0 + timedelta(days=900))], "signal_id string, ts timestamp")
    dec = spark.createDataFrame([(f"s{i}", f"d{i}", T0 + timedelta(minutes=i, seconds=i * 3)) for i in range(0, 50, 2)] + [("end", "dend", T0 + timedelta(days=900))], "signal_id string, decision_id string, ts timestamp")
    s = as_stream(spark, sig, f"{folder}/s", 3, "ts")
    d = as_stream(spark, dec, f"{folder}/d", 2, "ts")
    got = drain(spark, streams.missing_decisions_stream(s, d, "60 seconds", "10 minutes"), folder)
    assert {r.signal_id for r in got.collect()} == {f"s{i}" for i in range(50) if i % 2 or i * 3 > 60}


def test_alert_stream_is_quiet_after_the_first(spark, folder):
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=i), float(i)) for i in range(60)], "feed string, ts timestamp, value double")
    got = drain(spark, streams.alert_stream(as_stream(spark, df, folder, 3, "ts"), F.col("value") > 10, ["feed"], "ts", "1 day"), folder)
    assert got.count() == 1


def test_latency_counts_late_rows_before_any_watermark(spark):
    out = quality.ingest_latency(make_events(spark), "60 seconds").agg(F.sum("n").alias("n"), F.sum("late").alias("late")).collect()[0]
    lag = make_events(spark).where(F.unix_micros("receipt_ts") - F.unix_micros("event_ts") > 60_000_000).count()
    assert (out.n, out.late) == (300, lag)
