"""Streams with timers give what the batch operators give, though files hold rows out of order, and report what time alone makes due."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketops.functions.timing import us
from marketops.operators import joins, quality
from marketops.streaming import streams, timed

T0, END = datetime(2024, 1, 1), datetime(2024, 1, 20)


def stream_of(spark, folder, rows, schema, ts, files=4):
    """Rows in files, each row up to nine minutes early or late among the others, and last a file with nothing but the time."""
    rng = random.Random(2)
    at = [f.split()[0] for f in schema.split(", ")].index(ts)
    arrived = sorted(rows, key=lambda r: r[at] + timedelta(minutes=rng.uniform(0, 9)))
    step = len(arrived) // files + 1
    for i in range(files):
        spark.createDataFrame(arrived[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(folder)
    names = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(END if n == ts else None for n in names)], schema).write.mode("append").parquet(folder)
    return streams.stream_events(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def drained(spark, df, folder):
    streams.run_to_table(df, folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/data")


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)


@pytest.fixture(scope="module")
def ticks():
    """Five feeds, one of them with most rows, one that dies early, and gaps of hours."""
    rng, rows = random.Random(4), []
    for k, n in (("hot", 300), ("b", 60), ("c", 40), ("dead", 20), ("one", 1)):
        at = T0
        for i in range(n):
            at += timedelta(seconds=rng.choice([0, 5, 60, 60, 600, 7200]))
            rows.append((k, at, len(rows), rng.choice(["live", "live", "delayed", "stale", "invalid", "odd", None]), rng.random() < 0.3))
    return rows


SCHEMA = "instrument string, ts timestamp, seq long, quality string, is_snapshot boolean"


def test_sticky_quality(spark, ticks, tmp_path):
    got = drained(spark, timed.sticky_quality(stream_of(spark, f"{tmp_path}/in", ticks, SCHEMA, "ts"), "10 minutes"), f"{tmp_path}/out")
    want = quality.sticky_quality(spark.createDataFrame(ticks, SCHEMA))
    same(got.select("instrument", "ts", "seq", "effective_quality"), want)


def test_silence_is_told_without_a_further_event(spark, ticks, tmp_path):
    got = drained(spark, timed.silences(stream_of(spark, f"{tmp_path}/in", ticks, SCHEMA, "ts"), "1 hour", "10 minutes", ["instrument"], "ts"), f"{tmp_path}/out")
    df = spark.createDataFrame(ticks, SCHEMA)
    ended = quality.feed_silence(df, "1 hour", feed=["instrument"], ts="ts")
    every = quality.feed_silence(df, "1 hour", feed=["instrument"], ts="ts", as_of="2024-01-19 23:50:00")
    want = ended.unionByName(every.withColumn("to_ts", F.lit(None).cast("timestamp")))
    same(got, want)
    assert {r.instrument for r in got.where("to_ts IS NULL").collect()} == {"hot", "b", "c", "dead", "one"}


def test_undecided_signals(spark, tmp_path):
    rng = random.Random(5)
    signals = [(f"s{i}", T0 + timedelta(minutes=rng.uniform(0, 3000))) for i in range(80)]
    decisions = [(s, at + timedelta(seconds=rng.choice([-30, 0, 10, 60, 61, 4000]))) for s, at in signals if rng.random() < 0.7 for _ in range(rng.choice([1, 1, 2]))] + [("unknown", T0)]
    schema = "signal_id string, ts timestamp"
    s, d = stream_of(spark, f"{tmp_path}/s", signals, schema, "ts"), stream_of(spark, f"{tmp_path}/d", decisions, schema, "ts")
    got = drained(spark, timed.undecided(s, d, "60 seconds", "4 days"), f"{tmp_path}/out").select("signal_id", "cause").collect()
    limit, want = timedelta(seconds=60), []
    for name, at in signals:
        mine = [x - at for n, x in decisions if n == name and x >= at]
        if not any(x <= limit for x in mine):
            want += [(name, "missing")] + ([(name, "late")] if mine else [])
    assert sorted(map(tuple, got)) == sorted(want)


def test_asof_holds_one_row_per_key(spark, ticks, tmp_path):
    rng = random.Random(6)
    asks = [(rng.choice(["hot", "b", "dead", "never"]), T0 + timedelta(minutes=rng.uniform(-100, 4000)), f"q{i}") for i in range(120)]
    left, right = "instrument string, ts timestamp, ask string", "instrument string, ts timestamp, seq long, quality string"
    rows = [r[:4] for r in ticks]
    out = timed.asof(stream_of(spark, f"{tmp_path}/l", asks, left, "ts"), stream_of(spark, f"{tmp_path}/r", rows, right, "ts"), ["instrument"], "4 days")
    got = drained(spark, out, f"{tmp_path}/out")
    want = joins.asof_join(spark.createDataFrame(asks, left), spark.createDataFrame(rows, right), ["instrument"])
    same(got, want.select("instrument", "ts", "ask", *[F.col(f"asof.{c}").alias(f"asof_{c}") for c in ("ts", "seq", "quality")]))


def test_times_stay_whole_microseconds(spark, tmp_path):
    rows = [("a", T0 + timedelta(microseconds=3 * i + 1), i, "live", True) for i in range(20)]
    got = drained(spark, timed.sticky_quality(stream_of(spark, f"{tmp_path}/in", rows, SCHEMA, "ts", 2), "10 minutes"), f"{tmp_path}/out")
    assert sorted(r[0] for r in got.select(us("ts")).collect()) == sorted(int((r[1] - datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5) for r in rows)
