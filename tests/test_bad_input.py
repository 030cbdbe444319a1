"""Rows that contracts expect to see sooner or later: unknown keys and times, redeliveries, repeated limits, dead feeds."""

import uuid
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from marketops.operators.contracts import strictest_leverage_limit
from marketops.operators.joins import asof_join, covered_by
from marketops.operators.orders import transition_audit
from marketops.operators.quality import feed_silence
from marketops.operators.research import parameter_sweep, walk_forward_folds
from marketops.operators.risk import return_correlation
from marketops.operators.universe import select_universe
from marketops.schemas import RAW_EVENT
from marketops.session import shared_dir
from marketops.sources import datasets
from marketops.streaming import streams

T0 = datetime(2026, 1, 1)


def test_audit_counts_a_key_once_whatever_its_day(spark):
    log = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    first = spark.createDataFrame([("f1", datetime(2026, 1, 1, 23, 59)), (None, T0), ("f2", T0)], "fill_id string, ts timestamp")
    again = spark.createDataFrame([("f1", datetime(2026, 1, 2, 0, 1)), (None, T0), ("f3", None), ("f3", T0)], "fill_id string, ts timestamp")
    for batch in (first, again, first, again.limit(0)):
        datasets.append_audit(batch, log, ["fill_id"])
    rows = {r.fill_id: r["count"] for r in spark.read.parquet(log).groupBy("fill_id").count().collect()}
    assert rows == {"f1": 1, None: 1, "f2": 1, "f3": 1}
    assert spark.read.parquet(log).where("fill_id = 'f1'").first().ts == datetime(2026, 1, 1, 23, 59)


def test_scan_leaves_the_declared_schema_alone(spark):
    before, folder = list(RAW_EVENT.names), f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    spark.createDataFrame([], RAW_EVENT).write.parquet(f"{folder}/version=1")
    datasets.scan_dataset(spark, folder)
    assert list(RAW_EVENT.names) == before and len(RAW_EVENT.fields) == len(before)


def test_unknown_keys_and_times_match_nothing(spark):
    left = spark.createDataFrame([("a", T0), (None, T0), ("a", None)], "k string, ts timestamp")
    right = spark.createDataFrame([("a", None, 1), (None, T0, 2), ("b", T0, 3)], "k string, ts timestamp, seq int")
    for direction in ("backward", "forward"):
        assert [r.asof for r in asof_join(left, right, ["k"], direction=direction).collect()] == [None] * 3
    spans = spark.createDataFrame([(None, T0 - timedelta(days=1), None), ("a", None, None)], "k string, b timestamp, e timestamp")
    assert not any(r.covered for r in covered_by(left, spans, ["k"], "b", "e").collect())


def test_repeated_limits_keep_the_rows_and_the_smallest(spark):
    df = spark.createDataFrame([(1, "x", Decimal(4))], "id int, account string, leverage decimal(18,8)")
    limits = spark.createDataFrame([("account", "x", 5), ("account", "x", 3)], "scope string, key string, value int")
    row, = strictest_leverage_limit(df, limits, {"account": "account"}).collect()
    assert row.limit == 3 and row.above


def test_dead_feed_is_reported(spark):
    df = spark.createDataFrame([("v", T0, 1), ("w", T0 + timedelta(hours=9), 1)], "venue string, event_ts timestamp, seq int")
    assert feed_silence(df, "1 hour", ["venue"]).count() == 0
    row, = feed_silence(df, "1 hour", ["venue"], as_of="2026-01-01 09:30:00").collect()
    assert (row.venue, row.from_ts, row.to_ts) == ("v", T0, T0 + timedelta(hours=9, minutes=30))


def test_redelivered_transition_is_no_violation(spark):
    states = [("o", 1, "created"), ("o", 1, "created"), ("o", 2, "submitted"), ("o", 2, "submitted")]
    df = spark.createDataFrame(states, "client_order_id string, event_seq int, state string")
    assert transition_audit(df, {"created": ["submitted"], "submitted": []}).count() == 0


def test_quiet_instruments_correlate_too(spark):
    rows = [(i, T0 + timedelta(days=d), x * 1e-12) for i, sign in (("a", 1), ("b", -1)) for d, x in enumerate([sign * v for v in (1.0, -2.0, 3.0, 0.5, -1.0)])]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp, ret double")
    assert abs(return_correlation(df).first().corr + 1) < 1e-6


def test_rows_of_one_version_have_a_fixed_winner(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "y")], "venue string, seq int, version int, v string")
    picks = {datasets.read_version(df.orderBy(F.rand(s)), 1, ["venue", "seq"]).first().v for s in range(4)}
    assert len(picks) == 1


def test_alerts_once_per_episode(spark):
    def at(minute):
        return T0 + timedelta(minutes=minute)

    batches = [
        [("a", at(0), 1), ("a", at(1), 20), ("a", at(2), 20), ("a", at(3), 1), ("a", at(4), 20), ("b", at(0), 20), ("c", at(0), 1)],
        [("a", at(5), 20), ("b", at(1), 20), ("a", at(6), 1), ("c", at(1), None), ("b", None, 20)],
        [("a", at(7), 1), ("a", at(5), 20), ("a", at(8), 20), ("b", at(2000), 20), ("b", at(2001), 20), ("c", at(9), 20)],
    ]
    folder, schema = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}", "k string, ts timestamp, value int"
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streams.stream_events(spark, f"{folder}/in", df.schema, files_per_batch=1)
    streams.run_to_table(streams.alert_stream(stream, F.col("value") > 10, ["k"], "ts", "1 day"), f"{folder}/out")
    got = [(r.k, r.ts) for r in spark.read.parquet(f"{folder}/out/data").collect()]
    # The late row of a at minute 5 comes when a is calm again; b falls silent for more than a day.
    assert sorted(got, key=str) == sorted([("a", at(1)), ("a", at(4)), ("a", at(5)), ("a", at(8)), ("b", at(0)), ("b", None), ("b", at(2000)), ("c", at(9))], key=str)


def test_sets_without_trades_stay_in_the_sweep(spark):
    plan = walk_forward_folds("2026-01-01 00:00:00", "2 days", "1 day", 0, 2)
    rows = spark.createDataFrame([(T0, 0.5, 1.0), (T0 + timedelta(days=2), 0.1, 2.0)], "ts timestamp, confidence double, net double")
    out = parameter_sweep(rows, [{"least": 0.0}, {"least": 0.4}, {"least": 9.0}], plan, lambda p: F.col("confidence") >= p["least"], seed=1).collect()
    assert len(out) == 3 * 2 * 2
    traded = {(r.param_id, r.fold, r.role): (r.n, r.total) for r in out if r.n}
    assert traded == {(0, 0, "train"): (1, 1.0), (0, 0, "test"): (1, 2.0), (0, 1, "train"): (1, 2.0), (1, 0, "train"): (1, 1.0)}
    assert all(r.total is None and r.least == [0.0, 0.4, 9.0][r.param_id] for r in out if not r.n)


def test_dates_without_members_are_undersized(spark):
    rows = spark.createDataFrame([(T0.date(), "x", 1.0), (T0.date() + timedelta(days=3), "y", 2.0), (None, "z", 1.0)], "date date, instrument string, liquidity double")
    got = {(r.date and r.date.day, r.instrument, r["rank"], r.undersized) for r in select_universe(rows, 1, 5).collect()}
    assert got == {(2, "x", 1, False), (3, None, None, True), (4, None, None, True), (5, "y", 1, False), (None, "z", 1, False)}
    assert select_universe(rows.limit(0), 1, 5).collect() == []


def test_rounded_digits_are_told(spark):
    texts = ['{"bid":"1.123456789","ask":"2","last":"1","volume":"3"}', '{"bid":"1.12345678","ask":"2.000000000","last":"1","volume":"3"}', '{"bid":"1","ask":"2","last":"9999999999.0000000000000000001","volume":"3"}']
    good, bad = datasets.normalize_raw(spark.createDataFrame(list(enumerate(texts)), "seq int, payload string"))
    assert {r.seq: r.scale_loss for r in good.collect()} == {0: True, 1: False, 2: True}
    assert bad.columns == ["seq", "payload", "malformed"]
