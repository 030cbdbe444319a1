"""Quantiles, digest trees, searches in shares, censored outcomes, unknown inputs, against plain Python."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import numpy as np
from pyspark.sql import functions as F

from marketops.functions.quantiles import exact_quantiles
from marketops.operators import joins, portfolio, research, risk, signals

T0 = datetime(2024, 1, 1)


def test_quantiles_are_those_of_all_values(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1.5, rng.uniform(-5, 5), float(rng.randrange(10))])) for k in ["hot"] * 500 + ["b"] * 7 + [None] * 20 + ["one"] for _ in range(1)] + [("empty", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: [r[n] for n in shares] for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = [x for k, x in rows if k == key and x is not None]
        if values:
            want[key] = [float(np.quantile(values, q)) for q in shares.values()]
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_only_ranges_that_differ_are_compared(spark):
    a = spark.range(20_000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 11 > 0, F.lit("x")).alias("s"))
    b = a.where("id <> 77").unionByName(a.where("id = 123")).withColumn("v", F.when(F.col("id") == 500, F.lit(None)).otherwise(F.col("v")))
    x, y, ranges = portfolio.differing_ranges(a, b)
    assert ranges <= 4 and x.count() + y.count() < 20
    found = sorted((r.side, r.id, r.v) for r in portfolio.difference(a, b).collect())
    assert found == [("only_a", 77, 0), ("only_a", 500, 3), ("only_b", 123, 4), ("only_b", 500, None)]
    x, y, ranges = portfolio.differing_ranges(a, a.repartition(3))
    assert ranges == 0 and not x.collect() and not y.collect()
    assert portfolio.difference(a.limit(0), a).count() == 20_000


def test_a_bucket_is_searched_in_shares(spark):
    rng = random.Random(2)
    width = 600_000_000
    ticks = spark.createDataFrame([("X", 0, i * 1000, i, rng.randrange(1000)) for i in range(300)], "instrument string, bucket long, at long, seq long, price long")
    asks = spark.createDataFrame([(f"s{i}", "X", rng.randrange(300_000), width, i % 2 == 0, rng.randrange(1000), 0) for i in range(200)], "signal_id string, instrument string, at long, until long, is_long boolean, level long, bucket long")
    whole, dealt = (sorted(map(tuple, joins.bucket_search(asks, ticks, joins.first_crossing(width), "signal_id string, hit_us long", most).collect())) for most in (1000, 10))
    assert whole == dealt and len(whole) == 200


def test_crossings_far_behind_the_signal(spark):
    rows = [("X", T0 + timedelta(hours=h), h, D(100)) for h in range(0, 5000, 7)] + [("X", T0 + timedelta(hours=4999), 9999, D(50))]
    ticks = spark.createDataFrame(rows, "instrument string, ts timestamp, seq long, last decimal(18,8)")
    asks = spark.createDataFrame([(f"s{h}", "X", "long", T0 + timedelta(hours=h), D(60), 5_000 * 3_600_000_000) for h in (0, 1, 700, 4998, 4999)], "signal_id string, instrument string, direction string, ts timestamp, invalidation_level decimal(18,8), horizon_us long")
    for levels, fanout in ((3, 36), (2, 3), (4, 2), (1, 36)):
        got = {r.signal_id: r.invalidated_at for r in joins.first_invalidation(asks, ticks, fanout=fanout, levels=levels).collect()}
        assert got == {f"s{h}": T0 + timedelta(hours=4999) if h < 4999 else None for h in (0, 1, 700, 4998, 4999)}


def test_signals_lost_from_sight_are_censored(spark):
    ticks = spark.createDataFrame([("X", T0, 1, D(100)), ("X", T0 + timedelta(hours=5), 2, D(110)), ("Y", T0, 3, D(10))], "instrument string, ts timestamp, seq long, last decimal(18,8)")
    hour = 3_600_000_000
    asks = spark.createDataFrame([("a", "X", 5 * hour), ("b", "X", 30 * hour), ("c", "Y", hour), ("d", "Y", 9 * hour), ("e", "Z", hour)], "signal_id string, instrument string, horizon_us long")
    asks = asks.select("*", F.lit("long").alias("direction"), F.lit(T0).alias("ts"), F.lit(D("0.05")).alias("expected_move"))
    out = signals.signal_outcomes(asks, ticks, "2 hours")
    got = {r.signal_id: (r.hit, r.censored, r.followed_us) for r in out.collect()}
    assert got == {"a": (True, False, 5 * hour), "b": (None, True, 5 * hour), "c": (False, False, hour), "d": (None, True, 0), "e": (None, False, None)}
    curve = {r.followed_us: (r.at_risk, r.hits, round(r.waiting, 9)) for r in signals.hit_curve(out, ["direction"]).collect()}
    # At 5 hours two were at risk and one hit; the other was lost there.
    assert curve == {0: (4, 0, 1.0), hour: (3, 0, 1.0), 5 * hour: (2, 1, 0.5)}
    rest = research.evaluate_signals(asks, ticks.select("*", F.col("last").alias("bid"), F.col("last").alias("ask"), F.lit(None).cast("decimal(18,8)").alias("volume")).withColumn("quantity", F.lit(1)), 1, 1, "2 hours")
    assert {r.signal_id: (r.net is None, r.censored) for r in rest.collect()} == {"a": (False, False), "b": (True, True), "c": (False, False), "d": (True, True), "e": (True, False)}


def test_unknown_inputs_make_sums_unknown(spark):
    kinds = "account string, instrument string, ts timestamp, fill_id string, side string, qty decimal(18,8), price decimal(18,8), fee decimal(18,8)"
    fills = spark.createDataFrame([("a", "X", T0 + timedelta(hours=i), f"f{i}", side, D(2), D(10), D(0)) for i, side in enumerate(["buy", "sell", "hold", "buy"])] + [("b", "X", T0, "g", "buy", D(1), D(10), None)], kinds)
    assert {(r.account, r.qty) for r in portfolio.positions(fills).collect()} == {("a", None), ("b", D(1))}
    assert [r.position for r in portfolio.position_path(fills.where("account = 'a'")).orderBy("ts").collect()] == [D(2), D(0), None, None]
    marks = spark.createDataFrame([("X", D(11))], "instrument string, price decimal(18,8)")
    assert {r.account: r.pnl for r in portfolio.pnl_mark_to_market(fills, marks).collect()} == {"a": None, "b": None}
    huge = spark.createDataFrame([("c", "X", T0, f"h{i}", "buy", D("9999999999"), D(1), D(0)) for i in range(30)], kinds)
    assert [r.pnl for r in portfolio.pnl_mark_to_market(huge, marks).collect()] == [None]
    held = spark.createDataFrame([("a", "X", D(5)), ("a", "Y", None), ("b", "X", D(-3))], "account string, instrument string, notional decimal(38,16)")
    gross = {r.account: (r.gross, r.unknown) for r in risk.exposure(held, ["account"]).where("grouping = 0").collect()}
    assert gross == {"a": (None, 1), "b": (D(3), 0)}
    events = spark.createDataFrame([("a", T0 + timedelta(hours=i), i, kind, D(10)) for i, kind in enumerate(["reserve", "release", "what", "release"])], "account string, ts timestamp, seq long, kind string, amount decimal(38,16)")
    budgets = spark.createDataFrame([("a", D(100))], "account string, budget decimal(38,16)")
    assert [(r.balance, r.over) for r in risk.budget_ledger(events, ["account"], budgets).orderBy("seq").collect()] == [(D(10), False), (D(0), False), (None, True), (None, True)]


def test_equity_of_flat_and_unmarked_positions(spark):
    day = timedelta(days=1)
    fills = spark.createDataFrame([("a", "X", T0, "1", "buy", D(2), D(10), D(1)), ("a", "X", T0 + 2 * day, "2", "sell", D(2), D(12), D(1)), ("b", "Y", T0 + day, "3", "buy", D(1), D(5), D(0))],
                                  "account string, instrument string, ts timestamp, fill_id string, side string, qty decimal(18,8), price decimal(18,8), fee decimal(18,8)")
    marks = spark.createDataFrame([("X", T0, 1, D(10)), ("X", T0 + day, 2, D(15)), ("Y", T0 + 3 * day, 3, D(7))], "instrument string, ts timestamp, seq long, price decimal(18,8)")
    got = {(r.account, r.day.day): r.equity for r in portfolio.equity_curve(fills, marks, 100, "2024-01-05").collect()}
    assert got == {("a", 1): D(99), ("a", 2): D(109), ("a", 3): D(102), ("a", 4): D(102), ("a", 5): D(102), ("b", 2): None, ("b", 3): None, ("b", 4): D(102), ("b", 5): D(102)}


def test_neighbours_are_steps_in_the_grid(spark):
    rows = [(i, float(c), float(m), fold, role, float(i * i + (role == "train"))) for i, (c, m) in enumerate((c, m) for c in (1, 2, 3) for m in (10, 20)) for fold in (0, 1) for role in ("train", "test")]
    sweep = spark.createDataFrame(rows, "param_id int, c double, m double, fold int, role string, sharpe double")
    got = {r.param_id: r.instability for r in research.robust_selection(sweep, ["c", "m"]).collect()}
    oos = {i: float(i * i) for i in range(6)}
    near = {0: [1, 2], 1: [0, 3], 2: [0, 3, 4], 3: [1, 2, 5], 4: [2, 5], 5: [3, 4]}
    assert got == {i: abs(oos[i] - sum(oos[j] for j in n) / len(n)) for i, n in near.items()}
