"""Path-dependent and search operators against plain Python folds and scans."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketops.operators import joins, orders, portfolio, risk

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def fills(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        account = rng.choice(["a"] * 5 + ["b"])
        rows.append(("v", f"f{i:04d}", account, rng.choice(["X"] * 4 + ["Y"]), rng.choice(["buy", "sell"]), D(rng.randrange(1, 9)), D(rng.randrange(90, 110)), D("0.1"),
                     T0 + timedelta(hours=rng.randrange(0, 300))))
    return spark.createDataFrame(rows, "venue string, fill_id string, account string, instrument string, side string, qty decimal(18,8), price decimal(18,8), fee decimal(18,8), ts timestamp").cache()


def lot_queue(rows):
    lots, realized = [], D(0)
    for r in sorted(rows, key=lambda r: (r.ts, r.fill_id)):
        sign, qty = (1 if r.side == "buy" else -1), r.qty
        while qty and lots and lots[0][0] == -sign:
            take = min(qty, lots[0][1])
            realized += take * (r.price - lots[0][2]) * (1 if sign < 0 else -1)
            lots[0][1] -= take
            qty -= take
            if not lots[0][1]:
                lots.pop(0)
        if qty:
            lots.append([sign, qty, r.price])
    return realized


@pytest.mark.parametrize("width,span", [("1 day", 3), ("10 days", 10_000), (None, 7)])
def test_fifo_equals_lot_queue(fills, width, span):
    got = {(r.account, r.instrument): r.realized for r in portfolio.pnl_fifo_realized(fills, width=width, span=span).collect()}
    groups = {}
    for r in fills.collect():
        groups.setdefault((r.account, r.instrument), []).append(r)
    assert got == {k: lot_queue(rows).quantize(D("1e-16")) for k, rows in groups.items()}


def test_results_do_not_depend_on_input_order_or_repeats(fills):
    from marketops.operators.quality import dedup_fills

    again = fills.orderBy(F.rand(1)).unionByName(fills.where("qty > 4")).repartition(5)
    once = dedup_fills(again)
    for op in (portfolio.positions, portfolio.pnl_fifo_realized, portfolio.position_path):
        assert sorted(map(tuple, op(fills).select(*sorted(op(fills).columns)).collect())) == sorted(map(tuple, op(once).select(*sorted(op(fills).columns)).collect()))


def test_mark_to_market_equals_realized_plus_open(spark, fills):
    marks = spark.createDataFrame([("X", D(100)), ("Y", D(100))], "instrument string, price decimal(18,8)")
    flat = fills.unionByName(
        portfolio.positions(fills).where("qty <> 0").select(
            F.lit("v").alias("venue"), F.concat(F.lit("z"), "account", "instrument").alias("fill_id"), "account", "instrument",
            F.when(F.col("qty") > 0, "sell").otherwise("buy").alias("side"), F.abs("qty").cast("decimal(18,8)").alias("qty"), F.lit(100).cast("decimal(18,8)").alias("price"),
            F.lit(0).cast("decimal(18,8)").alias("fee"), F.lit(T0 + timedelta(days=90)).alias("ts"),
        )
    )
    mtm = {(r.account, r.instrument): r.pnl + r.fees for r in portfolio.pnl_mark_to_market(fills, marks).collect()}
    fifo = {(r.account, r.instrument): r.realized for r in portfolio.pnl_fifo_realized(flat).collect()}
    assert mtm == fifo


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_equals_fold(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(300):
        size = rng.choice([1, 3, 10, 49, 50, 51, 100, 400])
        rows.append((rng.choice(["hot"] * 6 + ["x", "y", "unknown"]), f"r{i}", T0 + timedelta(hours=rng.randrange(0, 200)), i, D(rng.choice([0, size, size, -1]))))
    requests = spark.createDataFrame(rows, "account string, request_id string, ts timestamp, seq long, amount decimal(38,16)")
    budgets = {"hot": D(1000), "x": D(100), "y": D(0)}
    table = spark.createDataFrame(list(budgets.items()), "account string, budget decimal(38,16)")
    left, want = dict(budgets), {}
    for account, rid, *_, amount in sorted(rows, key=lambda r: (r[2], r[3])):
        rest = left.get(account, D(0))
        want[rid] = 0 <= amount <= rest
        left[account] = rest - (amount if want[rid] else 0)
    out = risk.admit_by_budget(requests, table)
    assert {r.request_id: r.admitted for r in out.collect()} == want
    rest = risk.remaining_budget(out, table).groupBy("account").agg(F.min("remaining").alias("r")).collect()
    assert {r.account: r.r for r in rest if r.account in budgets} == {a: left[a] for a in budgets}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 45), st.integers(-25, 25)), max_size=10))
def test_pyramid_search(values, asks):
    arr = np.array(values, dtype="int64")
    begin, goal = np.array([a for a, _ in asks], dtype="int64"), np.array([g for _, g in asks], dtype="int64")
    want = [next((i for i in range(b, len(values)) if values[i] <= g), -1) for b, g in asks]
    assert joins.search_at_or_below(arr, begin, goal).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=10))
def test_range_max(values, spans):
    n = len(values)
    pairs = [(min(a, n), max(min(a, n), min(b, n))) for a, b in spans]
    got = joins.range_max(np.array(values, dtype=float), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [max(values[a:b], default=-np.inf) for a, b in pairs]


@pytest.fixture(scope="module")
def market(spark):
    rng, rows, px = random.Random(11), [], 100.0
    for seq in range(1500):
        px = max(20.0, px * (1 + rng.uniform(-0.02, 0.02)))
        rows.append((rng.choice(["H"] * 7 + ["L"]), T0 + timedelta(seconds=rng.randrange(0, 400_000)), seq, D(f"{px:.2f}")))
    return spark.createDataFrame(rows, "instrument string, ts timestamp, seq long, last decimal(18,8)").cache()


@pytest.mark.parametrize("width,fanout", [("10 minutes", 6), ("1 hour", 3), ("2 days", 2)])
def test_first_invalidation_against_scan(spark, market, width, fanout):
    rng, rows = random.Random(2), []
    for i in range(120):
        rows.append((f"s{i}", rng.choice(["H", "L", "none"]), rng.choice(["long", "short"]), T0 + timedelta(seconds=rng.randrange(0, 400_000)), D(rng.randrange(40, 160)), rng.choice([0, 3600, 90_000, 400_000]) * 1_000_000))
    signals = spark.createDataFrame(rows, "signal_id string, instrument string, direction string, ts timestamp, invalidation_level decimal(18,8), horizon_us long")
    ticks = sorted(market.collect(), key=lambda r: (r.ts, r.seq))
    got = {r.signal_id: r.invalidated_at for r in joins.first_invalidation(signals, market, width=width, fanout=fanout).collect()}
    for sid, instrument, direction, ts, level, horizon in rows:
        end = ts + timedelta(microseconds=horizon)
        want = next((t.ts for t in ticks if t.instrument == instrument and ts < t.ts <= end and (t.last <= level if direction == "long" else t.last >= level)), None)
        assert got[sid] == want, sid
    assert len(got) == len(rows)


@pytest.mark.parametrize("width,fanout", [("10 minutes", 6), ("1 hour", 3), ("2 days", 2)])
@pytest.mark.parametrize("k", [0.05, 0.2])
def test_trailing_stop_against_scan(spark, market, width, fanout, k):
    rng, rows = random.Random(4), []
    for i in range(80):
        ts = T0 + timedelta(seconds=rng.randrange(0, 400_000))
        closed = rng.choice([None, ts + timedelta(seconds=rng.randrange(0, 300_000))])
        rows.append((f"e{i}", rng.choice(["H", "L", "none"]), rng.choice(["long", "short"]), ts, D(rng.randrange(60, 140)), closed))
    entries = spark.createDataFrame(rows, "entry_id string, instrument string, direction string, ts timestamp, price decimal(18,8), closed_at timestamp")
    until = T0 + timedelta(seconds=350_000)
    ticks = sorted(market.collect(), key=lambda r: (r.ts, r.seq))
    got = {r.entry_id: r for r in orders.trailing_stop_path(entries, market, k, str(until), width=width, fanout=fanout).collect()}
    for eid, instrument, direction, ts, price, closed in rows:
        extreme, hit = float(price), None
        for t in ticks:
            if t.instrument != instrument or not ts < t.ts <= min(closed or until, until):
                continue
            p = float(t.last)
            extreme = max(extreme, p) if direction == "long" else min(extreme, p)
            if p <= (1 - k) * extreme if direction == "long" else p >= (1 + k) * extreme:
                hit = t.ts
                break
        assert (got[eid].hit_at, got[eid].extreme) == (hit, extreme), eid
    assert len(got) == len(rows)


def test_correlation_equals_pandas(spark):
    rng, rows = random.Random(8), []
    for day in range(40):
        for name in "abcdefg":
            if rng.random() < 0.8:
                rows.append((name, T0 + timedelta(days=day), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "instrument string, ts timestamp, ret double")
    want = df.toPandas().pivot(index="ts", columns="instrument", values="ret").corr(min_periods=5)
    for blocks in (1, 3):
        got = risk.return_correlation(df, min_bars=5, blocks=blocks, stretch="9 days").collect()
        assert len(got) == 21
        assert all(abs(r["corr"] - want.loc[r.a, r.b]) < 1e-9 for r in got)


@pytest.mark.parametrize("width", ["30 days", None])
def test_admission_accumulates_only_what_a_phase_can_reach(spark, monkeypatch, width):
    rng, seen, plain = random.Random(5), [], risk.running

    def counted(df, *args, **kwargs):
        seen.append(df.count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(risk, "running", counted)
    rows = [("hot", f"r{i}", T0 + timedelta(days=i), i, D(rng.randrange(1, 100))) for i in range(2000)]
    requests = spark.createDataFrame(rows, "account string, request_id string, ts timestamp, seq long, amount decimal(38,16)")
    table = spark.createDataFrame([("hot", D(1000))], "account string, budget decimal(38,16)")
    left, want = D(1000), {}
    for _, rid, *_, amount in rows:
        want[rid] = amount <= left
        left -= amount if want[rid] else 0
    assert {r.request_id: r.admitted for r in risk.admit_by_budget(requests, table, width=width).collect()} == want
    assert sum(seen) < 2 * len(rows)


def test_trailing_stop_sorts_ticks_for_its_nodes_once(spark, monkeypatch):
    reads, plain = [], orders.materialize

    def counted(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [instrument"))
        return plain(df)

    monkeypatch.setattr(orders, "materialize", counted)
    ticks = [("i", T0 + timedelta(minutes=m), m, float(100 + m)) for m in range(30)] + [("i", T0 + timedelta(minutes=30), 30, 60.0)]
    market = spark.createDataFrame(ticks, "instrument string, ts timestamp, seq long, last double")
    entries = spark.createDataFrame([("e", "i", "long", T0, 100.0, T0 + timedelta(hours=2))], "entry_id string, instrument string, direction string, ts timestamp, price double, closed_at timestamp")
    (got,) = orders.trailing_stop_path(entries, market, 0.3, str(T0 + timedelta(days=1)), width="5 minutes", fanout=3).collect()
    assert (got.extreme, got.hit_at) == (129.0, T0 + timedelta(minutes=30))
    assert max(reads) == 1
