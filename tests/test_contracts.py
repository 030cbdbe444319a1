"""The reference cases of the message contracts as rows, their boundaries, and unknown values."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marketops import schemas as S
from marketops.operators import contracts

NOW = datetime(2026, 1, 1)


def snapshot(spark, **over):
    row = {"instrument": "BTC-PERP", "ts": NOW, "bid": D("100"), "ask": D("100"), "last": D("100.5"), "volume": D("12"), "volatility": D("0.02"),
           "liquidity": D("1000000"), "source": "venue-a", "quality": "live", "metadata": None, **over}
    return spark.createDataFrame([row], S.MARKET_SNAPSHOT)


def signal(spark, **over):
    row = {"signal_id": "s1", "instrument": "BTC-PERP", "direction": "long", "ts": NOW, "strategy_id": "momentum-v1", "entry_zone": (D("99"), D("100")),
           "invalidation_level": D("97"), "expected_move": D("0.03"), "horizon_us": 900_000_000, "confidence": D("1"), "metadata": {}, **over}
    return spark.createDataFrame([row], S.SIGNAL)


def decision(spark, **over):
    row = {"decision_id": "r1", "signal_id": "s1", "instrument": "BTC-PERP", "ts": NOW, "approved": True, "reason": "within budget", "quantity": D("0.02"),
           "notional": D("2000"), "leverage": D("20"), "max_leverage": D("20"), "risk_budget": D("10"), "stop_price": D("98000"), "metadata": {}, **over}
    return spark.createDataFrame([row], S.RISK_DECISION)


def request(spark, **over):
    row = {"request_id": "q1", "risk_decision_id": "r1", "instrument": "BTC-PERP", "ts": NOW, "side": "buy", "quantity": D("0.02"), "order_type": "market",
           "limit_price": None, "reduce_only": False, "client_order_id": "c1", "time_in_force": "gtc", "metadata": {}, **over}
    return spark.createDataFrame([row], S.EXECUTION_REQUEST)


CASES = [
    (contracts.validate_snapshots, snapshot, {"bid": D("101")}, ["crossed_book"]),
    (contracts.validate_signals, signal, {"confidence": D("1.01")}, ["confidence_range"]),
    (contracts.validate_risk_decisions, decision, {"leverage": D("6"), "max_leverage": D("5")}, ["leverage_above_max"]),
    (contracts.validate_risk_decisions, decision, {"max_leverage": D("21")}, ["max_leverage_above_ceiling"]),
    (contracts.validate_risk_decisions, decision, {"leverage": D("22"), "max_leverage": D("21")}, ["max_leverage_above_ceiling", "leverage_above_max"]),
    (contracts.validate_execution_requests, request, {"order_type": "limit"}, ["limit_price_required"]),
]
FULL = [
    (contracts.validate_snapshots, snapshot, {"bid": None}, ["not_finite_or_unparseable"]),
    (contracts.validate_snapshots, snapshot, {"last": D("-1")}, ["negative_value"]),
    (contracts.validate_snapshots, snapshot, {"volatility": D("-1")}, ["negative_optional"]),
    (contracts.validate_snapshots, snapshot, {"instrument": " "}, ["empty_id"]),
    (contracts.validate_snapshots, snapshot, {"source": None}, ["empty_id"]),
    (contracts.validate_snapshots, snapshot, {"ts": None}, ["missing_timestamp"]),
    (contracts.validate_snapshots, snapshot, {"quality": "LIVE"}, ["quality_domain"]),
    (contracts.validate_signals, signal, {"entry_zone": (D("101"), D("100"))}, ["zone_reversed"]),
    (contracts.validate_signals, signal, {"horizon_us": 0}, ["horizon_not_positive"]),
    (contracts.validate_signals, signal, {"confidence": None}, ["confidence_range"]),
    (contracts.validate_signals, signal, {"direction": "up"}, ["direction_domain"]),
    (contracts.validate_risk_decisions, decision, {"approved": False}, ["rejection_carries_exposure"]),
    (contracts.validate_risk_decisions, decision, {"leverage": None}, ["leverage_above_max"]),
    (contracts.validate_execution_requests, request, {"quantity": D("0")}, ["quantity_not_positive"]),
    (contracts.validate_execution_requests, request, {"client_order_id": ""}, ["empty_id"]),
    (contracts.validate_execution_requests, request, {"time_in_force": "day"}, ["time_in_force_domain"]),
]


@pytest.mark.parametrize("rules", ["core", "full"])
@pytest.mark.parametrize("validate,make,over,reasons", CASES)
def test_reference_cases(spark, validate, make, over, reasons, rules):
    valid, bad = validate(make(spark, **over), rules)
    row = bad.collect()
    assert valid.count() == 0 and len(row) == 1
    assert row[0].reasons == reasons and row[0].first_reason == reasons[0]


@pytest.mark.parametrize("validate,make,over,reasons", FULL)
def test_contract_rules(spark, validate, make, over, reasons):
    _, bad = validate(make(spark, **over))
    assert [r.reasons for r in bad.collect()] == [reasons]


@pytest.mark.parametrize("validate,make,over", [
    (contracts.validate_snapshots, snapshot, {}),
    (contracts.validate_snapshots, snapshot, {"volatility": None, "liquidity": None}),
    (contracts.validate_signals, signal, {"confidence": D("0")}),
    (contracts.validate_signals, signal, {"confidence": D("1")}),
    (contracts.validate_risk_decisions, decision, {}),
    (contracts.validate_risk_decisions, decision, {"approved": False, "quantity": D("0"), "notional": D("0")}),
    (contracts.validate_execution_requests, request, {}),
    (contracts.validate_execution_requests, request, {"order_type": "limit", "limit_price": D("5")}),
])
def test_boundaries_pass(spark, validate, make, over):
    valid, bad = validate(make(spark, **over))
    assert (valid.count(), bad.count()) == (1, 0)


def test_core_accepts_what_only_the_contract_forbids(spark):
    valid, _ = contracts.validate_signals(signal(spark, horizon_us=0, entry_zone=(D("101"), D("100"))), rules="core")
    assert valid.count() == 1


def test_schema_version(spark):
    df = snapshot(spark).withColumn("schema_version", F.lit(2))
    _, bad = contracts.validate_snapshots(df, schema_version=1)
    assert bad.collect()[0].reasons == ["schema_version"]


def test_parse_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), ("1.123456789",), ("99999999999",), (None,)], "p string")
    out = [(r.p, r.scale_loss) for r in contracts.parse_numbers(df, ["p"]).collect()]
    assert out == [(D("1.50000000"), False), (None, False), (None, False), (None, False), (D("1.12345679"), True), (None, False), (None, False)]


def test_gate_rejects_every_unknown(spark):
    ready = {"quality": "live", "age_us": 1, "max_age_us": 2, "account_known": True, "risk_available": True, "reconciled": True, "spread_bps": 1.0, "max_spread_bps": 2.0,
             "slippage_bps": 1.0, "max_slippage_bps": 2.0, "daily_pnl": 0.0, "max_daily_loss": 1.0, "drawdown": 0.0, "max_drawdown": 0.1, "kill_switch": False, "state": "READY",
             "exposure_after": 10.0, "max_exposure": 10.0, "leverage": 2.0, "limit": 3.0, "stop_price": 1.0}
    kinds = {str: "string", bool: "boolean", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in ready.items())
    rows = [ready] + [{**ready, k: None} for k in ready]
    out = contracts.new_exposure_gate(spark.createDataFrame(rows, schema)).collect()
    assert out[0].allow and out[0].reasons == []
    assert all(not r.allow and len(r.reasons) == 1 for r in out[1:])
    missing = contracts.new_exposure_gate(spark.range(1)).collect()[0]
    assert not missing.allow and len(missing.reasons) == 14
    bad = {"exposure_limit": {"exposure_after": 10.5}, "leverage_limit": {"leverage": 20.5, "limit": 30.0}, "stop_missing": {"stop_price": 0.0}}
    for reason, change in bad.items():
        assert contracts.new_exposure_gate(spark.createDataFrame([{**ready, **change}], schema)).collect()[0].reasons == [reason]


def test_strictest_limit_never_exceeds_the_ceiling(spark):
    df = spark.createDataFrame([("a", 25.0), ("b", 3.0), ("none", 21.0)], "account string, leverage double")
    limits = spark.createDataFrame([("account", "a", 50.0), ("account", "b", 2.0)], "scope string, key string, value double")
    out = {r.account: (float(r.limit), r.above) for r in contracts.strictest_leverage_limit(df, limits, {"account": "account"}).collect()}
    assert out == {"a": (20.0, True), "b": (2.0, True), "none": (20.0, True)}


def test_sizing_without_a_stop_distance_is_zero(spark):
    from marketops.operators.risk import SIZING_INPUTS, size_positions

    base = {"entry": D(100), "stop": D(95), "risk_budget": D(10), "max_notional": D(5000), "liquidity": D(9000), "liquidity_fraction": D("0.5"), "equity": D(1000), "limit": D(3)}
    rows = [base, {**base, "stop": D(100)}, {**base, "limit": D(0)}, {**base, "stop": D("99.99")}] + [{**base, name: None} for name in SIZING_INPUTS]
    schema = ", ".join(f"{name} decimal(18,8)" for name in base)
    out = [(float(r.quantity), float(r.notional), float(r.leverage)) for r in size_positions(spark.createDataFrame(rows, schema)).collect()]
    assert out[0] == (2.0, 200.0, 0.2)
    assert out[3] == (30.0, 3000.0, 3.0)
    assert [o for i, o in enumerate(out) if i not in (0, 3)] == [(0.0, 0.0, 0.0)] * (len(out) - 2)
