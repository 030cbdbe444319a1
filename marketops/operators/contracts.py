"""Message validation, domains, leverage limits and the new-exposure gate.

``rules="core"`` applies only the checks the message types themselves make; ``"full"`` (the default)
adds what the written contracts ask for. Unknown values are breaches.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketops import schemas as S
from marketops.functions.reasons import failed, not_ok, split_valid
from marketops.operators.joins import asof_join

Split = tuple[DataFrame, DataFrame]


def _empty(*names: str) -> Column:
    bad = F.lit(False)
    for name in names:
        bad = bad | F.coalesce(F.trim(F.col(name)) == "", F.lit(True))
    return bad


def _unparsed(*names: str) -> Column:
    bad = F.lit(False)
    for name in names:
        bad = bad | F.col(name).isNull()
    return bad


def _negative(*names: str) -> Column:
    """Below zero; an unknown value is reported by the not-finite rule instead."""
    bad = F.lit(False)
    for name in names:
        bad = bad | F.coalesce(F.col(name) < 0, F.lit(False))
    return bad


def _outside(name: str, domain: Sequence[str]) -> Column:
    return ~F.coalesce(F.col(name).isin(*domain), F.lit(False))


def _known(breach: Column) -> Column:
    """A comparison whose operands may be NULL where the NULL has its own rule."""
    return F.coalesce(breach, F.lit(False))


def snapshot_checks(rules: str = "full", schema_version: int | None = None, columns: Iterable[str] = ()) -> dict[str, Column]:
    crossed = F.col("bid") > F.col("ask")
    if rules == "core":
        return {"crossed_book": crossed}
    checks = {
        "crossed_book": _known(crossed),
        "empty_id": _empty("instrument", "source"),
        "not_finite_or_unparseable": _unparsed("bid", "ask", "last", "volume"),
        "negative_value": _negative("bid", "ask", "last", "volume"),
        "negative_optional": _negative("volatility", "liquidity"),
        "missing_timestamp": _unparsed("ts"),
        "quality_domain": _outside("quality", S.DATA_QUALITY),
    }
    present = set(columns)
    if "seq" in present:
        checks["bad_sequence"] = F.col("seq") < 0
    if schema_version is not None and "schema_version" in present:
        checks["schema_version"] = F.col("schema_version") != schema_version
    return checks


def validate_snapshots(df: DataFrame, rules: str = "full", schema_version: int | None = None) -> Split:
    return split_valid(df, snapshot_checks(rules, schema_version, df.columns))


def validate_signals(df: DataFrame, rules: str = "full") -> Split:
    checks = {"confidence_range": ~F.col("confidence").between(0, 1)}
    if rules == "full":
        checks |= {
            "empty_id": _empty("signal_id", "instrument", "strategy_id"),
            "direction_domain": _outside("direction", S.DIRECTION),
            "zone_reversed": F.col("entry_zone.low") > F.col("entry_zone.high"),
            "horizon_not_positive": F.col("horizon_us") <= 0,
            "missing_timestamp": _unparsed("ts"),
        }
    return split_valid(df, checks)


def validate_risk_decisions(df: DataFrame, rules: str = "full") -> Split:
    checks = {
        "max_leverage_above_ceiling": F.col("max_leverage") > S.LEVERAGE_CEILING,
        "leverage_above_max": F.col("leverage") > F.col("max_leverage"),
    }
    if rules == "full":
        rejected = ~F.coalesce(F.col("approved"), F.lit(False))
        carries = ~F.coalesce((F.col("quantity") == 0) & (F.col("notional") == 0), F.lit(False))
        checks |= {
            "rejection_carries_exposure": rejected & carries,
            "empty_id": _empty("decision_id", "signal_id", "instrument"),
            "missing_timestamp": _unparsed("ts"),
        }
    return split_valid(df, checks)


def validate_execution_requests(df: DataFrame, rules: str = "full") -> Split:
    checks = {"limit_price_required": _known(F.col("order_type") == "limit") & F.col("limit_price").isNull()}
    if rules == "full":
        checks |= {
            "quantity_not_positive": F.col("quantity") <= 0,
            "empty_id": _empty("request_id", "risk_decision_id", "client_order_id", "instrument"),
            "side_domain": _outside("side", S.ORDER_SIDE),
            "order_type_domain": _outside("order_type", S.ORDER_TYPE),
            "time_in_force_domain": _outside("time_in_force", S.TIME_IN_FORCE),
            "missing_timestamp": _unparsed("ts"),
        }
    return split_valid(df, checks)


def parse_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns to prices: ``<name>`` is NULL where unparseable, out of range, NaN or infinite;
    ``scale_loss`` tells that digits beyond the eighth would be rounded away."""
    wide = {name: F.col(name).try_cast("decimal(38,18)") for name in names}
    loss = F.lit(False)
    for value in wide.values():
        loss = loss | _known(value != value.try_cast(S.PRICE))
    return df.withColumns({**{n: F.col(n).try_cast(S.PRICE) for n in names}, "scale_loss": loss})


def check_domains(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Names of the columns whose value is not an exact, case-sensitive member."""
    return df.withColumn("bad_domains", failed({name: _outside(name, dom) for name, dom in domains.items()}))


def strictest_leverage_limit(df: DataFrame, limits: DataFrame, scopes: Mapping[str, str], leverage: str = "leverage") -> DataFrame:
    """Smallest of the limits set for the row's scopes and the system ceiling.

    ``limits(scope, key, value)`` may repeat a key: the smallest value counts; ``scopes`` maps a scope to the column
    of ``df`` holding its key. A scope without a limit is skipped: the ceiling always applies.
    """
    out, found = df, []
    for i, (scope, column) in enumerate(scopes.items()):
        side = limits.where(F.col("scope") == scope).groupBy(F.col("key").alias(f"__k{i}")).agg(F.min(F.col("value").cast(S.PRICE)).alias(f"__v{i}"))
        out = out.join(side, F.col(column) == F.col(f"__k{i}"), "left")
        found.append(f"__v{i}")
    limit = F.least(F.lit(S.LEVERAGE_CEILING).cast(S.PRICE), *[F.col(v) for v in found])
    out = out.withColumn("limit", limit)
    above = F.coalesce(F.col(leverage) > F.col("limit"), F.lit(True))
    return out.withColumn("above", above).drop(*found, *[f"__k{i}" for i in range(len(found))])


def signals_in_zone(signals: DataFrame, snapshots: DataFrame, tolerance: str | int | None = None, width: str = "1 day") -> DataFrame:
    """Signals whose as-of last price lies inside the inclusive entry zone."""
    priced = asof_join(signals, snapshots.select("instrument", "ts", "seq", "last"), ["instrument"], tolerance=tolerance, width=width)
    inside = F.col("asof.last").between(F.col("entry_zone.low"), F.col("entry_zone.high"))
    return priced.where(inside).withColumn("price", F.col("asof.last")).drop("asof")


GATE_INPUTS = (
    "quality", "age_us", "max_age_us", "account_known", "risk_available", "reconciled", "spread_bps", "max_spread_bps",
    "slippage_bps", "max_slippage_bps", "daily_pnl", "max_daily_loss", "drawdown", "max_drawdown", "kill_switch", "state",
    "exposure_after", "max_exposure", "leverage", "limit", "stop_price",
)
#: Limits on the size of a trade; the risk gate checks them once the size is known.
SIZE_CHECKS = ("exposure_limit", "leverage_limit", "stop_missing")


def size_checks(exposure_after: Column, max_exposure: Column, leverage: Column, limit: Column, stop_price: Column) -> dict[str, Column]:
    """What must hold of a sized trade: gross exposure after it, its leverage, and a protective stop that can be represented."""
    return {"exposure_limit": exposure_after <= max_exposure, "leverage_limit": (leverage <= limit) & (leverage <= 20), "stop_missing": stop_price > 0}


def new_exposure_gate(df: DataFrame, sized: bool = True) -> DataFrame:
    """Fail-closed gate for exposure-raising rows; a missing column or a NULL input is a rejection.

    Limits are positive magnitudes: ``daily_pnl >= -max_daily_loss`` and ``drawdown >= -max_drawdown`` pass. Without ``sized`` the
    checks of ``SIZE_CHECKS`` are left to a later step.
    """
    present = set(df.columns)

    def c(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None)

    ok = {
        "data_quality": c("quality").isin("live", "delayed"),
        "data_stale": c("age_us") <= c("max_age_us"),
        "account_unknown": c("account_known").cast("boolean"),
        "risk_unavailable": c("risk_available").cast("boolean"),
        "not_reconciled": c("reconciled").cast("boolean"),
        "spread": c("spread_bps") <= c("max_spread_bps"),
        "slippage": c("slippage_bps") <= c("max_slippage_bps"),
        "daily_loss": c("daily_pnl") >= -c("max_daily_loss"),
        "drawdown": c("drawdown") >= -c("max_drawdown"),
        "kill_switch": ~c("kill_switch").cast("boolean"),
        "state_not_ready": c("state") == "READY",
    }
    if sized:
        ok |= size_checks(c("exposure_after"), c("max_exposure"), c("leverage"), c("limit"), c("stop_price"))
    return df.withColumn("reasons", not_ok(ok)).withColumn("allow", F.size("reasons") == 0)


def quarantine_report(quarantine: DataFrame, ts: str = "ts") -> DataFrame:
    """Rejected rows per rule, instrument and UTC day."""
    return (
        quarantine.select(F.explode("reasons").alias("rule"), "instrument", F.to_date(ts).alias("day"))
        .groupBy("rule", "instrument", "day")
        .agg(F.count("*").alias("n"))
    )
