"""Declared schemas. Prices and quantities are DECIMAL(18,8); notional, cash and PnL DECIMAL(38,16)."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)
MONEY = T.DecimalType(38, 16)
_META = T.MapType(T.StringType(), T.StringType())
_ZONE = T.StructType([T.StructField("low", PRICE), T.StructField("high", PRICE)])


def _schema(text: str, **special: T.DataType) -> T.StructType:
    """``"name:s ts:t"`` with s string, t timestamp, p price, m money, b boolean, l long, i int."""
    kinds = {
        "s": T.StringType(), "t": T.TimestampType(), "p": PRICE, "m": MONEY,
        "b": T.BooleanType(), "l": T.LongType(), "i": T.IntegerType(), "x": None,
    }
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, special.get(name) or kinds[kind]))
    return T.StructType(fields)


MARKET_SNAPSHOT = _schema(
    "instrument:s ts:t bid:p ask:p last:p volume:p volatility:p liquidity:m source:s quality:s metadata:x",
    metadata=_META,
)
SIGNAL = _schema(
    "signal_id:s instrument:s direction:s ts:t strategy_id:s entry_zone:x invalidation_level:p "
    "expected_move:p horizon_us:l confidence:p metadata:x",
    entry_zone=_ZONE, metadata=_META,
)
RISK_DECISION = _schema(
    "decision_id:s signal_id:s instrument:s ts:t approved:b reason:s quantity:p notional:m leverage:p "
    "max_leverage:p risk_budget:p stop_price:p metadata:x",
    metadata=_META,
)
EXECUTION_REQUEST = _schema(
    "request_id:s risk_decision_id:s instrument:s ts:t side:s quantity:p order_type:s limit_price:p "
    "reduce_only:b client_order_id:s time_in_force:s metadata:x",
    metadata=_META,
)
RAW_EVENT = _schema(
    "venue:s channel:s instrument:s seq:l event_type:s event_ts:t receipt_ts:t persisted_ts:t payload:s "
    "schema_version:i dataset_version:i"
)
FILL = _schema(
    "venue:s fill_id:s client_order_id:s account:s strategy_id:s instrument:s side:s qty:p price:p fee:p "
    "maker:b ts:t"
)
ORDER_EVENT = _schema(
    "client_order_id:s instrument:s account:s strategy_id:s state:s qty:p reduce_only:b event_seq:l event_ts:t"
)

# The members of the five contract enumerations, the leverage ceiling, and the limits
# each runtime mode is configured with.
DATA_QUALITY = ("live", "delayed", "stale", "invalid")
DIRECTION = ("long", "short")
ORDER_SIDE = ("buy", "sell")
ORDER_TYPE = ("market", "limit")
TIME_IN_FORCE = ("gtc", "ioc", "fok")
LEVERAGE_CEILING = 20
MODE_LIMITS = {
    "paper": {"max_leverage": 3, "minimum_markets": 20, "maximum_markets": 100},
    "shadow": {"max_leverage": 3, "minimum_markets": 20, "maximum_markets": 100},
    "live": {"max_leverage": 2, "minimum_markets": 20, "maximum_markets": 100},
}
