"""Queries over validation, quality and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketops import schemas as S
from marketops.functions.reasons import split_valid
from marketops.functions.timing import us
from marketops.operators import contracts, joins, quality
from marketops.operators.features import mid_spread
from marketops.plans.registry import Inputs, as_placed, breaches, d, n, plain, query, unmet
from marketops.sources import datasets

SNAPSHOT_BREACHES = {
    "crossed_book": "coalesce(bid > ask, FALSE)",
    "empty_id": "trim(instrument) = '' OR trim(source) = ''",
    "not_finite_or_unparseable": "bid IS NULL OR ask IS NULL OR last IS NULL OR volume IS NULL",
    "negative_value": "coalesce(bid < 0, FALSE) OR coalesce(ask < 0, FALSE) OR coalesce(last < 0, FALSE) OR coalesce(volume < 0, FALSE)",
    "negative_optional": "coalesce(volatility < 0, FALSE) OR coalesce(liquidity < 0, FALSE)",
    "missing_timestamp": "ts IS NULL",
    "quality_domain": "quality NOT IN ('live', 'delayed', 'stale', 'invalid')",
    "bad_sequence": "seq < 0",
}
_VALID = f"(SELECT * FROM fx_snapshot WHERE {breaches(SNAPSHOT_BREACHES)} = '')"
_SPREAD = "CAST(ask - bid AS DOUBLE) / nullif(CAST((ask + bid) / 2 AS DOUBLE), 0) * 10000"


def signals(v: Inputs):
    return v("fx_signal").withColumn("entry_zone", F.struct(F.col("zone_low").alias("low"), F.col("zone_high").alias("high")))


def _graded(split, *cols):
    valid, bad = split
    return plain(valid.select(*cols, F.lit("").alias("reasons")).unionByName(bad.select(*cols, F.array_join("reasons", ",").alias("reasons"))))


@query("gated_signals", ["fx_signal", "fx_snapshot", "fx_policy"], f"""
, quoted AS (
  SELECT g.signal_id, g.instrument, g.k, g.value, g.ts, s.seq AS snapshot_seq, s.last, s.quality, s.source,
         {_SPREAD} AS spread_bps, epoch_us(g.ts) - epoch_us(s.ts) AS age_us
  FROM fx_signal g ASOF LEFT JOIN {_VALID} s ON g.instrument = s.instrument AND g.ts >= s.ts),
aged AS (
  SELECT q.*, coalesce(i.value, f.value) AS max_age_us FROM quoted q
  LEFT JOIN fx_policy i ON i.scope = 'instrument' AND i.name = 'max_age_us' AND i.key = q.instrument
  LEFT JOIN fx_policy f ON f.scope = 'feed' AND f.name = 'max_age_us' AND f.key = q.source)
SELECT signal_id, instrument, snapshot_seq, {d('last', 'last')}, age_us, reasons, reasons = '' AS allow
FROM (SELECT *, {unmet({
    "data_quality": "quality IN ('live', 'delayed')", "data_stale": "age_us <= max_age_us", "account_unknown": "k < 97",
    "risk_unavailable": "k <> 50", "not_reconciled": "k <> 51", "spread": "spread_bps <= 120", "slippage": "k / 10.0 <= 8",
    "daily_loss": "-value >= -200", "drawdown": "CASE WHEN k <> 52 THEN -k / 100.0 END >= -0.9", "kill_switch": "k <> 53",
    "state_not_ready": "k <> 54", "exposure_limit": "k * 100 + 500 <= 9000", "leverage_limit": "1 + k % 23 <= 20", "stop_missing": "k % 10 <> 7"})} AS reasons FROM aged) z""")
def gated_signals(v: Inputs):
    """For each signal the latest valid snapshot, its age, and whether new exposure is allowed."""
    valid, _ = contracts.validate_snapshots(v("fx_snapshot"))
    quotes = mid_spread(valid).select("instrument", "ts", "seq", "last", "quality", "source", "spread_bps")
    found = joins.asof_join(v("fx_signal").select("signal_id", "instrument", "k", "value", "ts"), quotes, ["instrument"], width="1 day")
    flat = found.select(
        "signal_id", "instrument", "k", "value", F.col("asof.seq").alias("snapshot_seq"), F.col("asof.last").alias("last"),
        F.col("asof.quality").alias("quality"), F.col("asof.source").alias("source"), F.col("asof.spread_bps").alias("spread_bps"),
        (us("ts") - us("asof.ts")).alias("age_us"),
    )
    limited = joins.policy_join(flat, v("fx_policy"), {"instrument": "instrument", "feed": "source"}, ["max_age_us"])
    k = F.col("k")
    facts = limited.withColumns({
        "account_known": k < 97, "risk_available": k != 50, "reconciled": k != 51, "max_spread_bps": F.lit(120.0), "slippage_bps": k / 10,
        "max_slippage_bps": F.lit(8), "daily_pnl": -F.col("value"), "max_daily_loss": F.lit(200), "drawdown": F.when(k != 52, -k / 100),
        "max_drawdown": F.lit(0.9), "kill_switch": k == 53, "state": F.when(k == 54, "HALTED").otherwise("READY"),
        "exposure_after": k * 100 + 500, "max_exposure": F.lit(9000), "leverage": 1 + k % 23, "limit": F.lit(50), "stop_price": F.when(k % 10 != 7, 95),
    })
    gated = contracts.new_exposure_gate(facts)
    return plain(gated.select("signal_id", "instrument", "snapshot_seq", "last", "age_us", "reasons", "allow"))


@query("validate_snapshots", ["fx_snapshot"], f"SELECT instrument, seq, {breaches(SNAPSHOT_BREACHES)} AS reasons FROM fx_snapshot")
def _(v):
    return _graded(contracts.validate_snapshots(v("fx_snapshot")), "instrument", "seq")


@query("validate_snapshots_core", ["fx_snapshot"], f"SELECT instrument, seq, {breaches({'crossed_book': 'bid > ask'})} AS reasons FROM fx_snapshot")
def _(v):
    return _graded(contracts.validate_snapshots(v("fx_snapshot"), rules="core"), "instrument", "seq")


@query("validate_signals", ["fx_signal"], f"""SELECT signal_id, {breaches({
    "confidence_range": "NOT (confidence BETWEEN 0 AND 1)", "empty_id": "trim(signal_id) = '' OR trim(instrument) = '' OR trim(strategy_id) = ''",
    "direction_domain": "direction NOT IN ('long', 'short')", "zone_reversed": "zone_low > zone_high", "horizon_not_positive": "horizon_us <= 0",
    "missing_timestamp": "ts IS NULL"})} AS reasons FROM fx_signal""")
def _(v):
    return _graded(contracts.validate_signals(signals(v)), "signal_id")


_DECISION = {
    "max_leverage_above_ceiling": "max_leverage > 20", "leverage_above_max": "leverage > max_leverage",
    "rejection_carries_exposure": "NOT approved AND NOT (quantity = 0 AND notional = 0)",
    "empty_id": "trim(decision_id) = '' OR trim(signal_id) = '' OR trim(instrument) = ''", "missing_timestamp": "ts IS NULL",
}


@query("validate_risk_decisions", ["fx_decision"], f"""
SELECT decision_id, reasons, CASE WHEN reasons <> '' THEN split_part(reasons, ',', 1) END AS first_reason
FROM (SELECT decision_id, {breaches(_DECISION)} AS reasons FROM fx_decision) z""")
def _(v):
    valid, bad = contracts.validate_risk_decisions(v("fx_decision"))
    ok = valid.select("decision_id", F.lit("").alias("reasons"), F.lit(None).cast("string").alias("first_reason"))
    return plain(ok.unionByName(bad.select("decision_id", F.array_join("reasons", ",").alias("reasons"), "first_reason")))


@query("validate_execution_requests", ["fx_request"], f"""SELECT request_id, {breaches({
    "limit_price_required": "coalesce(order_type = 'limit', FALSE) AND limit_price IS NULL", "quantity_not_positive": "quantity <= 0",
    "empty_id": "trim(request_id) = '' OR trim(risk_decision_id) = '' OR trim(client_order_id) = '' OR trim(instrument) = ''",
    "side_domain": "side NOT IN ('buy', 'sell')", "order_type_domain": "order_type NOT IN ('market', 'limit')",
    "time_in_force_domain": "time_in_force NOT IN ('gtc', 'ioc', 'fok')", "missing_timestamp": "ts IS NULL"})} AS reasons FROM fx_request""")
def _(v):
    return _graded(contracts.validate_execution_requests(v("fx_request")), "request_id")


@query("check_domains", ["fx_snapshot", "fx_signal", "fx_request"], """
SELECT 'snapshot' AS kind, CAST(seq AS VARCHAR) AS id, CASE WHEN quality NOT IN ('live', 'delayed', 'stale', 'invalid') THEN 'quality' ELSE '' END AS bad_domains FROM fx_snapshot
UNION ALL SELECT 'signal', signal_id, CASE WHEN direction NOT IN ('long', 'short') THEN 'direction' ELSE '' END FROM fx_signal
UNION ALL SELECT 'request', request_id, concat_ws(',', CASE WHEN side NOT IN ('buy', 'sell') THEN 'side' END,
  CASE WHEN order_type NOT IN ('market', 'limit') THEN 'order_type' END, CASE WHEN time_in_force NOT IN ('gtc', 'ioc', 'fok') THEN 'time_in_force' END) FROM fx_request""")
def _(v):
    a = contracts.check_domains(v("fx_snapshot"), {"quality": S.DATA_QUALITY}).select(F.lit("snapshot").alias("kind"), F.col("seq").cast("string").alias("id"), "bad_domains")
    b = contracts.check_domains(v("fx_signal"), {"direction": S.DIRECTION}).select(F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), "bad_domains")
    domains = {"side": S.ORDER_SIDE, "order_type": S.ORDER_TYPE, "time_in_force": S.TIME_IN_FORCE}
    c = contracts.check_domains(v("fx_request"), domains).select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), "bad_domains")
    return plain(a.unionByName(b).unionByName(c))


@query("strictest_leverage_limit", ["fx_risk", "fx_policy"], f"""
SELECT decision_id, {d('lim', '"limit"')}, coalesce(leverage > lim, TRUE) AS above FROM (
  SELECT r.decision_id, r.leverage, least(20, a.value, i.value, s.value) AS lim FROM fx_risk r
  LEFT JOIN fx_policy a ON a.scope = 'account' AND a.name = 'max_leverage' AND a.key = r.account
  LEFT JOIN fx_policy i ON i.scope = 'instrument' AND i.name = 'max_leverage' AND i.key = r.instrument
  LEFT JOIN fx_policy s ON s.scope = 'strategy' AND s.name = 'max_leverage' AND s.key = r.strategy_id) z""")
def _(v):
    limits = v("fx_policy").where("name = 'max_leverage'")
    out = contracts.strictest_leverage_limit(v("fx_risk"), limits, {"account": "account", "instrument": "instrument", "strategy": "strategy_id"})
    return plain(out.select("decision_id", "limit", "above"))


@query("signals_in_zone", ["fx_signal", "fx_snapshot"], f"""
SELECT g.signal_id, {d('s.last', 'price')} FROM fx_signal g ASOF JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts >= s.ts
WHERE s.last BETWEEN g.zone_low AND g.zone_high""")
def _(v):
    return plain(contracts.signals_in_zone(signals(v), v("fx_snapshot")).select("signal_id", "price"))


@query("new_exposure_gate", ["fx_base"], f"""
SELECT event_id, reasons, reasons = '' AS allow FROM (SELECT event_id, {unmet({
    "data_quality": "k < 70", "data_stale": "k * 2 <= value", "account_unknown": "event_type <> 'error'", "risk_unavailable": "k <> 7",
    "not_reconciled": "CASE WHEN k > 5 THEN TRUE END", "spread": "k <= 90", "slippage": "value <= 300", "daily_loss": "-value >= -250",
    "drawdown": "-k / 100.0 >= -0.8", "kill_switch": "k <> 9", "state_not_ready": "event_type <> 'signup'", "exposure_limit": "k * 10 <= value * 4", "leverage_limit": "k % 25 <= 15", "stop_missing": "k % 8 > 1"})} AS reasons FROM fx_base) z""")
def _(v):
    k, value = F.col("k"), F.col("value")
    df = v("fx_base").withColumns({
        "quality": F.when(k < 40, "live").when(k < 70, "delayed").when(k < 90, "stale"), "age_us": k * 2, "max_age_us": value,
        "account_known": F.col("event_type") != "error", "risk_available": k != 7, "reconciled": F.when(k > 5, True), "spread_bps": k,
        "max_spread_bps": F.lit(90), "slippage_bps": value, "max_slippage_bps": F.lit(300), "daily_pnl": -value, "max_daily_loss": F.lit(250),
        "drawdown": -k / 100, "max_drawdown": F.lit(0.8), "kill_switch": k == 9, "state": F.when(F.col("event_type") == "signup", "DEGRADED").otherwise("READY"),
        "exposure_after": k * 10, "max_exposure": value * 4, "leverage": k % 25, "limit": F.lit(15), "stop_price": F.when(k % 8 > 1, k % 8 - 1).when(k % 8 == 1, 0),
    })
    return plain(contracts.new_exposure_gate(df).select("event_id", "reasons", "allow"))


@query("quarantine_report", ["fx_snapshot"], f"""
SELECT rule, instrument, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM (
  SELECT instrument, ts, unnest(string_split({breaches(SNAPSHOT_BREACHES)}, ',')) AS rule FROM fx_snapshot) z
WHERE rule <> '' GROUP BY ALL""")
def _(v):
    _, bad = contracts.validate_snapshots(v("fx_snapshot"))
    return plain(contracts.quarantine_report(bad).withColumn("day", F.col("day").cast("string")))


# Ordering, idempotency, quality

@query("dedup_events", ["fx_delivered"], """
SELECT venue, channel, instrument, seq, receipt_ts, payload FROM (
  SELECT *, row_number() OVER (PARTITION BY venue, channel, instrument, seq ORDER BY receipt_ts, persisted_ts, payload) AS rn FROM fx_delivered) z WHERE rn = 1""")
def _(v):
    return plain(quality.dedup_events(v("fx_delivered")).select("venue", "channel", "instrument", "seq", "receipt_ts", "payload"))


@query("dedup_signals", ["fx_signal"], """
, delivered AS (SELECT signal_id, ts, direction FROM fx_signal UNION ALL SELECT signal_id, ts + INTERVAL '5' SECOND, 'short' FROM fx_signal WHERE k > 40)
SELECT signal_id, min(ts) AS ts, arg_min(direction, ts) AS direction FROM delivered GROUP BY signal_id""")
def _(v):
    s = v("fx_signal").select("signal_id", "ts", "direction", "k")
    again = s.where("k > 40").select("signal_id", (F.col("ts") + F.expr("INTERVAL 5 SECOND")).alias("ts"), F.lit("short").alias("direction"))
    return plain(quality.dedup_signals(s.drop("k").unionByName(again)))


@query("dedup_fills", ["fx_fill_once"], f"SELECT fill_id, account, instrument, side, {d('qty', 'qty')}, {d('price', 'price')} FROM fx_fill_once")
def _(v):
    once = quality.dedup_fills(v("fx_fill"), order=("ts", "recv_seq", "price"))
    return plain(once.select("fill_id", "account", "instrument", "side", "qty", "price"))


@query("dedup_requests", ["fx_request"], """
SELECT request_id, client_order_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY client_order_id ORDER BY ts, request_id) AS rc FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, request_id) AS rr FROM fx_request) a WHERE rr = 1) b WHERE rc = 1""")
def _(v):
    return plain(quality.dedup_requests(v("fx_request")).select("request_id", "client_order_id", "ts"))


@query("conflicting_duplicates", ["fx_fill"], """
SELECT venue, fill_id, count(*) AS variants, CAST(sum(c) AS BIGINT) AS copies FROM (
  SELECT venue, fill_id, account, instrument, side, qty, price, ts, count(*) AS c FROM fx_fill GROUP BY ALL) z
GROUP BY venue, fill_id HAVING count(*) > 1""")
def _(v):
    return plain(quality.conflicting_duplicates(v("fx_fill"), ["venue", "fill_id"], ["account", "instrument", "side", "qty", "price", "ts"]))


@query("sequence_gaps", ["fx_raw"], """
SELECT venue, p + 1 AS gap_from, seq - 1 AS gap_to FROM (
  SELECT venue, seq, lag(seq) OVER (PARTITION BY venue ORDER BY seq) AS p FROM fx_raw WHERE event_type <> 'error') z WHERE seq > p + 1""")
def _(v):
    return plain(quality.sequence_gaps(v("fx_raw").where("event_type <> 'error'"), feed=["venue"], span=1000))


@query("gap_repair_state", ["fx_raw"], """
, marked AS (SELECT *, CASE WHEN seq > lag(seq) OVER (PARTITION BY venue, channel ORDER BY seq) + 3 THEN seq END AS g,
                    CASE WHEN event_type IN ('click', 'signup') AND seq % 4 = 0 THEN seq END AS h,
                    CASE WHEN event_type IN ('click', 'signup') AND seq % 4 = 0 THEN event_ts END AS ht FROM fx_raw WHERE event_type <> 'error'),
seen AS (SELECT *, max(g) OVER w AS lg, max(h) OVER w AS lh,
                first_value(ht IGNORE NULLS) OVER (PARTITION BY venue, channel ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nh
         FROM marked WINDOW w AS (PARTITION BY venue, channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT channel, seq, in_gap, CASE WHEN in_gap THEN nh END AS repaired_at
FROM (SELECT *, lg IS NOT NULL AND NOT coalesce(lh >= lg, FALSE) AS in_gap FROM seen) z""")
def _(v):
    # Sequence numbers are shared by the venue's channels, so only holes of more than two numbers count here.
    feed = ["venue", "channel"]
    df = v("fx_raw").where("event_type <> 'error'")
    heal = F.col("event_type").isin("click", "signup") & (F.col("seq") % 4 == 0)
    out = quality.gap_repair_state(df, heal, feed=feed, span=1000, tolerance=2)
    return plain(out.select("channel", "seq", "in_gap", "repaired_at"))


@query("clock_regressions", ["fx_raw"], """
SELECT venue, channel, seq, epoch_us(high) - epoch_us(event_ts) AS regression_us FROM (
  SELECT *, max(event_ts) OVER (PARTITION BY venue, channel ORDER BY receipt_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM fx_raw) z
WHERE event_ts < high""")
def _(v):
    return plain(quality.clock_regressions(v("fx_raw"), feed=["venue", "channel"]).select("venue", "channel", "seq", "regression_us"))


_RANK = "CASE {0} WHEN 'live' THEN 0 WHEN 'delayed' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END"


@query("classify_staleness", ["fx_snapshot", "fx_policy"], f"""
, aged AS (
  SELECT s.*, coalesce(i.value, f.value) AS max_age, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(s.ts) AS age_us,
         epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(s.receipt_ts) AS receipt_age_us FROM fx_snapshot s
  LEFT JOIN fx_policy i ON i.scope = 'instrument' AND i.name = 'max_age_us' AND i.key = s.instrument
  LEFT JOIN fx_policy f ON f.scope = 'feed' AND f.name = 'max_age_us' AND f.key = s.source)
SELECT instrument, seq, age_us, receipt_age_us,
       CASE greatest({_RANK.format('quality')}, CASE WHEN age_us <= max_age THEN 0 ELSE 2 END, CASE WHEN receipt_age_us <= max_age THEN 0 ELSE 2 END)
            WHEN 0 THEN 'live' WHEN 1 THEN 'delayed' WHEN 2 THEN 'stale' ELSE 'invalid' END AS quality FROM aged""")
def _(v):
    limited = joins.policy_join(v("fx_snapshot"), v("fx_policy"), {"instrument": "instrument", "feed": "source"}, ["max_age_us"])
    out = quality.classify_staleness(limited, "2024-01-20 00:00:00")
    return plain(out.select("instrument", "seq", "age_us", "receipt_age_us", "quality"))


STICKY_SQL = """
SELECT instrument, seq, CASE WHEN m IS NULL OR m = 'ok' THEN quality ELSE m END AS effective_quality FROM (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM (
    SELECT *, CASE WHEN quality NOT IN ('live', 'delayed') THEN CASE WHEN quality = 'stale' THEN 'stale' ELSE 'invalid' END
                   WHEN quality = 'live' AND source = 'feed-view' THEN 'ok' END AS mark FROM fx_snapshot) a) b"""


@query("sticky_quality", ["fx_snapshot"], STICKY_SQL)
def _(v):
    df = v("fx_snapshot").withColumn("is_snapshot", F.col("source") == "feed-view")
    return plain(quality.sticky_quality(df, width="1 day").select("instrument", "seq", "effective_quality"))


@query("feed_silence", ["fx_raw"], """
SELECT instrument, p AS from_ts, event_ts AS to_ts FROM (
  SELECT *, lag(event_ts) OVER (PARTITION BY venue, instrument ORDER BY event_ts, seq) AS p FROM fx_raw) z
WHERE epoch_us(event_ts) - epoch_us(p) > 43200000000""")
def _(v):
    return plain(quality.feed_silence(v("fx_raw"), "12 hours", feed=["venue", "instrument"], width="1 day").drop("venue"))


@query("ingest_latency", ["fx_raw"], f"""
SELECT venue, channel, time_bucket(INTERVAL '1 day', event_ts) AS window_start,
       {d('quantile_cont(lag, 0.5)', 'p50')}, {d('quantile_cont(lag, 0.95)', 'p95')}, {d('quantile_cont(lag, 0.99)', 'p99')},
       {n('max(epoch_us(persisted_ts) - epoch_us(receipt_ts))', 'max_persist')}, count(*) AS n, count(*) FILTER (lag > 60000000) AS late
FROM (SELECT *, epoch_us(receipt_ts) - epoch_us(event_ts) AS lag FROM fx_raw) z GROUP BY ALL""")
def _(v):
    return plain(quality.ingest_latency(v("fx_raw"), "60 seconds"))


@query("interval_volume", ["fx_snapshot"], f"""
SELECT instrument, seq, {d('CASE WHEN p IS NULL OR volume < p THEN volume ELSE volume - p END', 'interval_volume')} FROM (
  SELECT *, lag(volume) OVER (PARTITION BY instrument ORDER BY ts, seq) AS p FROM fx_snapshot) z""")
def _(v):
    return plain(quality.interval_volume(v("fx_snapshot"), "cumulative", width="1 day").select("instrument", "seq", "interval_volume"))


@query("total_order", ["fx_raw"], """
SELECT seq, row_number() OVER (ORDER BY event_ts, receipt_ts, venue, channel, instrument, seq) AS place FROM fx_raw""")
def _(v):
    return plain(as_placed(quality.total_order(v("fx_raw"))).select("seq", "place"))


# Joins

@query("asof_join", ["fx_signal", "fx_snapshot"], f"""
SELECT g.signal_id, s.seq AS snapshot_seq, {d('CASE WHEN epoch_us(g.ts) - epoch_us(s.ts) <= 86400000000 THEN s.last END', 'price')},
       epoch_us(g.ts) - epoch_us(s.ts) <= 86400000000 AS fresh
FROM fx_signal g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts >= s.ts""")
def _(v):
    snaps = v("fx_snapshot").select("instrument", "ts", "seq", "last")
    both = joins.asof_join(v("fx_signal").select("signal_id", "instrument", "ts"), snaps, ["instrument"], width="1 day", name="any")
    near = joins.asof_join(both, snaps, ["instrument"], tolerance="1 day", width="1 day", name="near")
    fresh = F.when(F.col("any").isNotNull(), F.col("near").isNotNull())
    return plain(near.select("signal_id", F.col("any.seq").alias("snapshot_seq"), F.col("near.last").alias("price"), fresh.alias("fresh")))


@query("asof_join_forward", ["fx_signal", "fx_snapshot"], """
SELECT g.signal_id, s.seq AS snapshot_seq FROM fx_signal g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts <= s.ts""")
def _(v):
    snaps = v("fx_snapshot").select("instrument", "ts", "seq", "last")
    out = joins.asof_join(v("fx_signal").select("signal_id", "instrument", "ts"), snaps, ["instrument"], direction="forward", width="1 day")
    return plain(out.select("signal_id", F.col("asof.seq").alias("snapshot_seq")))


@query("signal_lineage", ["fx_signal", "fx_risk", "fx_request", "fx_trade"], f"""
SELECT s.signal_id, d.decision_id, d.approved, r.request_id, r.ts AS request_ts, f.fills, {d('f.filled', 'filled')}, f.first_fill_ts FROM fx_signal s
LEFT JOIN fx_risk d ON d.signal_id = s.signal_id LEFT JOIN fx_request r ON r.risk_decision_id = d.decision_id
LEFT JOIN (SELECT client_order_id, count(*) AS fills, sum(qty) AS filled, min(ts) AS first_fill_ts FROM fx_trade GROUP BY 1) f ON f.client_order_id = r.client_order_id""")
def _(v):
    out = joins.signal_lineage(v("fx_signal"), v("fx_risk"), v("fx_request"), v("fx_trade"))
    return plain(out.select("signal_id", "decision_id", "approved", "request_id", "request_ts", "fills", "filled", "first_fill_ts"))


@query("missing_decisions", ["fx_signal", "fx_risk"], """
SELECT s.signal_id, CASE WHEN d.ts IS NULL THEN 'missing' ELSE 'late' END AS cause FROM fx_signal s
LEFT JOIN (SELECT signal_id, min(ts) AS ts FROM fx_risk GROUP BY 1) d ON d.signal_id = s.signal_id
WHERE d.ts IS NULL OR epoch_us(d.ts) - epoch_us(s.ts) > 75000000""")
def _(v):
    return plain(joins.missing_decisions(v("fx_signal"), v("fx_risk"), "75 seconds").select("signal_id", "cause"))


AUTHORIZED = unmet({
    "decision_missing": "d.ts IS NOT NULL", "decision_stale": "epoch_us(r.ts) - epoch_us(d.ts) BETWEEN 0 AND 600000000", "decision_rejected": "d.approved",
    "instrument_mismatch": "r.instrument = d.instrument",
    "side_mismatch": "(r.side = CASE d.direction WHEN 'long' THEN 'buy' WHEN 'short' THEN 'sell' END) <> coalesce(r.reduce_only, FALSE)",
    "already_consumed": "r.rn = 1", "quantity_above_approved": "r.quantity <= d.quantity"})


@query("authorize_requests", ["fx_request", "fx_risk"], f"""
SELECT request_id, reasons, reasons = '' AS authorized FROM (SELECT r.request_id, {AUTHORIZED} AS reasons
  FROM (SELECT *, row_number() OVER (PARTITION BY risk_decision_id ORDER BY ts, request_id) AS rn FROM fx_request) r
  LEFT JOIN (SELECT * FROM fx_risk WHERE k <> 33) d ON d.decision_id = r.risk_decision_id) z""")
def _(v):
    out = joins.authorize_requests(v("fx_request"), v("fx_risk").where("k <> 33"), "10 minutes")
    return plain(out.select("request_id", "reasons", "authorized"))


@query("reconcile", ["fx_fill_once", "fx_venue_position"], f"""
, local AS (SELECT account, instrument, SUM(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty FROM fx_fill_once GROUP BY 1, 2)
SELECT coalesce(l.account, x.account) AS account, coalesce(l.instrument, x.instrument) AS instrument,
       CASE WHEN x.account IS NULL THEN 'only_local' WHEN l.account IS NULL THEN 'only_venue' WHEN l.qty = x.qty THEN 'match' ELSE 'differs' END AS status,
       {d('l.qty', 'local_qty')}, {d('x.qty', 'venue_qty')}
FROM local l FULL OUTER JOIN fx_venue_position x ON x.account = l.account AND x.instrument = l.instrument""")
def _(v):
    from marketops.operators.portfolio import positions

    out = joins.reconcile(positions(v("fx_fill_once")), v("fx_venue_position"), ["account", "instrument"], ["qty"])
    return plain(out.select("account", "instrument", "status", F.col("local.qty").alias("local_qty"), F.col("venue.qty").alias("venue_qty")))


@query("reconcile_book", ["fx_order", "fx_venue_order", "fx_fill_once", "fx_venue_fill", "fx_balance", "fx_venue_balance", "fx_venue_position"], """
, local AS (SELECT account, instrument, SUM(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty FROM fx_fill_once GROUP BY 1, 2),
pairs AS (
  SELECT 'order' AS kind, coalesce(a.client_order_id, b.client_order_id) AS id, a.client_order_id IS NULL AS x, b.client_order_id IS NULL AS y, a.qty = b.qty AS same
  FROM fx_order a FULL OUTER JOIN fx_venue_order b ON a.client_order_id = b.client_order_id
  UNION ALL SELECT 'fill', coalesce(a.fill_id, b.fill_id), a.fill_id IS NULL, b.fill_id IS NULL, a.qty = b.qty AND a.price = b.price FROM fx_fill_once a FULL OUTER JOIN fx_venue_fill b ON a.fill_id = b.fill_id
  UNION ALL SELECT 'balance', coalesce(a.account, b.account), a.account IS NULL, b.account IS NULL, a.balance = b.balance FROM fx_balance a FULL OUTER JOIN fx_venue_balance b ON a.account = b.account
  UNION ALL SELECT 'position', coalesce(a.account, b.account) || '/' || coalesce(a.instrument, b.instrument), a.account IS NULL, b.account IS NULL, a.qty = b.qty
  FROM local a FULL OUTER JOIN fx_venue_position b ON a.account = b.account AND a.instrument = b.instrument)
SELECT kind, id, CASE WHEN x THEN 'only_venue' WHEN y THEN 'only_local' ELSE 'differs' END AS status FROM pairs WHERE x OR y OR NOT same""")
def _(v):
    from marketops.operators.portfolio import positions

    fills = v("fx_fill_once")
    return plain(joins.reconcile_book({
        "order": (v("fx_order"), v("fx_venue_order"), ["client_order_id"], ["qty"]),
        "fill": (fills, v("fx_venue_fill"), ["fill_id"], ["qty", "price"]),
        "balance": (v("fx_balance"), v("fx_venue_balance"), ["account"], ["balance"]),
        "position": (positions(fills), v("fx_venue_position"), ["account", "instrument"], ["qty"]),
    }))


@query("reconciliation_passed", ["fx_fill_once", "fx_venue_position"], """
, local AS (SELECT account, instrument, SUM(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty FROM fx_fill_once GROUP BY 1, 2)
SELECT count(*) AS n_keys, count(*) FILTER (x.qty IS NULL OR l.qty IS NULL OR abs(l.qty - x.qty) > 1) AS differences,
       count(*) FILTER (x.qty IS NULL OR l.qty IS NULL OR abs(l.qty - x.qty) > 1) = 0 AS passed
FROM local l FULL OUTER JOIN fx_venue_position x ON x.account = l.account AND x.instrument = l.instrument""")
def _(v):
    from marketops.operators.portfolio import positions

    out = joins.reconcile(positions(v("fx_fill_once")), v("fx_venue_position"), ["account", "instrument"], ["qty"], tolerance=1)
    return plain(joins.reconciliation_passed(out))


_SPANS = """
, changes AS (SELECT *, lag(kind) OVER (PARTITION BY instrument ORDER BY ts, seq) AS pk FROM fx_listing),
ends AS (SELECT *, lead(ts) OVER (PARTITION BY instrument ORDER BY ts, seq) AS nt FROM changes WHERE kind IS DISTINCT FROM pk),
spans AS (SELECT instrument, ts AS valid_from, nt AS valid_to FROM ends WHERE kind = 'list' AND (nt IS NULL OR nt > ts))"""


@query("point_in_time_members", ["fx_snapshot", "fx_listing"], _SPANS + """
SELECT s.instrument, s.seq FROM fx_snapshot s JOIN spans m ON m.instrument = s.instrument AND s.ts >= m.valid_from AND (m.valid_to IS NULL OR s.ts < m.valid_to)""")
def _(v):
    from marketops.operators.universe import membership_intervals

    spans = membership_intervals(v("fx_listing"))
    return plain(joins.point_in_time_members(v("fx_snapshot").select("instrument", "seq", "ts"), spans).select("instrument", "seq"))


@query("membership_intervals", ["fx_listing"], _SPANS + " SELECT * FROM spans")
def _(v):
    from marketops.operators.universe import membership_intervals

    return plain(membership_intervals(v("fx_listing")))


@query("survivorship_audit", ["fx_snapshot", "fx_listing"], _SPANS + """
, graded AS (SELECT s.instrument, EXISTS (SELECT 1 FROM spans m WHERE m.instrument = s.instrument AND s.ts >= m.valid_from AND (m.valid_to IS NULL OR s.ts < m.valid_to)) AS member
             FROM fx_snapshot s WHERE s.liquidity > 30000)
SELECT instrument, count(*) AS n, 'outside_membership' AS violation FROM graded WHERE NOT member GROUP BY 1
UNION ALL SELECT instrument, count(*), 'delisted_never_evaluated' FROM spans s GROUP BY instrument
HAVING count(*) FILTER (valid_to IS NULL) = 0 AND NOT EXISTS (SELECT 1 FROM graded g WHERE g.member AND g.instrument = s.instrument)""")
def _(v):
    from marketops.operators.universe import membership_intervals, survivorship_audit

    return plain(survivorship_audit(v("fx_snapshot").where("liquidity > 30000"), membership_intervals(v("fx_listing"))))


@query("policy_join", ["fx_snapshot", "fx_policy"], f"""
SELECT s.instrument, s.seq, {d('coalesce(i.value, f.value)', 'max_age_us')}, {d('m.value', 'max_leverage')} FROM fx_snapshot s
LEFT JOIN fx_policy i ON i.scope = 'instrument' AND i.name = 'max_age_us' AND i.key = s.instrument
LEFT JOIN fx_policy f ON f.scope = 'feed' AND f.name = 'max_age_us' AND f.key = s.source
LEFT JOIN fx_policy m ON m.scope = 'instrument' AND m.name = 'max_leverage' AND m.key = s.instrument""")
def _(v):
    out = joins.policy_join(v("fx_snapshot"), v("fx_policy"), {"instrument": "instrument", "feed": "source"}, ["max_age_us", "max_leverage"])
    return plain(out.select("instrument", "seq", "max_age_us", "max_leverage"))


@query("mode_limits", ["fx_risk"], """
SELECT m.mode, count(*) FILTER (leverage > m.lev) AS above, count(*) AS n FROM fx_risk, (VALUES ('paper', 3), ('shadow', 3), ('live', 2)) m(mode, lev) GROUP BY ALL""")
def _(v):
    grid = [{"mode": mode, "lev": limits["max_leverage"]} for mode, limits in S.MODE_LIMITS.items()]
    rows = joins.param_grid(v("fx_risk").select("leverage"), grid)
    return plain(rows.groupBy("params.mode").agg(F.count(F.when(F.col("leverage") > F.col("params.lev"), 1)).alias("above"), F.count("*").alias("n")))


FIRST_INVALIDATION_SQL = """
SELECT g.signal_id, min(s.ts) AS invalidated_at FROM fx_signal g
LEFT JOIN fx_snapshot s ON s.instrument = g.instrument AND s.ts > g.ts AND s.ts <= g.ts + to_microseconds(g.horizon_us)
  AND CASE WHEN g.direction = 'long' THEN s.last <= g.invalidation_level ELSE s.last >= g.invalidation_level END
GROUP BY g.signal_id"""


@query("first_invalidation", ["fx_signal", "fx_snapshot"], FIRST_INVALIDATION_SQL)
def _(v):
    return plain(joins.first_invalidation(v("fx_signal"), v("fx_snapshot"), levels=2).select("signal_id", "invalidated_at"))


@query("unprotected_positions", ["fx_position", "fx_stop"], f"""
SELECT account, strategy_id, instrument, {d('qty', 'qty')} FROM fx_position p
WHERE qty <> 0 AND NOT EXISTS (SELECT 1 FROM fx_stop s WHERE s.account = p.account AND s.instrument = p.instrument AND s.acked_at IS NOT NULL)""")
def _(v):
    return plain(joins.unprotected_positions(v("fx_position"), v("fx_stop")))


@query("instruments_with_fills", ["fx_mark_latest", "fx_fill"], f"""
SELECT instrument, {d('price', 'price')} FROM fx_mark_latest m WHERE EXISTS (SELECT 1 FROM fx_fill f WHERE f.instrument = m.instrument)""")
def _(v):
    return plain(joins.instruments_with_fills(v("fx_mark_latest"), v("fx_fill")))


@query("param_grid", ["fx_signal"], """
SELECT signal_id, CAST(param_id AS BIGINT) AS param_id, confidence > min_conf AS trades FROM fx_signal, (VALUES (0, 0.2), (1, 0.5), (2, 0.8)) g(param_id, min_conf)""")
def _(v):
    out = joins.param_grid(v("fx_signal"), [{"min_conf": 0.2}, {"min_conf": 0.5}, {"min_conf": 0.8}])
    return plain(out.select("signal_id", "params.param_id", (F.col("confidence").cast("double") > F.col("params.min_conf")).alias("trades")))


# Sources

@query("scan_dataset", ["fx_raw"], """
SELECT instrument, seq, event_type, event_ts FROM fx_raw WHERE event_type = 'click' AND event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-21'""")
def _(v):
    folder = v.fresh_folder()
    datasets.write_dataset(v("fx_raw"), folder, 1, partitions=("venue", "event_type", "date"))
    out = datasets.scan_dataset(v.spark, folder, venue="venue-a", event_type="click", date_from="2024-01-10", date_to="2024-01-20")
    return plain(out.select("instrument", "seq", "event_type", "event_ts"))


@query("read_version", ["fx_raw"], """
SELECT seq, payload, CAST(1 AS BIGINT) AS version FROM fx_raw WHERE schema_version <> 2
UNION ALL SELECT seq, payload || ' corrected', 2 FROM fx_raw WHERE schema_version = 2""")
def _(v):
    raw = v("fx_raw")
    fixed = raw.where("schema_version = 2")
    versions = raw.withColumn("version", F.lit(1)).unionByName(
        fixed.withColumn("payload", F.concat("payload", F.lit(" corrected"))).withColumn("version", F.lit(2))
    ).unionByName(fixed.withColumn("payload", F.lit("later")).withColumn("version", F.lit(3)))
    return plain(datasets.read_version(versions, 2).select("seq", "payload", "version"))


@query("normalize_raw", ["fx_raw"], f"""
SELECT seq, {d("try_cast(nullif(regexp_extract(payload, '\"bid\":\"([^\"]*)\"', 1), '') AS DECIMAL(18,8))", 'bid')},
       {d("try_cast(nullif(regexp_extract(payload, '\"ask\":\"([^\"]*)\"', 1), '') AS DECIMAL(18,8))", 'ask')}, NULL AS malformed
FROM fx_raw WHERE payload LIKE '{{%' AND payload NOT LIKE '%n/a%'
UNION ALL SELECT seq, NULL, NULL, CASE WHEN payload LIKE '{{%' THEN 'bad_number' ELSE 'malformed_json' END FROM fx_raw
WHERE payload NOT LIKE '{{%' OR payload LIKE '%n/a%'""")
def _(v):
    good, bad = datasets.normalize_raw(v("fx_raw"))
    kind = "decimal(18,8)"
    none = F.lit(None)
    out = good.select("seq", "bid", "ask", none.cast("string").alias("malformed")).unionByName(
        bad.select("seq", none.cast(kind).alias("bid"), none.cast(kind).alias("ask"), "malformed")
    )
    return plain(out)


_CONFIG = {"mode": "paper", "max_leverage": 3}


@query("dataset_manifest", ["fx_raw"], f"""
SELECT channel, count(*) AS rows, min(event_ts) AS min_ts, max(event_ts) AS max_ts, '{datasets.config_hash(_CONFIG)}' AS config_hash, TRUE AS same_digest
FROM fx_raw GROUP BY channel""")
def _(v):
    raw = v("fx_raw")
    a = datasets.dataset_manifest(raw, _CONFIG, by=["channel"])
    b = datasets.dataset_manifest(raw.repartition(13, "seq"), _CONFIG, by=["channel"]).select("channel", F.col("digest").alias("other"))
    out = a.join(b, "channel")
    return plain(out.select("channel", "rows", "min_ts", "max_ts", "config_hash", (F.col("digest") == F.col("other")).alias("same_digest")))


@query("append_audit", ["fx_risk"], """SELECT decision_id, approved, count(*) AS copies FROM fx_risk GROUP BY ALL""")
def _(v):
    folder = v.fresh_folder()
    rows = v("fx_risk").select("decision_id", "approved", "ts")
    datasets.append_audit(rows.where("approved"), folder, ["decision_id"])
    datasets.append_audit(rows, folder, ["decision_id"])
    datasets.append_audit(rows, folder, ["decision_id"])
    log = v.spark.read.parquet(folder)
    return plain(log.groupBy("decision_id", "approved").agg(F.count("*").alias("copies")))


@query("split_valid_counts", ["fx_snapshot"], f"""
SELECT source, count(*) FILTER (r = '') AS valid, count(*) FILTER (r <> '') AS quarantined FROM (SELECT source, {breaches(SNAPSHOT_BREACHES)} AS r FROM fx_snapshot) z GROUP BY source""")
def _(v):
    snaps = v("fx_snapshot")
    valid, bad = split_valid(snaps, contracts.snapshot_checks(columns=snaps.columns))
    both = valid.select("source", F.lit(1).alias("ok")).unionByName(bad.select("source", F.lit(0).alias("ok")))
    return plain(both.groupBy("source").agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("quarantined")))
