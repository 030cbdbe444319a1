"""Queries over features, universe, monitoring, research and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketops.functions.timing import shift, us
from marketops.operators import contracts, features, joins, monitoring, orders, portfolio, quality, research, risk, universe
from marketops.plans.book_queries import _MARKED, GATE_SQL, W, valued_positions
from marketops.plans.gate_queries import STICKY_SQL
from marketops.plans.registry import Inputs, as_placed, d, n, plain, query
from marketops.session import materialize
from marketops.sources.fixtures import VIEWS, table
from marketops.streaming import streams, timed

_MID = "CAST(ask + bid AS DOUBLE) / 2"
_PX = "CAST(last AS DOUBLE)"
_W = "PARTITION BY instrument ORDER BY ts, seq"


# Features

@query("mid_spread", ["fx_snapshot"], f"""
SELECT instrument, seq, {d(_MID, 'mid')}, {d('ask - bid', 'spread')}, {d(f'CAST(ask - bid AS DOUBLE) / ({_MID}) * 10000', 'spread_bps', 4)} FROM fx_snapshot""")
def _(v):
    return plain(features.mid_spread(v("fx_snapshot")).select("instrument", "seq", "mid", "spread", "spread_bps"), spread_bps=4)


_BAR = f"""arg_min(last, (ts, seq)) AS o, max(last) AS h, min(last) AS l, arg_max(last, (ts, seq)) AS c, sum(volume) AS v, count(*) AS ticks,
  CAST(sum(CAST(last AS DECIMAL(38,8)) * volume) AS DOUBLE) / nullif(CAST(sum(volume) AS DOUBLE), 0) AS vwap"""
_BAR_OUT = f"{d('o', 'open')}, {d('h', 'high')}, {d('l', 'low')}, {d('c', 'close')}, {d('v', 'volume')}, ticks, {d('vwap', 'vwap')}"


@query("bars", ["fx_snapshot"], f"""
SELECT instrument, window_start, {_BAR_OUT} FROM (SELECT instrument, time_bucket(INTERVAL '6 hours', ts) AS window_start, {_BAR} FROM fx_snapshot GROUP BY 1, 2) z""")
def _(v):
    return plain(features.bars(v("fx_snapshot"), "6 hours").drop("window_end"))


@query("bars_sliding", ["fx_snapshot"], f"""
SELECT instrument, window_start, {_BAR_OUT} FROM (
  SELECT instrument, time_bucket(INTERVAL '6 hours', ts) - o.x * INTERVAL '6' HOUR AS window_start, {_BAR} FROM fx_snapshot, (VALUES (0), (1)) o(x) GROUP BY 1, 2) z""")
def _(v):
    return plain(features.bars(v("fx_snapshot"), "12 hours", "6 hours").drop("window_end"))


@query("rolling_volatility", ["fx_snapshot"], f"""
, rets AS (SELECT instrument, ts, seq, ln({_PX} / lag({_PX}) OVER ({_W})) AS r FROM fx_snapshot)
SELECT instrument, seq, {d('CASE WHEN c = 5 THEN s END', 'volatility')} FROM (
  SELECT *, stddev_samp(r) OVER w AS s, count(r) OVER w AS c FROM rets WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) z""")
def _(v):
    return plain(features.rolling_volatility(v("fx_snapshot"), 5, width="1 day").select("instrument", "seq", "volatility"))


@query("liquidity_measure", ["fx_snapshot"], f"""
, rolled AS (SELECT instrument, ts, seq, sum(CAST(last AS DECIMAL(38,8)) * volume) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS liq, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS b FROM fx_snapshot),
closes AS (SELECT b, instrument, arg_max(liq, (ts, seq)) AS x FROM rolled GROUP BY 1, 2),
ranked AS (SELECT *, percent_rank() OVER (PARTITION BY b ORDER BY x) AS r FROM closes)
SELECT q.instrument, q.seq, {d('q.liq', 'liquidity')}, {d('k.r', 'liquidity_rank')} FROM rolled q LEFT JOIN ranked k ON k.instrument = q.instrument AND k.b = q.b - INTERVAL '5 days'""")
def _(v):
    return plain(features.liquidity_measure(v("fx_snapshot"), 4, width="1 day", normalize="5 days").select("instrument", "seq", "liquidity", "liquidity_rank"))


@query("momentum", ["fx_snapshot"], f"SELECT instrument, seq, {d(f'{_PX} / lag({_PX}, 3) OVER ({_W}) - 1', 'momentum')} FROM fx_snapshot")
def _(v):
    return plain(features.momentum(v("fx_snapshot"), 3, width="1 day").select("instrument", "seq", "momentum"))


@query("breakout", ["fx_snapshot"], f"""
SELECT instrument, seq, CAST(CASE WHEN c = 4 THEN CASE WHEN last > hi THEN 1 WHEN last < lo THEN -1 ELSE 0 END END AS BIGINT) AS breakout FROM (
  SELECT *, max(last) OVER w AS hi, min(last) OVER w AS lo, count(*) OVER w AS c FROM fx_snapshot WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) z""")
def _(v):
    return plain(features.breakout(v("fx_snapshot"), 4, width="1 day").select("instrument", "seq", "breakout"))


@query("pullback", ["fx_snapshot"], f"""
SELECT instrument, seq, CASE WHEN p IS NOT NULL THEN {_PX} > p AND {_PX} <= hi * (1 - 0.05) END AS pullback FROM (
  SELECT *, max({_PX}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hi, lag({_PX}, 4) OVER ({_W}) AS p FROM fx_snapshot) z""")
def _(v):
    return plain(features.pullback(v("fx_snapshot"), 4, 0.05, width="1 day").select("instrument", "seq", "pullback"))


@query("leakage_audit", ["fx_raw", "fx_risk"], """
, used AS (SELECT decision_id, ts, CASE WHEN k < 60 THEN event_id - 1 ELSE event_id + 3 END AS seq, k FROM fx_risk)
SELECT u.decision_id, CASE WHEN NOT coalesce(f.persisted_ts <= u.ts, FALSE) THEN 'available_after_decision' ELSE 'frame_reaches_forward' END AS violation
FROM used u LEFT JOIN fx_raw f ON f.seq = u.seq
WHERE NOT coalesce(f.persisted_ts <= u.ts, FALSE) OR coalesce(f.event_ts + INTERVAL '3' SECOND > u.ts, FALSE)""")
def _(v):
    frames = v("fx_raw").select(F.col("seq").alias("feature_id"), F.col("persisted_ts").alias("available_at"), shift("event_ts", 3_000_000).alias("frame_end"))
    used = v("fx_risk").select(F.when(F.col("k") < 60, F.col("event_id") - 1).otherwise(F.col("event_id") + 3).alias("feature_id"), "decision_id", "ts")
    return plain(features.leakage_audit(frames, used).select("decision_id", "violation"))


def emitted(v: Inputs):
    rows = features.breakout(v("fx_snapshot"), 4, width="1 day")
    rows = rows.withColumn("confidence", F.least(F.col("volume") / 1000, F.lit(1)))
    return features.emit_signals(rows, F.col("breakout"), "breakout-4-v1", 0.01, 14_400_000_000, F.col("confidence"), F.lit(0.02), 0.05)


@query("emit_signals", ["fx_snapshot"], f"""
, marked AS (
  SELECT *, CASE WHEN c = 4 THEN CASE WHEN last > hi THEN 1 WHEN last < lo THEN -1 ELSE 0 END END AS b FROM (
    SELECT *, max(last) OVER w AS hi, min(last) OVER w AS lo, count(*) OVER w AS c FROM fx_snapshot WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) z)
SELECT sha256('breakout-4-v1|' || instrument || '|' || CAST(epoch_us(ts) AS VARCHAR) || '|' || CAST(seq AS VARCHAR)) AS signal_id, instrument,
       CASE b WHEN 1 THEN 'long' ELSE 'short' END AS direction, {d(f'{_PX} * 0.99', 'low')}, {d(f'{_PX} * 1.01', 'high')},
       {d(f'{_PX} * (1 - b * 0.05)', 'invalidation_level')}, {d('least(volume / 1000, 1)', 'confidence')}, 14400000000 AS horizon_us
FROM marked WHERE b IN (1, -1)""")
def _(v):
    out = emitted(v)
    return plain(out.select("signal_id", "instrument", "direction", F.col("entry_zone.low").alias("low"), F.col("entry_zone.high").alias("high"),
                            "invalidation_level", "confidence", "horizon_us"))


# Universe

@query("select_universe", ["fx_snapshot"], f"""
, daily AS (SELECT CAST(ts AS DATE) + 1 AS date, instrument, sum(liquidity) AS liq FROM fx_snapshot GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY liq DESC, instrument) AS rank FROM daily)
SELECT strftime(date, '%Y-%m-%d') AS date, instrument, rank, {d('liq', 'liquidity')}, count(*) OVER (PARTITION BY date) < 20 AS undersized FROM ranked WHERE rank <= 100""")
def _(v):
    from marketops.schemas import MODE_LIMITS

    limits = MODE_LIMITS["paper"]
    rows = v("fx_snapshot").select(F.to_date("ts").alias("date"), "instrument", "liquidity")
    out = universe.select_universe(rows, limits["minimum_markets"], limits["maximum_markets"])
    return plain(out.withColumn("date", F.col("date").cast("string")))


# Monitoring

_TIMELINE = """
, line AS (SELECT state, from_ts, seq, lead(from_ts) OVER (ORDER BY from_ts, seq) AS to_ts, lead(state) OVER (ORDER BY from_ts, seq) AS nxt FROM fx_state),
timeline AS (SELECT *, epoch_us(to_ts) - epoch_us(from_ts) AS duration_us, CASE WHEN state = 'STARTING' AND nxt <> 'RECONCILING' THEN 'restart_not_reconciled'
  WHEN state IN ('DEGRADED', 'HALTED') AND nxt = 'READY' THEN 'reconnect_not_reconciled' END AS violation FROM line)"""


@query("state_timeline", ["fx_state"], _TIMELINE + " SELECT state, seq, from_ts, to_ts, duration_us, violation FROM timeline")
def _(v):
    return plain(monitoring.state_timeline(v("fx_state")).select("state", "seq", "from_ts", "to_ts", "duration_us", "violation"))


@query("time_in_state", ["fx_state"], _TIMELINE + f" SELECT state, count(*) AS visits, {n('sum(duration_us)', 'total_us')}, count(violation) AS violations FROM timeline GROUP BY 1")
def _(v):
    return plain(monitoring.time_in_state(monitoring.state_timeline(v("fx_state"))))


_TRADE_PATH = """
, path AS (SELECT account, instrument, ts, recv_seq, sum(CASE WHEN side = 'buy' THEN CAST(qty AS DECIMAL(38,8)) ELSE -CAST(qty AS DECIMAL(38,8)) END)
             OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM fx_trade),
stated AS (SELECT r.*, s.state FROM fx_request r ASOF LEFT JOIN fx_state s ON r.ts >= s.from_ts),
held AS (SELECT r.*, p.position FROM stated r ASOF LEFT JOIN path p ON p.account = r.account AND p.instrument = r.instrument AND r.ts >= p.ts),
outside AS (SELECT * FROM held WHERE NOT coalesce(state = 'READY' OR (state IN ('DEGRADED', 'HALTED') AND reduce_only
  AND CASE WHEN side = 'buy' THEN position < 0 ELSE position > 0 END AND quantity <= abs(position)), FALSE))"""


def outside_ready(v: Inputs):
    path = portfolio.position_path(v("fx_trade"), order=("ts", "recv_seq"))
    return monitoring.exposure_outside_ready(v("fx_request"), v("fx_state"), path)


@query("exposure_outside_ready", ["fx_request", "fx_state", "fx_trade"], _TRADE_PATH + f" SELECT request_id, state, {d('position', 'position')} FROM outside")
def _(v):
    return plain(outside_ready(v).select("request_id", "state", "position"))


@query("kill_switch_audit", ["fx_request", "fx_kill"], """
SELECT request_id FROM fx_request r WHERE NOT reduce_only AND EXISTS (SELECT 1 FROM fx_kill k WHERE k.engaged_at <= r.ts AND r.ts < k.released_at)""")
def _(v):
    return plain(monitoring.kill_switch_audit(v("fx_request"), v("fx_kill")).select("request_id"))


_INVARIANTS = {
    "max_exposure": "SELECT account || '/' || instrument AS id FROM valued GROUP BY account, instrument HAVING NOT coalesce(count(notional) = count(*) AND abs(sum(notional)) <= 100000, FALSE)",
    "leverage": "SELECT decision_id AS id FROM fx_decision WHERE max_leverage > 20 OR leverage > max_leverage",
    "reduce_only": "SELECT fill_id AS id FROM reduced",
    "fill_counted_once": "SELECT fill_id AS id FROM fx_fill GROUP BY fill_id HAVING count(*) > 1",
    "duplicate_order_events": "SELECT client_order_id AS id FROM fx_request GROUP BY 1 HAVING count(*) > 1",
    "stale_inputs": "SELECT g.signal_id AS id FROM fx_signal g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts >= s.ts WHERE NOT coalesce(s.quality IN ('live', 'delayed') AND epoch_us(g.ts) - epoch_us(s.ts) <= 86400000000, FALSE)",
    "nothing_lost_on_restart": "SELECT coalesce(l.account, x.account) || '/' || coalesce(l.instrument, x.instrument) AS id FROM local l FULL OUTER JOIN fx_venue_position x ON x.account = l.account AND x.instrument = l.instrument WHERE l.qty IS DISTINCT FROM x.qty",
    "failure_blocks_exposure": "SELECT request_id AS id FROM outside",
    "replay_identical": "SELECT signal_id AS id FROM fx_signal WHERE value > 250",
}
_FS = "CASE WHEN side = 'buy' THEN CAST(qty AS DECIMAL(38,8)) ELSE -CAST(qty AS DECIMAL(38,8)) END"


@query("invariant_report", ["fx_position", "fx_mark_latest", "fx_decision", "fx_fill", "fx_fill_once", "fx_request", "fx_signal", "fx_snapshot", "fx_venue_position", "fx_state", "fx_trade"],
       _TRADE_PATH + f"""
, valued AS (SELECT p.account, p.instrument, CAST(p.qty AS DECIMAL(38,8)) * CAST({_MARKED} AS DECIMAL(18,8)) AS notional FROM fx_position p LEFT JOIN fx_mark_latest m ON m.instrument = p.instrument),
local AS (SELECT account, instrument, sum({_FS}) AS qty FROM fx_fill_once GROUP BY 1, 2),
walked AS (SELECT *, sum({_FS}) OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM fx_fill_once),
reduced AS (SELECT * FROM walked WHERE reduce_only AND (abs(position) > abs(position - {_FS}) OR sign(position) * sign(position - {_FS}) < 0)),
broken AS ({' UNION ALL '.join(f"SELECT {i + 1} AS number, '{name}' AS invariant, id FROM ({sql}) q{i}" for i, (name, sql) in enumerate(_INVARIANTS.items()))})
SELECT {n('number', 'number')}, invariant, count(*) AS violations, array_to_string(list_sort(list(id))[1:3], ',') AS sample_ids FROM broken GROUP BY 1, 2""")
def invariant_report(v: Inputs):
    """All nine mandatory invariants over the derived tables, each with its planted violations."""
    held = risk.exposure(valued_positions(v), ["account", "instrument"]).where("`grouping` = 0")
    exposures = held.where(~F.coalesce(F.abs("net") <= 100_000, F.lit(False)))
    pair = F.concat_ws("/", "account", "instrument").alias("id")
    _, leverage = contracts.validate_risk_decisions(v("fx_decision"), rules="core")
    fresh = joins.asof_join(v("fx_signal").select("signal_id", "instrument", "ts"), v("fx_snapshot").select("instrument", "ts", "seq", "quality"), ["instrument"], tolerance="1 day", width="1 day")
    local = portfolio.positions(v("fx_fill_once"))
    lost = joins.reconcile(local, v("fx_venue_position"), ["account", "instrument"], ["qty"]).where("status <> 'match'")
    first = v("fx_signal").select("signal_id", "config")
    second = first.withColumn("config", F.regexp_replace("config", "-hotfix", ""))
    return plain(monitoring.invariant_report({
        "max_exposure": exposures.select(pair),
        "leverage": leverage.select(F.col("decision_id").alias("id")),
        "reduce_only": orders.reduce_only_audit(v("fx_fill_once"), order=("ts", "recv_seq", "fill_id"), width=W).select(F.col("fill_id").alias("id")),
        "fill_counted_once": v("fx_fill").groupBy("fill_id").count().where("count > 1").select(F.col("fill_id").alias("id")),
        "duplicate_order_events": v("fx_request").groupBy("client_order_id").count().where("count > 1").select(F.col("client_order_id").alias("id")),
        "stale_inputs": fresh.where(~F.coalesce(F.col("asof.quality").isin("live", "delayed"), F.lit(False))).select(F.col("signal_id").alias("id")),
        "nothing_lost_on_restart": lost.select(pair),
        "failure_blocks_exposure": outside_ready(v).select(F.col("request_id").alias("id")),
        "replay_identical": research.replay_parity(first, second).select(F.col("signal_id").alias("id")).distinct(),
    }))


_HEALTH = f"""
, health AS (SELECT venue, channel, time_bucket(INTERVAL '6 hours', event_ts) AS window_start, count(*) AS n, max(seq) - min(seq) + 1 - count(*) AS missing, max(seq) AS hi, min(seq) AS lo,
  count(*) FILTER (epoch_us(receipt_ts) - epoch_us(event_ts) > 60000000) AS late FROM fx_raw GROUP BY 1, 2, 3),
edged AS (SELECT * EXCLUDE (missing), missing + coalesce(lo - 1 - lag(hi) OVER (PARTITION BY venue, channel ORDER BY window_start), 0) AS missing FROM health)"""


@query("feed_health", ["fx_snapshot"], f"""
SELECT * EXCLUDE (lo, hi, missing), missing + coalesce(lo - 1 - lag(hi) OVER (PARTITION BY source ORDER BY window_start), 0) AS missing FROM (
SELECT source, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, max(seq) - min(seq) + 1 - count(*) AS missing, max(seq) AS hi, min(seq) AS lo,
  count(*) FILTER (epoch_us(receipt_ts) - epoch_us(ts) > 60000000) AS late, {d("avg(CASE WHEN quality IN ('live', 'delayed') THEN 0.0 ELSE 1.0 END)", 'stale_share')}
FROM fx_snapshot GROUP BY 1, 2) z""")
def _(v):
    return plain(monitoring.feed_health(v("fx_snapshot"), "1 day", "60 seconds", feed=["source"], ts="ts").drop("window_end"))


@query("alerts", ["fx_raw"], _HEALTH + f"""
, long AS (SELECT venue, channel, window_start, 'late' AS metric, CAST(late AS DOUBLE) AS value, 16.0 AS threshold FROM edged
           UNION ALL SELECT venue, channel, window_start, 'missing', CAST(missing AS DOUBLE), 50.0 FROM edged),
walked AS (SELECT *, value > threshold AS breach, lag(value > threshold) OVER (PARTITION BY venue, channel, metric ORDER BY window_start) AS was FROM long)
SELECT channel, metric, window_start, {d('value', 'value')} FROM walked WHERE breach AND NOT coalesce(was, FALSE)""")
def _(v):
    health = monitoring.feed_health(v("fx_raw"), "6 hours", "60 seconds")
    return plain(monitoring.alerts(health, {"late": 16, "missing": 50}, ["venue", "channel"]).select("channel", "metric", "window_start", "value"))


# Replay and research

@query("replay_parity", ["fx_risk"], f"""
, a AS (SELECT decision_id, approved, quantity FROM fx_risk), b AS (SELECT decision_id, approved, CASE WHEN value > 150 THEN quantity + 1 ELSE quantity END AS quantity FROM fx_risk)
SELECT 'run_a' AS side, decision_id, approved, {d('quantity', 'quantity')} FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x
UNION ALL SELECT 'run_b', decision_id, approved, {d('quantity', 'quantity')} FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y""")
def _(v):
    a = v("fx_risk").select("decision_id", "approved", "quantity", "value")
    b = a.withColumn("quantity", F.when(F.col("value") > 150, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(18,8)"))
    return plain(research.replay_parity(a.drop("value"), b.drop("value")))


@query("simulated_receive_order", ["fx_raw"], """
SELECT seq, receipt_ts + INTERVAL '5' SECOND AS available_at, row_number() OVER (ORDER BY receipt_ts, venue, channel, instrument, seq) AS place FROM fx_raw""")
def _(v):
    return plain(as_placed(research.simulated_receive_order(v("fx_raw"), "5 seconds")).select("seq", "available_at", "place"))


_EVAL = f"""
, quotes AS (SELECT instrument, ts, {_MID} AS mid, CAST(ask - bid AS DOUBLE) / ({_MID}) * 10000 AS spread, CAST(volume AS DOUBLE) AS vol FROM fx_snapshot),
timed AS (SELECT *, ts + INTERVAL '30' SECOND AS t0, ts + to_microseconds(horizon_us) + INTERVAL '30' SECOND AS t1, 1 + k AS quantity FROM fx_signal),
rates AS (SELECT instrument, ts, CAST((k - 50) * 0.00001 AS DECIMAL(18,8)) AS rate FROM fx_base WHERE event_type IN ('error', 'signup')),
opened AS (SELECT g.*, q.mid AS m0, q.spread AS s0, q.vol AS vol FROM timed g ASOF LEFT JOIN quotes q ON g.instrument = q.instrument AND g.t0 >= q.ts),
opened2 AS (SELECT * REPLACE (CASE WHEN f THEN m0 END AS m0, CASE WHEN f THEN s0 END AS s0, CASE WHEN f THEN vol END AS vol) FROM (
  SELECT g.*, q.ts >= g.t0 - INTERVAL '2' DAY AS f FROM opened g ASOF LEFT JOIN quotes q ON g.instrument = q.instrument AND g.t0 >= q.ts) z),
closed AS (SELECT g.*, CASE WHEN q.ts >= g.t1 - INTERVAL '2' DAY THEN q.mid END AS m1, CASE WHEN q.ts >= g.t1 - INTERVAL '2' DAY THEN q.spread END AS s1
  FROM opened2 g ASOF LEFT JOIN quotes q ON g.instrument = q.instrument AND g.t1 >= q.ts),
due AS (SELECT g.signal_id, sum(r.rate) AS due FROM timed g JOIN rates r ON r.instrument = g.instrument AND r.ts > g.t0 AND r.ts <= g.t1 GROUP BY 1),
costed AS (SELECT c.*, CASE WHEN direction = 'long' THEN 1 ELSE -1 END * (m1 - m0) / m0 AS gross, m0 IS NOT NULL AND m1 IS NULL AS censored,
                  CASE WHEN m0 IS NOT NULL AND m1 IS NOT NULL THEN (2 * (5.0 + 2.0) + (greatest(s0, 0) + greatest(s1, 0)) / 2) / 10000 END
                    + CASE WHEN direction = 'long' THEN 1 ELSE -1 END * coalesce(CAST(due AS DOUBLE), 0) AS cost,
                  CASE WHEN vol IS NOT NULL THEN least(1.0, vol * 0.1 / quantity) END AS ratio FROM closed c LEFT JOIN due d ON d.signal_id = c.signal_id),
evaluated AS (SELECT *, (gross - cost) * ratio AS net FROM costed)"""


def evaluated(v: Inputs):
    s = v("fx_signal").withColumn("quantity", 1 + F.col("k"))
    rates = v("fx_base").where("event_type IN ('error', 'signup')").select("instrument", "ts", ((F.col("k") - 50) * F.lit(0.00001)).cast("decimal(18,8)").alias("rate"))
    return research.evaluate_signals(s, v("fx_snapshot"), 5.0, 2.0, "2 days", rates, latency="30 seconds", participation=0.1)


@query("evaluate_signals", ["fx_base", "fx_signal", "fx_snapshot"], _EVAL + f" SELECT signal_id, {d('gross', 'gross')}, {d('cost', 'cost')}, {d('ratio', 'fill_ratio')}, {d('net', 'net')}, censored FROM evaluated")
def _(v):
    return plain(evaluated(v).select("signal_id", "gross", "cost", "fill_ratio", "net", "censored"))


_PLAN = research.walk_forward_folds("2024-01-01 00:00:00", "10 days", "4 days", "1 day", 4)
_FOLDS = """
, folds AS (SELECT i AS fold, TIMESTAMP '2024-01-01' + i * INTERVAL '4' DAY AS a, TIMESTAMP '2024-01-11' + i * INTERVAL '4' DAY AS b,
                   TIMESTAMP '2024-01-12' + i * INTERVAL '4' DAY AS c, TIMESTAMP '2024-01-16' + i * INTERVAL '4' DAY AS e FROM range(4) r(i)),
spans AS (SELECT fold, 'train' AS role, a AS x, b AS y FROM folds UNION ALL SELECT fold, 'test', c, e FROM folds)"""


@query("walk_forward_folds", ["fx_signal"], _FOLDS + f"""
SELECT {n('fold', 'fold')}, role, x AS from_ts, y AS to_ts, (SELECT count(*) FROM fx_signal s WHERE s.ts >= x AND s.ts < y) AS rows FROM spans""")
def _(v):
    counts = research.assign_folds(v("fx_signal"), _PLAN).groupBy("fold", "role").agg(F.count("*").alias("rows"))
    spans = research.fold_table(v("fx_signal"), _PLAN)
    return plain(spans.join(counts, ["fold", "role"], "left").na.fill(0, ["rows"]))


@query("assign_folds", ["fx_signal"], _FOLDS + f" SELECT s.signal_id, {n('fold', 'fold')}, role FROM fx_signal s JOIN spans f ON s.ts >= f.x AND s.ts < f.y")
def _(v):
    return plain(research.assign_folds(v("fx_signal"), _PLAN).select("signal_id", "fold", "role"))


_GRID = [{"min_conf": c, "max_cost": m} for c in (0.1, 0.3, 0.5) for m in (0.01, 0.02)]
_SWEEP = _EVAL + _FOLDS.replace("\n, folds", "\n, folds", 1) + """
, tried AS (SELECT e.net, g.param_id, f.fold, f.role FROM evaluated e JOIN spans f ON e.ts >= f.x AND e.ts < f.y
  JOIN (VALUES (0, 0.1, 0.01), (1, 0.1, 0.02), (2, 0.3, 0.01), (3, 0.3, 0.02), (4, 0.5, 0.01), (5, 0.5, 0.02)) g(param_id, min_conf, max_cost) ON CAST(e.confidence AS DOUBLE) >= g.min_conf AND e.cost <= g.max_cost WHERE e.net IS NOT NULL),
sweep AS (SELECT param_id, fold, role, count(*) AS n, avg(net) AS mean, stddev_samp(net) AS vol, avg(net) / nullif(stddev_samp(net), 0) AS sharpe,
                 avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(net) AS total FROM tried GROUP BY 1, 2, 3)"""


def sweep(v: Inputs):
    def rule(p):
        return (F.col("confidence").cast("double") >= p["min_conf"]) & (F.col("cost") <= p["max_cost"])

    return research.parameter_sweep(evaluated(v), _GRID, _PLAN, rule, seed=7)


@query("parameter_sweep", ["fx_base", "fx_signal", "fx_snapshot"], _SWEEP + f"""
SELECT {n('param_id', 'param_id')}, {n('fold', 'fold')}, role, n, {d('mean', 'mean')}, {d('vol', 'vol')}, {d('sharpe', 'sharpe')}, {d('hit_rate', 'hit_rate')}, {d('total', 'total')}, {n('7', 'seed')} FROM sweep""")
def _(v):
    return plain(sweep(v).drop("min_conf", "max_cost"))


@query("robust_selection", ["fx_base", "fx_signal", "fx_snapshot"], _SWEEP + f"""
, per AS (SELECT param_id, avg(sharpe) FILTER (role = 'test') AS oos, coalesce(stddev_samp(sharpe) FILTER (role = 'test'), 0) AS spread, min(sharpe) FILTER (role = 'test') AS worst,
                 avg(sharpe) FILTER (role = 'train') AS ins FROM sweep GROUP BY 1),
near AS (SELECT p.param_id, avg(q.oos) AS nb FROM per p JOIN per q ON abs(p.param_id // 2 - q.param_id // 2) + abs(p.param_id % 2 - q.param_id % 2) = 1 GROUP BY 1),
scored AS (SELECT p.param_id, oos, spread, worst, greatest(coalesce(ins - oos, 0), 0) AS decay, coalesce(abs(oos - nb), 0) AS instability FROM per p LEFT JOIN near x ON x.param_id = p.param_id)
SELECT {n('param_id', 'param_id')}, {d('oos', 'oos')}, {d('spread', 'spread')}, {d('worst', 'worst')}, {d('decay', 'decay')}, {d('instability', 'instability')},
       {d('oos - spread - decay - instability', 'score')}, row_number() OVER (ORDER BY oos - spread - decay - instability DESC NULLS LAST, param_id) AS rank FROM scored""")
def _(v):
    return plain(research.robust_selection(sweep(v), ["min_conf", "max_cost"]))


@query("performance_metrics", ["fx_base", "fx_signal", "fx_snapshot"], _EVAL + f"""
, kept AS (SELECT *, sum(net) OVER (PARTITION BY strategy_id ORDER BY ts, signal_id ROWS UNBOUNDED PRECEDING) AS cum FROM evaluated WHERE net IS NOT NULL),
peaks AS (SELECT *, greatest(max(cum) OVER (PARTITION BY strategy_id ORDER BY ts, signal_id ROWS UNBOUNDED PRECEDING), 0) - cum AS fall FROM kept)
SELECT strategy_id, count(*) AS n, {d('avg(net)', 'mean')}, {d('stddev_samp(net)', 'vol')}, {d('avg(net) / stddev_samp(net)', 'sharpe')}, {d('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'hit_rate')},
       {d('sum(net) FILTER (net > 0) / sum(-net) FILTER (net < 0)', 'profit_factor')}, {d('max(fall)', 'max_dd')}, {d('sum(quantity)', 'turnover')} FROM peaks GROUP BY 1""")
def _(v):
    return plain(research.performance_metrics(evaluated(v), ["strategy_id"], traded="quantity"))


# Streams: the recorded events are read as a stream, drained into a table, and read back.

def streamed(v: Inputs, name: str):
    """A derived view whose events arrive as a stream."""
    from marketops.sources.fixtures import _NAME

    def build(view_name: str):
        if view_name == "events":
            schema = table(v.spark, v.sf_dir, "events").schema
            return streams.stream_events(v.spark, v.sf_dir, schema, glob="events.parquet", ts=["ts"])
        text = VIEWS[view_name].replace('{"bid"', '{{"bid"').replace("'\"}'", "'\"}}'")
        return v.spark.sql(text, **{dep: build(dep) for dep in set(_NAME.findall(VIEWS[view_name]))})

    return build(name)


def drained(v: Inputs, df):
    folder = v.fresh_folder()
    streams.run_to_table(df, folder)
    return v.spark.read.schema(df.schema).parquet(f"{folder}/data")


@query("stream_events", ["fx_raw"], "SELECT seq, channel, instrument, event_ts, payload FROM fx_raw")
def _(v):
    return plain(drained(v, streamed(v, "fx_raw").select("seq", "channel", "instrument", "event_ts", "payload")))


@query("stream_dedup_events", ["fx_delivered"], "SELECT DISTINCT venue, channel, instrument, seq, event_ts FROM fx_delivered")
def _(v):
    keep = streamed(v, "fx_delivered").select("venue", "channel", "instrument", "seq", "event_ts")
    return plain(drained(v, streams.dedup_stream(keep, "1 hour")))


def recorded(v: Inputs, df, ts: str, clock: str, files: int = 3):
    """A table recorded as files in order of time, and last a row that holds nothing but the time ``clock``: read as a stream, file by file."""
    # A file is written by one task, which must not derive the whole table for it.
    df, folder, at = materialize(df), v.fresh_folder(), us(ts)
    low, high = df.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // files + 1
    for i in range(files):
        inside = (at >= (low or 0) + i * step) & (at < (low or 0) + (i + 1) * step)
        df.where(inside).coalesce(1).write.mode("append").parquet(folder)
    tick = v.spark.range(1).select(*[(F.lit(clock) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    tick.write.mode("append").parquet(folder)
    return streams.stream_events(v.spark, folder, df.schema, files_per_batch=1)


_CLOCK = "2024-03-01 00:00:00"


@query("stream_sticky_quality", ["fx_snapshot"], STICKY_SQL)
def _(v):
    rows = v("fx_snapshot").select("instrument", "ts", "seq", "quality", (F.col("source") == "feed-view").alias("is_snapshot"))
    return plain(drained(v, timed.sticky_quality(recorded(v, rows, "ts", _CLOCK), "1 hour")).select("instrument", "seq", "effective_quality"))


@query("stream_feed_silence", ["fx_raw"], """
, near AS (SELECT instrument, event_ts, lag(event_ts) OVER w AS p, lead(event_ts) OVER w AS nxt FROM fx_raw WINDOW w AS (PARTITION BY venue, instrument ORDER BY event_ts, seq))
SELECT instrument, p AS from_ts, event_ts AS to_ts FROM near WHERE epoch_us(event_ts) - epoch_us(p) > 43200000000
UNION ALL SELECT instrument, event_ts, NULL FROM near WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(event_ts) > 43200000000""")
def _(v):
    rows = v("fx_raw").select("venue", "instrument", "event_ts")
    return plain(drained(v, timed.silences(recorded(v, rows, "event_ts", _CLOCK), "12 hours", "1 hour", ["venue", "instrument"])).drop("venue"))


@query("stream_feed_health", ["fx_raw"], _HEALTH + """
SELECT venue, channel, window_start, n, missing, late FROM health WHERE window_start + INTERVAL '6' HOUR <= (SELECT max(event_ts) - INTERVAL '1' HOUR FROM fx_raw)""")
def _(v):
    s = streamed(v, "fx_raw").withWatermark("event_ts", "1 hour")
    return plain(drained(v, monitoring.feed_health(s, "6 hours", "60 seconds")).select("venue", "channel", "window_start", "n", "missing", "late"))


@query("stream_bars", ["fx_snapshot"], f"""
SELECT instrument, window_start, {_BAR_OUT} FROM (SELECT instrument, time_bucket(INTERVAL '1 day', ts) AS window_start, {_BAR} FROM fx_snapshot GROUP BY 1, 2) z
WHERE window_start + INTERVAL '1' DAY <= (SELECT max(ts) - INTERVAL '1' HOUR FROM fx_snapshot)""")
def _(v):
    s = streamed(v, "fx_snapshot").withWatermark("ts", "1 hour")
    return plain(drained(v, features.bars(s, "1 day")).drop("window_end"))


@query("stream_sessions", ["fx_raw"], """
, gaps AS (SELECT *, CASE WHEN epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY instrument ORDER BY event_ts, seq)) < 21600000000 THEN 0 ELSE 1 END AS g FROM fx_raw),
islands AS (SELECT *, sum(g) OVER (PARTITION BY instrument ORDER BY event_ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
sessions AS (SELECT instrument, s, min(event_ts) AS session_start, max(event_ts) + INTERVAL '6' HOUR AS session_end, count(*) AS n FROM islands GROUP BY 1, 2)
SELECT instrument, session_start, session_end, n FROM sessions WHERE session_end <= (SELECT max(event_ts) - INTERVAL '1' HOUR FROM fx_raw)""")
def _(v):
    s = streamed(v, "fx_raw").select("instrument", "event_ts", "seq")
    return plain(drained(v, streams.session_activity(s, "6 hours", "1 hour", ["instrument"])))


@query("stream_missing_decisions", ["fx_signal", "fx_risk"], """
, open AS (SELECT s.signal_id, s.ts FROM fx_signal s WHERE NOT EXISTS (SELECT 1 FROM fx_risk d WHERE d.signal_id = s.signal_id AND d.ts BETWEEN s.ts AND s.ts + INTERVAL '75' SECOND))
SELECT signal_id, 'missing' AS cause FROM open
UNION ALL SELECT signal_id, 'late' FROM open s WHERE EXISTS (SELECT 1 FROM fx_risk d WHERE d.signal_id = s.signal_id AND d.ts > s.ts)""")
def _(v):
    asked, decided = (recorded(v, v(name).select("signal_id", "ts"), "ts", _CLOCK) for name in ("fx_signal", "fx_risk"))
    return plain(drained(v, timed.undecided(asked, decided, "75 seconds", "1 hour")).select("signal_id", "cause"))


@query("stream_alerts", ["fx_snapshot"], """
, marked AS (SELECT instrument, ts, seq, coalesce(quality IN ('stale', 'invalid'), FALSE) AS bad FROM fx_snapshot),
walked AS (SELECT *, lag(bad) OVER w AS was, max(CASE WHEN bad THEN ts END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marked
  WINDOW w AS (PARTITION BY instrument ORDER BY ts, bad DESC, seq))
SELECT instrument, ts FROM walked WHERE bad AND (NOT coalesce(was, FALSE) OR ts - before > INTERVAL '1' DAY)""")
def _(v):
    s = streamed(v, "fx_snapshot").select("instrument", "ts", "quality")
    out = streams.alert_stream(s, F.col("quality").isin("stale", "invalid"), ["instrument"], "ts", "1 day")
    return plain(drained(v, out).select("instrument", "ts"))


@query("stream_risk_gate", ["fx_signal", "fx_snapshot", "fx_policy"], GATE_SQL)
def stream_risk_gate(v: Inputs):
    """Signals meet the snapshot they knew in the stream's state; the gate then runs on each micro-batch of them, and its decisions are
    appended once to the audit log."""
    from marketops.plans.book_queries import gate_accounts
    from marketops.sources.datasets import append_audit

    folder = v.fresh_folder()
    sig = recorded(v, v("fx_signal").withColumn("account", F.concat(F.lit("acct-"), F.col("user_id").cast("string"))), "ts", _CLOCK)
    quotes = risk.quotes(recorded(v, v("fx_snapshot"), "ts", _CLOCK))
    accounts, limits = gate_accounts(v), v("fx_policy").where("name = 'max_leverage'")

    def step(batch, _):
        append_audit(risk.gate_priced(batch, accounts, limits), f"{folder}/log", ["decision_id"])

    streams.run_each_batch(risk.priced(timed.asof(sig, quotes, ["instrument"], "1 hour")), folder, step)
    log = v.spark.read.parquet(f"{folder}/log")
    return plain(log.select("signal_id", "approved", "reason_codes", "quantity", "notional", "max_leverage"), quantity=4, notional=2)


@query("late_share", ["fx_raw"], f"""
SELECT channel, {d('avg(CASE WHEN epoch_us(receipt_ts) - epoch_us(event_ts) > 60000000 THEN 1.0 ELSE 0.0 END)', 'late_share')} FROM fx_raw GROUP BY 1""")
def _(v):
    lag = us("receipt_ts") - us("event_ts")
    rows = quality.dedup_events(v("fx_delivered")).groupBy("channel")
    return plain(rows.agg(F.avg((lag > 60_000_000).cast("double")).alias("late_share")))
