"""Queries over orders, fills, positions and risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketops.operators import features, joins, orders, portfolio, quality, risk, signals
from marketops.plans.gate_queries import FIRST_INVALIDATION_SQL
from marketops.plans.registry import Inputs, d, n, plain, query, unmet

W = "30 days"
#: What position paths read.
LEDGER = ("account", "instrument", "ts", "recv_seq", "fill_id", "side", "qty")
_SIGNED = "CASE WHEN side = 'buy' THEN CAST(qty AS DECIMAL(38,8)) ELSE -CAST(qty AS DECIMAL(38,8)) END"
_CASH = "CASE WHEN side = 'buy' THEN -CAST(qty AS DECIMAL(38,8)) * price ELSE CAST(qty AS DECIMAL(38,8)) * price END"
_MID = "CAST(ask + bid AS DOUBLE) / 2"
_FLOOR8 = "floor({0} * 100000000 + 0.001) / 100000000"


# Signal lifecycle

def deadlines(v: Inputs):
    s = v("fx_signal").withColumn("policy_expiry", F.when(F.col("k") < 40, F.col("ts") + F.expr("INTERVAL 6 HOUR")))
    ended = joins.first_invalidation(s, v("fx_snapshot"), levels=2)
    return signals.signal_deadline(joins.policy_join(ended, v("fx_policy"), {"instrument": "instrument"}, ["max_age_us"]))


_DEADLINES = f"""
, invalid AS ({FIRST_INVALIDATION_SQL}),
timed AS (
  SELECT s.signal_id, s.instrument, s.ts, CASE WHEN s.k < 40 THEN s.ts + INTERVAL '6' HOUR END AS policy, s.ts + to_microseconds(s.horizon_us) AS horizon,
         s.ts + to_microseconds(coalesce(CAST(p.value AS BIGINT), 0)) AS stale, i.invalidated_at
  FROM fx_signal s LEFT JOIN fx_policy p ON p.scope = 'instrument' AND p.name = 'max_age_us' AND p.key = s.instrument
  LEFT JOIN invalid i ON i.signal_id = s.signal_id),
deadlines AS (SELECT *, least(policy, horizon, stale, invalidated_at) AS deadline FROM timed)"""


@query("signal_deadline", ["fx_signal", "fx_snapshot", "fx_policy"], _DEADLINES + """
SELECT signal_id, deadline, CASE deadline WHEN policy THEN 'policy' WHEN horizon THEN 'horizon' WHEN stale THEN 'staleness' WHEN invalidated_at THEN 'invalidation' END AS cause
FROM deadlines""")
def _(v):
    return plain(deadlines(v).select("signal_id", "deadline", "cause"))


@query("active_signals", ["fx_signal", "fx_snapshot", "fx_policy"], _DEADLINES + """
SELECT signal_id FROM deadlines WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND deadline > TIMESTAMP '2024-01-15 12:00:00'""")
def _(v):
    return plain(signals.active_signals(deadlines(v), "2024-01-15 12:00:00").select("signal_id"))


_OUTCOMES = """
, ended AS (SELECT *, ts + to_microseconds(horizon_us) AS end_at FROM fx_signal),
opened AS (SELECT g.*, CASE WHEN s.ts >= g.ts - INTERVAL '2' DAY THEN CAST(s.last AS DOUBLE) END AS p0 FROM ended g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts >= s.ts),
closed AS (SELECT g.*, coalesce(s.ts >= g.end_at - INTERVAL '2' DAY, FALSE) AS fresh, s.ts AS last_ts, CAST(s.last AS DOUBLE) AS p1 FROM opened g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.end_at >= s.ts),
outcomes AS (SELECT *, CASE WHEN fresh THEN CASE WHEN direction = 'long' THEN 1 ELSE -1 END * (p1 - p0) / p0 END AS realized, p0 IS NOT NULL AND NOT fresh AS censored,
  CASE WHEN p0 IS NOT NULL THEN CASE WHEN fresh THEN horizon_us ELSE greatest(epoch_us(last_ts) - epoch_us(ts), 0) END END AS followed_us FROM closed),
judged AS (SELECT *, realized >= CAST(expected_move AS DOUBLE) AS hit FROM outcomes)"""


@query("signal_outcomes", ["fx_signal", "fx_snapshot"], _OUTCOMES + f" SELECT signal_id, {d('realized', 'realized')}, hit, censored, followed_us FROM judged")
def _(v):
    return plain(signals.signal_outcomes(v("fx_signal"), v("fx_snapshot"), "2 days").select("signal_id", "realized", "hit", "censored", "followed_us"))


@query("hit_curve", ["fx_signal", "fx_snapshot"], _OUTCOMES + f"""
, per AS (SELECT strategy_id, followed_us, count(*) FILTER (hit) AS hits, count(*) AS n FROM judged WHERE followed_us IS NOT NULL GROUP BY 1, 2),
risk AS (SELECT *, sum(n) OVER (PARTITION BY strategy_id ORDER BY followed_us DESC) AS at_risk FROM per)
SELECT strategy_id, followed_us, {n('at_risk', 'at_risk')}, hits,
       {d('CASE WHEN bool_or(hits = at_risk) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN hits < at_risk THEN ln(1.0 - CAST(hits AS DOUBLE) / CAST(at_risk AS DOUBLE)) ELSE 0.0 END) OVER w) END', 'waiting')}
FROM risk WINDOW w AS (PARTITION BY strategy_id ORDER BY followed_us)""")
def _(v):
    return plain(signals.hit_curve(signals.signal_outcomes(v("fx_signal"), v("fx_snapshot"), "2 days"), ["strategy_id"]))


@query("confidence_calibration", ["fx_signal", "fx_snapshot"], _OUTCOMES + f"""
SELECT {n('least(floor(CAST(confidence * 100000000 AS BIGINT) * 10 / 100000000), 9)', 'bucket')}, count(*) AS n, {d('avg(CAST(hit AS INT))', 'hit_rate')},
       {d('avg(CAST(confidence AS DOUBLE))', 'mean_confidence')}, {d('avg(power(CAST(confidence AS DOUBLE) - CAST(hit AS INT), 2))', 'brier')}
FROM judged WHERE hit IS NOT NULL GROUP BY 1""")
def _(v):
    return plain(signals.confidence_calibration(signals.signal_outcomes(v("fx_signal"), v("fx_snapshot"), "2 days")))


@query("strategy_immutability", ["fx_signal"], """
SELECT strategy_id, count(*) AS variants, max(first_seen) AS latest_variant_since FROM (
  SELECT strategy_id, config, min(ts) AS first_seen FROM fx_signal GROUP BY 1, 2) z GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    return plain(signals.strategy_immutability(v("fx_signal")))


# Orders and fills

@query("order_state", ["fx_order_event"], """
SELECT client_order_id, arg_max(state, event_seq) AS state FROM fx_order_event GROUP BY 1""")
def _(v):
    return plain(orders.order_state(v("fx_order_event")))


@query("transition_audit", ["fx_order_event"], """
SELECT client_order_id, event_seq, p AS from_state, state AS to_state FROM (
  SELECT *, lag(state) OVER (PARTITION BY client_order_id ORDER BY event_seq) AS p FROM fx_order_event) z
WHERE p IS NOT NULL AND (p, state) NOT IN (('new', 'accepted'), ('new', 'partially_filled'), ('new', 'filled'), ('new', 'canceled'), ('new', 'rejected'),
  ('accepted', 'partially_filled'), ('accepted', 'filled'), ('accepted', 'canceled'),
  ('partially_filled', 'partially_filled'), ('partially_filled', 'filled'), ('partially_filled', 'canceled'))""")
def _(v):
    return plain(orders.transition_audit(v("fx_order_event")))


@query("fill_summary", ["fx_order", "fx_fill_once"], f"""
SELECT o.client_order_id, {d('coalesce(f.filled, 0)', 'filled')}, {d('o.qty - coalesce(f.filled, 0)', 'remaining')}, {d('value / CAST(filled AS DOUBLE)', 'vwap')},
       {d('CAST(made AS DOUBLE) / CAST(filled AS DOUBLE)', 'maker_share')}, {d('coalesce(f.fees, 0)', 'fees')} FROM fx_order o LEFT JOIN (
  SELECT client_order_id, sum(qty) AS filled, CAST(sum(CAST(qty AS DECIMAL(38,8)) * price) AS DOUBLE) AS value, sum(CASE WHEN maker THEN qty ELSE 0 END) AS made, sum(fee) AS fees
  FROM fx_fill_once GROUP BY 1) f ON f.client_order_id = o.client_order_id""")
def _(v):
    return plain(orders.fill_summary(v("fx_order"), v("fx_fill_once")).select("client_order_id", "filled", "remaining", "vwap", "maker_share", "fees"))


@query("overfills", ["fx_order", "fx_fill_once"], f"""
SELECT client_order_id, {d('filled', 'filled')}, reasons FROM (
  SELECT o.client_order_id, f.filled, {unmet({'filled_above_ordered': 'coalesce(f.filled, 0) <= o.qty', 'ordered_above_approved': 'o.qty <= a.approved_qty'})} AS reasons
  FROM fx_order o LEFT JOIN (SELECT client_order_id, sum(qty) AS filled FROM fx_fill_once GROUP BY 1) f ON f.client_order_id = o.client_order_id
  LEFT JOIN (SELECT decision_id, approved_qty FROM fx_order WHERE account <> 'acct-3') a ON a.decision_id = o.decision_id) z WHERE reasons <> ''""")
def _(v):
    o = v("fx_order")
    approved = o.where("account <> 'acct-3'").select("decision_id", F.col("approved_qty").alias("quantity"))
    out = orders.overfills(o.drop("approved_qty"), v("fx_fill_once"), approved)
    return plain(out.select("client_order_id", "filled", "reasons"))


_SLIP = f"""
, sent AS (SELECT *, ts - k * INTERVAL '1' SECOND AS arrival_ts FROM fx_trade),
arrived AS (SELECT t.*, CASE WHEN s.ts >= t.arrival_ts - INTERVAL '2' DAY THEN {_MID} END AS mid FROM sent t ASOF LEFT JOIN fx_snapshot s ON t.instrument = s.instrument AND t.arrival_ts >= s.ts),
slipped AS (SELECT *, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (CAST(price AS DOUBLE) - mid) / mid * 10000 AS slip,
                   CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (CAST(price AS DOUBLE) - CAST(limit_price AS DOUBLE)) / CAST(limit_price AS DOUBLE) * 10000 AS lim FROM arrived),
graded AS (SELECT *, NOT coalesce(slip <= 500, FALSE) OR coalesce(lim > 0, FALSE) AS breach FROM slipped)"""


def slipped(v: Inputs):
    """Trades against the mid known when their request was sent, ``k`` seconds before the fill."""
    trades = v("fx_trade").withColumn("arrival_ts", F.timestamp_micros(F.unix_micros("ts") - F.col("k").cast("bigint") * 1_000_000))
    return orders.slippage(trades, v("fx_snapshot"), 500, "arrival_ts", "2 days")


@query("slippage", ["fx_trade", "fx_snapshot"], _SLIP + f" SELECT fill_id, {d('slip', 'slippage_bps', 4)}, {d('lim', 'limit_bps', 4)}, breach FROM graded")
def _(v):
    return plain(slipped(v).select("fill_id", "slippage_bps", "limit_bps", "breach"), 4)


@query("slippage_summary", ["fx_trade", "fx_snapshot"], _SLIP + f"""
SELECT strategy_id, count(*) AS n, {d('quantile_cont(slip, 0.5)', 'p50', 4)}, {d('quantile_cont(slip, 0.95)', 'p95', 4)}, count(*) FILTER (breach) AS breaches FROM graded GROUP BY 1""")
def _(v):
    return plain(orders.slippage_summary(slipped(v)), 4)


@query("spread_and_band_guard", ["fx_request", "fx_snapshot"], f"""
SELECT request_id, {unmet({'no_price': 'mid IS NOT NULL', 'quote_quality': "quality IN ('live', 'delayed')", 'spread': 'spread <= 100', 'price_band': 'abs(mid - CAST(px AS DOUBLE)) / CAST(px AS DOUBLE) * 10000 <= 3000'})} AS reasons
FROM (SELECT request_id, px, CASE WHEN fresh THEN mid END AS mid, CASE WHEN fresh THEN quality END AS quality, CASE WHEN fresh THEN spread END AS spread
      FROM (SELECT r.request_id, r.px, s.quality, {_MID} AS mid, CAST(s.ask - s.bid AS DOUBLE) / ({_MID}) * 10000 AS spread, s.ts >= r.ts - INTERVAL '1' DAY AS fresh
            FROM (SELECT * FROM fx_request WHERE order_type = 'market') r ASOF LEFT JOIN fx_snapshot s ON r.instrument = s.instrument AND r.ts >= s.ts) y) z""")
def _(v):
    return plain(orders.spread_and_band_guard(v("fx_request"), v("fx_snapshot"), 100, 3000, "px", "1 day").select("request_id", "reasons"))


@query("reduce_only_audit", ["fx_fill_once"], f"""
SELECT fill_id, {d('position_before', 'position_before')}, {d('position', 'position')} FROM (
  SELECT *, position - {_SIGNED} AS position_before FROM (
    SELECT *, sum({_SIGNED}) OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM fx_fill_once) a) b
WHERE reduce_only AND (abs(position) > abs(position_before) OR sign(position) * sign(position_before) < 0)""")
def _(v):
    out = orders.reduce_only_audit(v.ledger(), order=("ts", "recv_seq", "fill_id"), width=W)
    return plain(out.select("fill_id", "position_before", "position"))


@query("stage_latency", ["fx_signal", "fx_risk", "fx_request", "fx_trade"], f"""
, line AS (
  SELECT s.ts AS t0, d.ts AS t1, r.ts AS t2, f.ts AS t3 FROM fx_signal s LEFT JOIN fx_risk d ON d.signal_id = s.signal_id
  LEFT JOIN fx_request r ON r.risk_decision_id = d.decision_id LEFT JOIN (SELECT client_order_id, min(ts) AS ts FROM fx_trade GROUP BY 1) f ON f.client_order_id = r.client_order_id),
lags AS (SELECT 'signal_to_decision' AS stage, epoch_us(t1) - epoch_us(t0) AS lag FROM line UNION ALL SELECT 'decision_to_request', epoch_us(t2) - epoch_us(t1) FROM line
  UNION ALL SELECT 'request_to_fill', epoch_us(t3) - epoch_us(t2) FROM line UNION ALL SELECT 'signal_to_fill', epoch_us(t3) - epoch_us(t0) FROM line)
SELECT stage, count(*) AS n, {d('quantile_cont(lag, 0.5)', 'p50')}, {d('quantile_cont(lag, 0.95)', 'p95')}, {d('quantile_cont(lag, 0.99)', 'p99')}
FROM lags WHERE lag IS NOT NULL GROUP BY 1""")
def _(v):
    return plain(orders.stage_latency(joins.signal_lineage(v("fx_signal"), v("fx_risk"), v("fx_request"), v("fx_trade"))))


@query("stale_orders", ["fx_signal", "fx_snapshot", "fx_policy", "fx_request"], _DEADLINES + """
SELECT r.request_id, r.client_order_id FROM fx_request r LEFT JOIN deadlines x ON x.signal_id = r.signal_id
WHERE r.time_in_force = 'gtc' AND NOT coalesce(x.deadline > TIMESTAMP '2024-01-20 00:00:00', FALSE)""")
def _(v):
    working = v("fx_request").withColumn("state", F.when(F.col("time_in_force") == "gtc", "accepted").otherwise("canceled"))
    return plain(orders.stale_orders(working, deadlines(v), "2024-01-20 00:00:00").select("request_id", "client_order_id"))


@query("trailing_stop_path", ["fx_trade", "fx_snapshot"], f"""
, path AS (
  SELECT t.fill_id, t.side, t.price AS p0, s.ts, CAST(s.last AS DOUBLE) AS p,
         CASE WHEN t.side = 'buy' THEN greatest(CAST(t.price AS DOUBLE), max(CAST(s.last AS DOUBLE)) OVER w) ELSE least(CAST(t.price AS DOUBLE), min(CAST(s.last AS DOUBLE)) OVER w) END AS x
  FROM fx_trade t LEFT JOIN fx_snapshot s ON s.instrument = t.instrument AND s.ts > t.ts AND s.ts <= t.ts + INTERVAL '200' HOUR AND s.ts <= TIMESTAMP '2024-01-25 00:00:00'
  WINDOW w AS (PARTITION BY t.fill_id ORDER BY s.ts, s.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT fill_id, min(ts) AS hit_at FROM path WHERE CASE WHEN side = 'buy' THEN p <= (1 - 0.3) * x ELSE p >= (1 + 0.3) * x END GROUP BY 1)
SELECT a.fill_id AS entry_id, h.hit_at,
       {d("CASE WHEN any_value(a.side) = 'buy' THEN max(coalesce(a.x, CAST(a.p0 AS DOUBLE))) ELSE min(coalesce(a.x, CAST(a.p0 AS DOUBLE))) END", 'extreme')}
FROM path a LEFT JOIN hits h ON h.fill_id = a.fill_id WHERE h.hit_at IS NULL OR a.ts <= h.hit_at GROUP BY a.fill_id, h.hit_at""")
def _(v):
    entries = v("fx_trade").select(
        F.col("fill_id").alias("entry_id"), "instrument", F.when(F.col("side") == "buy", "long").otherwise("short").alias("direction"), "ts", "price",
        (F.col("ts") + F.expr("INTERVAL 200 HOUR")).alias("closed_at"),
    )
    out = orders.trailing_stop_path(entries, v("fx_snapshot"), 0.3, "2024-01-25 00:00:00")
    return plain(out.select("entry_id", "extreme", "hit_at"))


# Portfolio

@query("position_path", ["fx_fill_once"], f"""
SELECT fill_id, {d(f"sum({_SIGNED}) OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 'position')} FROM fx_fill_once""")
def _(v):
    return plain(portfolio.position_path(v.ledger(*LEDGER), order=("ts", "recv_seq", "fill_id"), width=W).select("fill_id", "position"))


@query("positions", ["fx_fill_once"], f"SELECT account, instrument, {d(f'sum({_SIGNED})', 'qty')} FROM fx_fill_once WHERE ts <= TIMESTAMP '1998-06-30' GROUP BY 1, 2")
def _(v):
    return plain(portfolio.positions(v("fx_fill_once"), "1998-06-30"))


@query("pnl_mark_to_market", ["fx_fill_once", "fx_mark_latest"], f"""
SELECT account, f.instrument, {d('any_value(qty)', 'qty')}, {d('any_value(cash) - any_value(fees) + any_value(qty) * any_value(m.price)', 'pnl', 2)} FROM (
  SELECT account, instrument, sum({_SIGNED}) AS qty, sum({_CASH}) AS cash, sum(fee) AS fees FROM fx_fill_once GROUP BY 1, 2) f
LEFT JOIN fx_mark_latest m ON m.instrument = f.instrument GROUP BY 1, 2""")
def _(v):
    return plain(portfolio.pnl_mark_to_market(v("fx_fill_once"), v("fx_mark_latest")).select("account", "instrument", "qty", "pnl"), pnl=2)


@query("pnl_fifo_realized", ["fx_fill_once"], f"""
, lots AS (SELECT account, instrument, side, CAST(price AS DECIMAL(38,8)) AS price, CAST(qty AS DECIMAL(38,8)) AS qty,
                  sum(CAST(qty AS DECIMAL(38,8))) OVER (PARTITION BY account, instrument, side ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM fx_fill_once)
SELECT k.account, k.instrument, {d('coalesce(sum(m.gain), 0)', 'realized', 2)}, {d('coalesce(sum(m.q), 0)', 'matched_qty')}
FROM (SELECT DISTINCT account, instrument FROM lots) k LEFT JOIN (
  SELECT b.account, b.instrument, least(b.upto, s.upto) - greatest(b.upto - b.qty, s.upto - s.qty) AS q,
         CAST((s.price - b.price) * (least(b.upto, s.upto) - greatest(b.upto - b.qty, s.upto - s.qty)) AS DOUBLE) AS gain
  FROM lots b JOIN lots s ON b.side = 'buy' AND s.side = 'sell' AND b.account = s.account AND b.instrument = s.instrument
   AND least(b.upto, s.upto) > greatest(b.upto - b.qty, s.upto - s.qty)) m ON m.account = k.account AND m.instrument = k.instrument GROUP BY 1, 2""")
def _(v):
    out = portfolio.pnl_fifo_realized(v.ledger(*LEDGER, "price"), order=("ts", "recv_seq", "fill_id"), width="180 days", span=5000)
    return plain(out, realized=2)


@query("equity_curve", ["fx_fill_once"], f"""
, daily AS (SELECT account, instrument, CAST(ts AS DATE) AS day, sum({_SIGNED}) AS q, sum({_CASH} - fee) AS c FROM fx_fill_once GROUP BY ALL),
book AS (SELECT account, instrument, day, sum(q) OVER w AS q, sum(c) OVER w AS c FROM daily WINDOW w AS (PARTITION BY account, instrument ORDER BY day ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT instrument, CAST(ts AS DATE) AS day, arg_max(price, (ts, fill_id)) AS mark FROM fx_fill_once GROUP BY ALL),
cal AS (SELECT b.account, b.instrument, CAST(unnest(generate_series(min(b.day), DATE '2001-12-31', INTERVAL '1' DAY)) AS DATE) AS day FROM book b WHERE day <= DATE '2001-12-31' GROUP BY 1, 2),
held AS (SELECT c.*, b.q, b.c FROM cal c ASOF JOIN book b ON c.account = b.account AND c.instrument = b.instrument AND c.day >= b.day),
valued AS (SELECT h.*, m.mark FROM held h ASOF LEFT JOIN marks m ON h.instrument = m.instrument AND h.day >= m.day)
SELECT account, strftime(day, '%Y-%m-%d') AS day, {d('1000000 + sum(c + q * mark)', 'equity', 2)} FROM valued GROUP BY 1, 2""")
def _(v):
    once = v.ledger(*LEDGER, "price", "fee")
    marks = once.select("instrument", "ts", F.col("fill_id").alias("seq"), "price")
    out = portfolio.equity_curve(once, marks, 1_000_000, "2001-12-31")
    return plain(out.withColumn("day", F.col("day").cast("string")), equity=2)


_PATH = f"""
, path AS (SELECT *, sum({_SIGNED}) OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM fx_fill_once)"""


@query("position_episodes", ["fx_fill_once"], _PATH + f"""
, numbered AS (SELECT *, coalesce(sum(CASE WHEN position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account, instrument ORDER BY ts, recv_seq, fill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM path)
SELECT account, instrument, {n('episode', 'episode')}, min(ts) AS opened, CASE WHEN bool_or(position = 0) THEN max(ts) END AS closed, {d('max(abs(position))', 'max_qty')},
       {d(f'CASE WHEN bool_or(position = 0) THEN sum({_CASH} - fee) END', 'pnl', 2)}, count(*) AS fills FROM numbered GROUP BY 1, 2, 3""")
def _(v):
    order = ("ts", "recv_seq", "fill_id")
    path = portfolio.position_path(v.ledger(*LEDGER, "price", "fee"), order=order, width=W)
    return plain(portfolio.position_episodes(path, order=order, width=W), pnl=2)


@query("rebuild_parity", ["fx_fill", "fx_fill_once"], f"""
, once AS (SELECT account, instrument, sum({_SIGNED}) AS qty FROM fx_fill_once GROUP BY 1, 2),
twice AS (SELECT account, instrument, sum(q) AS qty FROM (
  SELECT account, instrument, {_SIGNED} AS q FROM fx_fill_once WHERE ts <= TIMESTAMP '1998-06-30' UNION ALL SELECT account, instrument, {_SIGNED} FROM fx_fill WHERE ts > TIMESTAMP '1998-06-30') z GROUP BY 1, 2)
SELECT 'full' AS side, account, instrument, {d('qty', 'qty')} FROM (SELECT * FROM once EXCEPT ALL SELECT * FROM twice) a
UNION ALL SELECT 'rebuilt', account, instrument, {d('qty', 'qty')} FROM (SELECT * FROM twice EXCEPT ALL SELECT * FROM once) b""")
def _(v):
    # The tail was not deduplicated: the audit shows every position that was counted twice.
    once = v.ledger("account", "instrument", "ts", "side", "qty")
    return plain(portfolio.rebuild_parity(once, portfolio.positions(once, "1998-06-30"), v("fx_fill").where("ts > timestamp'1998-06-30'")))


# Risk

def sizing_inputs(v: Inputs):
    k, value = F.col("k"), F.col("value")
    return v("fx_signal").select(
        "signal_id", F.col("px").alias("entry"), F.col("invalidation_level").alias("stop"), F.when(k != 13, k * 10).cast("decimal(18,8)").alias("risk_budget"),
        F.lit(5000).cast("decimal(18,8)").alias("max_notional"), (k * 1000).cast("decimal(18,8)").alias("liquidity"), F.lit(0.1).cast("decimal(18,8)").alias("liquidity_fraction"),
        F.when(value > 5, 10000 + k).cast("decimal(18,8)").alias("equity"), (1 + F.col("event_id") % 5).cast("decimal(18,8)").alias("limit"),
    )


@query("size_positions", ["fx_signal"], f"""
SELECT signal_id, {d('q', 'quantity', 4)}, {d('q * entry', 'notional', 3)}, {d('coalesce(round(q * entry / equity, 8), 0)', 'leverage', 4)} FROM (
  SELECT *, CASE WHEN budget > 0 AND equity > 0 AND k > 0 THEN {_FLOOR8.format('least(budget / 20.0, 5000 / entry, k * 100 / entry, lim * equity / entry)')} ELSE 0 END AS q FROM (
    SELECT signal_id, k, CAST(px AS DOUBLE) AS entry, CASE WHEN k <> 13 THEN k * 10 END AS budget, CASE WHEN value > 5 THEN 10000 + k END AS equity, 1 + event_id % 5 AS lim FROM fx_signal) a) b""")
def _(v):
    out = risk.size_positions(sizing_inputs(v)).select("signal_id", "quantity", "notional", "leverage")
    return plain(out, quantity=4, notional=3, leverage=4)


def valued_positions(v: Inputs):
    """Positions at their marks. The one instrument without a mark is taken at 1,000, but for two accounts, where its value stays unknown."""
    marks = v("fx_mark_latest").select("instrument", F.col("price").alias("mark"))
    joined = v("fx_position").join(marks, "instrument", "left")
    mark = F.coalesce("mark", F.when(~F.col("account").isin("acct-3", "acct-9"), F.lit(1000))).cast("decimal(18,8)")
    return joined.withColumn("notional", (F.col("qty").cast("decimal(19,8)") * mark).cast("decimal(38,16)"))


_MARKED = "coalesce(m.price, CASE WHEN p.account NOT IN ('acct-3', 'acct-9') THEN 1000 END)"
_VALUED = f", valued AS (SELECT p.account, p.strategy_id, p.instrument, CAST(p.qty AS DECIMAL(38,8)) * CAST({_MARKED} AS DECIMAL(18,8)) AS notional FROM fx_position p LEFT JOIN fx_mark_latest m ON m.instrument = p.instrument)"


@query("exposure", ["fx_position", "fx_mark_latest"], _VALUED + f"""
SELECT account, strategy_id, instrument, {d('CASE WHEN count(notional) = count(*) THEN sum(abs(notional)) END', 'gross', 3)}, {d('CASE WHEN count(notional) = count(*) THEN sum(notional) END', 'net', 3)},
       count(*) - count(notional) AS unknown, {n('grouping_id(account, strategy_id, instrument)', '"grouping"')}
FROM valued GROUP BY ROLLUP (account, strategy_id, instrument)""")
def _(v):
    return plain(risk.exposure(valued_positions(v), ["account", "strategy_id", "instrument"]), 3)


@query("account_leverage", ["fx_position", "fx_mark_latest", "fx_policy"], _VALUED + f"""
, gross AS (SELECT account, CASE WHEN count(notional) = count(*) THEN sum(abs(notional)) END AS gross FROM valued GROUP BY 1)
SELECT account, {d('lev', 'leverage')}, NOT coalesce(value IS NOT NULL AND lev <= least(value, 20), FALSE) AS breach FROM (
  SELECT g.account, CASE WHEN g.account NOT IN ('acct-4', 'acct-5') THEN CAST(g.gross AS DOUBLE) / 1000000 END AS lev, CAST(l.value AS DOUBLE) AS value
  FROM gross g LEFT JOIN fx_policy l ON l.scope = 'account' AND l.name = 'max_leverage' AND l.key = g.account AND l.key <> 'acct-7') z""")
def _(v):
    gross = risk.exposure(valued_positions(v), ["account"]).where("`grouping` = 0").select("account", "gross")
    equity = v("fx_position").select("account").distinct().where("account not in ('acct-4', 'acct-5')").withColumn("equity", F.lit(1_000_000))
    limits = v("fx_policy").where("scope = 'account' and name = 'max_leverage' and key <> 'acct-7'").select(F.col("key").alias("account"), F.col("value").alias("max_leverage"))
    return plain(risk.account_leverage(gross, equity, limits).select("account", "leverage", "breach"))


_DD = """, walked AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM fx_equity),
fallen AS (SELECT *, CAST(equity AS DOUBLE) / CAST(peak AS DOUBLE) - 1 AS dd FROM walked)"""


@query("drawdown", ["fx_equity"], _DD + f" SELECT account, seq, {d('peak', 'peak')}, {d('dd', 'drawdown')}, NOT (dd >= -0.9) AS breach FROM fallen")
def _(v):
    return plain(risk.drawdown(v("fx_equity"), ["account"], 0.9).select("account", "seq", "peak", "drawdown", "breach"))


@query("max_drawdown", ["fx_equity"], _DD + f" SELECT account, {d('min(dd)', 'max_drawdown')}, bool_or(NOT (dd >= -0.9)) AS breach FROM fallen GROUP BY 1")
def _(v):
    return plain(risk.max_drawdown(risk.drawdown(v("fx_equity"), ["account"], 0.9), ["account"]))


@query("daily_loss", ["fx_equity"], f"""
SELECT account, strftime(ts, '%Y-%m-%d') AS day, {d('sum(pnl)', 'pnl', 3)}, sum(pnl) < -150000 AS breach FROM fx_equity GROUP BY 1, 2""")
def _(v):
    out = risk.daily_loss(v("fx_equity"), ["account"], 150_000)
    return plain(out.withColumn("day", F.col("day").cast("string")), 3)


def daily_returns(v: Inputs):
    """Daily closes per instrument and their returns: one row per instrument and day."""
    bars = features.bars(v("fx_snapshot"), "1 day")
    w = Window.partitionBy("instrument").orderBy("window_start")
    past = F.lag("close").over(w).cast("double")
    return bars.select("instrument", F.col("window_start").alias("ts"), (F.col("close").cast("double") / past - 1).alias("ret"))


@query("return_correlation", ["fx_snapshot"], f"""
, closes AS (SELECT instrument, time_bucket(INTERVAL '1 day', ts) AS day, CAST(arg_max(last, (ts, seq)) AS DOUBLE) AS px FROM fx_snapshot GROUP BY 1, 2),
rets AS (SELECT instrument, day, px / lag(px) OVER (PARTITION BY instrument ORDER BY day) - 1 AS r FROM closes),
pairs AS (SELECT a.instrument AS a, b.instrument AS b, corr(a.r, b.r) AS c, count(*) AS n FROM rets a JOIN rets b ON a.day = b.day AND a.instrument < b.instrument
          WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)
SELECT a, b, {d('c', 'corr')}, n FROM pairs WHERE n >= 5""")
def _(v):
    return plain(risk.return_correlation(daily_returns(v), min_bars=5, blocks=4))


@query("high_correlations", ["fx_snapshot", "fx_listing"], f"""
, closes AS (SELECT instrument, time_bucket(INTERVAL '1 day', ts) AS day, CAST(arg_max(last, (ts, seq)) AS DOUBLE) AS px FROM fx_snapshot GROUP BY 1, 2),
rets AS (SELECT instrument, day, px / lag(px) OVER (PARTITION BY instrument ORDER BY day) - 1 AS r FROM closes),
listed AS (SELECT DISTINCT instrument FROM fx_listing WHERE kind = 'list'),
pairs AS (SELECT a.instrument AS a, b.instrument AS b, corr(a.r, b.r) AS c, count(*) AS n FROM rets a JOIN rets b ON a.day = b.day AND a.instrument < b.instrument
          WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.instrument IN (SELECT instrument FROM listed) AND b.instrument IN (SELECT instrument FROM listed) GROUP BY 1, 2)
SELECT a, b, {d('c', 'corr')}, n FROM pairs WHERE n >= 5 AND abs(c) >= 0.8""")
def _(v):
    listed = v("fx_listing").where("kind = 'list'").select("instrument")
    return plain(risk.return_correlation(daily_returns(v), min_bars=5, universe=listed, threshold=0.8, block_size=50))


@query("concentration", ["fx_position", "fx_mark_latest"], _VALUED + f"""
, per AS (SELECT account, instrument, CASE WHEN count(notional) = count(*) THEN sum(abs(notional)) END AS g FROM valued GROUP BY 1, 2),
tot AS (SELECT account, CAST(sum(g) AS DOUBLE) AS t, CAST(max(g) AS DOUBLE) AS m, sum(CAST(g AS DOUBLE) * CAST(g AS DOUBLE)) AS q FROM per GROUP BY 1 HAVING count(g) = count(*)
        UNION ALL SELECT account, NULL, NULL, NULL FROM per GROUP BY 1 HAVING count(g) < count(*))
SELECT p.account, p.instrument, {d('CAST(p.g AS DOUBLE) / t', 'share')}, {d('m / t', 'largest')}, {d('q / (t * t)', 'hhi')} FROM per p JOIN tot x ON x.account = p.account""")
def _(v):
    return plain(risk.concentration(valued_positions(v), ["account"]))


@query("liquidity_cap", ["fx_risk"], f"""
SELECT decision_id, {d('notional', 'notional')} FROM fx_risk WHERE NOT coalesce(abs(notional) <= CASE WHEN k > 3 THEN k * 100 END * 0.25, FALSE)""")
def _(v):
    df = v("fx_risk").withColumn("liquidity", F.when(F.col("k") > 3, F.col("k") * 100).cast("decimal(20,8)"))
    return plain(risk.liquidity_cap(df, 0.25).select("decision_id", "notional"))


@query("budget_ledger", ["fx_budget_event", "fx_budget"], f"""
SELECT event_id, {d('balance', 'balance', 3)}, NOT coalesce(balance <= coalesce(b.budget, 0), FALSE) AS "over" FROM (
  SELECT *, CASE WHEN bool_or(seq % 6007 = 33) OVER w THEN NULL ELSE sum(CASE WHEN kind = 'release' THEN -amount ELSE amount END) OVER w END AS balance
  FROM fx_budget_event WINDOW w AS (PARTITION BY account ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) e LEFT JOIN fx_budget b ON b.account = e.account AND b.account <> 'acct-2'""")
def _(v):
    # A few events are of a kind nobody knows.
    events = v("fx_budget_event").withColumn("kind", F.when(F.col("seq") % 6007 == 33, "transfer").otherwise(F.col("kind")))
    out = risk.budget_ledger(quality.first_of(events, ["event_id"], ["ts", "seq"]), ["account"], v("fx_budget").where("account <> 'acct-2'"))
    return plain(out.select("event_id", "balance", "over"), 3)


@query("admit_by_budget", ["fx_budget_request", "fx_budget"], f"""
, steps AS (SELECT r.*, row_number() OVER (PARTITION BY r.account ORDER BY ts, seq) AS rn, coalesce(b.budget, 0) AS budget FROM fx_budget_request r LEFT JOIN fx_budget b ON b.account = r.account),
fold AS (
  SELECT account, rn, request_id, amount <= budget AS admitted, budget - CASE WHEN amount <= budget THEN amount ELSE 0 END AS remaining FROM steps WHERE rn = 1
  UNION ALL
  SELECT s.account, s.rn, s.request_id, s.amount <= f.remaining, f.remaining - CASE WHEN s.amount <= f.remaining THEN s.amount ELSE 0 END
  FROM fold f JOIN steps s ON s.account = f.account AND s.rn = f.rn + 1)
SELECT request_id, admitted, {d('remaining', 'remaining', 3)} FROM fold""")
def _(v):
    budgets = v("fx_budget")
    out = risk.admit_by_budget(v("fx_budget_request"), budgets)
    left = risk.remaining_budget(out, budgets)
    return plain(left.select("request_id", "admitted", "remaining"), 3)


def gate_accounts(v: Inputs):
    """Account facts the gate and the sizing need, one row per account."""
    c, nat = F.col("c_custkey"), F.col("c_nationkey")
    return v("customer").select(
        F.concat(F.lit("acct-"), c.cast("string")).alias("account"), (nat != 3).alias("account_known"), (nat != 4).alias("risk_available"), (nat != 5).alias("reconciled"),
        F.lit(150.0).alias("max_spread_bps"), nat.alias("slippage_bps"), F.lit(20).alias("max_slippage_bps"), F.lit(0).alias("daily_pnl"), F.lit(100).alias("max_daily_loss"),
        F.lit(-0.05).alias("drawdown"), F.lit(0.2).alias("max_drawdown"), (nat == 6).alias("kill_switch"), F.lit("READY").alias("state"), F.lit(86_400_000_000 * 3).alias("max_age_us"),
        (nat * 1000).cast("decimal(18,8)").alias("equity"), F.lit(200).cast("decimal(18,8)").alias("risk_budget"), F.lit(4000).cast("decimal(18,8)").alias("max_notional"),
        F.lit(0.5).cast("decimal(18,8)").alias("liquidity_fraction"), (nat * 250).cast("decimal(18,8)").alias("open_exposure"), F.when(nat != 7, F.lit(6000).cast("decimal(18,8)")).alias("max_exposure"),
    )


_GATE = f"""
, facts AS (
  SELECT g.signal_id, g.strategy_id, g.direction, 'acct-' || CAST(g.user_id AS VARCHAR) AS account, g.instrument, g.invalidation_level AS stop, {_MID} AS mid,
         CAST(s.ask - s.bid AS DOUBLE) / ({_MID}) * 10000 AS spread, s.quality, s.liquidity, epoch_us(g.ts) - epoch_us(s.ts) AS age
  FROM fx_signal g ASOF LEFT JOIN fx_snapshot s ON g.instrument = s.instrument AND g.ts >= s.ts),
checked AS (
  SELECT f.*, c.c_nationkey AS nat, c.c_nationkey * 1000 AS equity, least(20, a.value, i.value, t.value) AS lim, {unmet({
    'data_quality': "quality IN ('live', 'delayed')", 'data_stale': 'CASE WHEN c.c_custkey IS NOT NULL THEN age <= 259200000000 END', 'account_unknown': 'c.c_nationkey <> 3',
    'risk_unavailable': 'c.c_nationkey <> 4', 'not_reconciled': 'c.c_nationkey <> 5', 'spread': 'CASE WHEN c.c_custkey IS NOT NULL THEN spread <= 150 END', 'slippage': 'c.c_nationkey <= 20',
    'daily_loss': 'c.c_custkey IS NOT NULL', 'drawdown': 'c.c_custkey IS NOT NULL', 'kill_switch': 'c.c_nationkey <> 6', 'state_not_ready': 'c.c_custkey IS NOT NULL'})} AS r0
  FROM facts f LEFT JOIN customer c ON 'acct-' || CAST(c.c_custkey AS VARCHAR) = f.account
  LEFT JOIN fx_policy a ON a.scope = 'account' AND a.name = 'max_leverage' AND a.key = f.account
  LEFT JOIN fx_policy i ON i.scope = 'instrument' AND i.name = 'max_leverage' AND i.key = f.instrument
  LEFT JOIN fx_policy t ON t.scope = 'strategy' AND t.name = 'max_leverage' AND t.key = f.strategy_id),
sized AS (
  SELECT *, CASE WHEN mid > 0 AND equity > 0 AND liquidity > 0 AND abs(mid - CAST(stop AS DOUBLE)) > 0
                 THEN {_FLOOR8.format('least(200 / abs(mid - CAST(stop AS DOUBLE)), 4000 / mid, 0.5 * CAST(liquidity AS DOUBLE) / mid, CAST(lim AS DOUBLE) * equity / mid)')} ELSE 0 END AS q FROM checked),
decided AS (SELECT *, concat_ws(',', nullif(r0, ''), CASE WHEN q <= 0 THEN 'size_zero' END, nullif({unmet({
    'exposure_limit': 'CASE WHEN nat <> 7 THEN nat * 250 + coalesce(q * mid, 0) <= 6000 END', 'leverage_limit': 'lim IS NOT NULL',
    'stop_missing': "CASE WHEN direction = 'long' THEN CAST(stop AS DOUBLE) < mid ELSE CAST(stop AS DOUBLE) > mid END"})}, '')) AS reasons FROM sized)"""


def decisions(v: Inputs):
    sig = v("fx_signal").withColumn("account", F.concat(F.lit("acct-"), F.col("user_id").cast("string")))
    limits = v("fx_policy").where("name = 'max_leverage'")
    return risk.risk_gate(sig, v("fx_snapshot"), gate_accounts(v), limits)


GATE_SQL = _GATE + f"""
SELECT signal_id, reasons = '' AS approved, reasons AS reason_codes, {d("CASE WHEN reasons = '' THEN q ELSE 0 END", 'quantity', 4)},
       {d("CASE WHEN reasons = '' THEN q * mid ELSE 0 END", 'notional', 2)}, {d('lim', 'max_leverage')} FROM decided"""


@query("risk_gate", ["fx_signal", "fx_snapshot", "fx_policy"], GATE_SQL)
def _(v):
    out = decisions(v).select("signal_id", "approved", "reason_codes", "quantity", "notional", "max_leverage")
    return plain(out, quantity=4, notional=2)


@query("decision_summary", ["fx_signal", "fx_snapshot", "fx_policy"], _GATE + """
SELECT strategy_id, reason, count(*) AS n FROM (
  SELECT strategy_id, unnest(CASE WHEN reasons = '' THEN ['approved'] ELSE string_split(reasons, ',') END) AS reason FROM decided) z GROUP BY 1, 2""")
def _(v):
    return plain(risk.decision_summary(decisions(v)))


@query("decision_pivot", ["fx_risk"], """
SELECT strategy_id, count(*) FILTER (approved) AS approved, count(*) FILTER (NOT approved) AS rejected FROM fx_risk GROUP BY 1""")
def _(v):
    return plain(risk.decision_pivot(v("fx_risk")))


@query("funding_and_fees", ["fx_fill_once", "fx_funding"], f"""
, due AS (SELECT f.account, f.instrument, sum({_SIGNED} * r.rate) AS funding FROM fx_fill_once f JOIN fx_funding r ON r.instrument = f.instrument AND r.ts >= f.ts GROUP BY 1, 2),
fees AS (SELECT account, instrument, sum(fee) AS fees FROM fx_fill_once GROUP BY 1, 2)
SELECT e.account, e.instrument, {d('coalesce(d.funding, 0)', 'funding')}, {d('e.fees', 'fees')} FROM fees e LEFT JOIN due d ON d.account = e.account AND d.instrument = e.instrument""")
def _(v):
    return plain(risk.funding_and_fees(v.ledger(), v("fx_funding")))
