"""Market tables derived from the general test tables.

Each view is one SELECT in the dialect that Spark and DuckDB share, so the same text feeds the Spark
queries and the SQL they are checked against. ``{name}`` stands for another view or a test table.
Violations are planted through the values of ``k`` (0..99, from ``props``) and ``value``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PX = "CAST(100 + value AS DECIMAL(18,8))"

VIEWS: dict[str, str] = {
    "fx_base": f"""
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'INST-' || CAST(user_id AS STRING) AS instrument,
               user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               {_PX} AS px
        FROM {{events}}""",
    "fx_raw": """
        SELECT 'venue-a' AS venue, CASE WHEN event_type IN ('view', 'click') THEN 'book' ELSE 'trade' END AS channel,
               instrument, event_id AS seq, event_type, ts AS event_ts,
               ts + k * INTERVAL '1' SECOND AS receipt_ts, ts + (k + 1) * INTERVAL '1' SECOND AS persisted_ts,
               CASE WHEN event_type = 'error' THEN 'broken ' || CAST(k AS STRING)
                    ELSE '{"bid":"' || CAST(px AS STRING) || '","ask":"'
                         || CASE WHEN k < 5 THEN 'n/a' ELSE CAST(CAST(px + 1 AS DECIMAL(18,8)) AS STRING) END
                         || '","last":"' || CAST(px AS STRING) || '","volume":"' || CAST(k AS STRING) || '"}' END AS payload,
               CASE WHEN k >= 95 THEN 2 ELSE 1 END AS schema_version, 1 AS dataset_version
        FROM {fx_base}""",
    "fx_delivered": """
        SELECT * FROM {fx_raw}
        UNION ALL
        SELECT venue, channel, instrument, seq, event_type, event_ts, receipt_ts + INTERVAL '30' SECOND AS receipt_ts,
               persisted_ts + INTERVAL '30' SECOND AS persisted_ts,
               CASE WHEN schema_version = 2 THEN payload || ' ' ELSE payload END AS payload,
               schema_version, dataset_version
        FROM {fx_raw} WHERE event_type = 'click'""",
    "fx_snapshot": """
        SELECT instrument, ts, event_id AS seq,
               CAST(px - CAST((k - 5) / 100.0 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS bid,
               CAST(px + CAST((k - 5) / 100.0 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS ask,
               px AS last, CAST(k * 10 AS DECIMAL(18,8)) AS volume,
               CASE WHEN k < 50 THEN CAST(k * 0.001 AS DECIMAL(18,8)) END AS volatility,
               CAST(k * 1000 AS DECIMAL(38,16)) AS liquidity, 'feed-' || event_type AS source,
               CASE WHEN k < 85 THEN 'live' WHEN k < 90 THEN 'delayed' WHEN k < 95 THEN 'stale'
                    WHEN k < 99 THEN 'invalid' ELSE 'LIVE' END AS quality,
               ts + k * INTERVAL '1' SECOND AS receipt_ts
        FROM {fx_base} WHERE event_type IN ('view', 'click')""",
    "fx_signal": """
        SELECT 'sig-' || CAST(event_id AS STRING) AS signal_id, instrument,
               CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, ts,
               'strat-' || CAST(event_id % 3 AS STRING) AS strategy_id,
               CAST(px - CAST((k - 5) * 0.5 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS zone_low,
               CAST(px + CAST((k - 5) * 0.5 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS zone_high,
               CAST(CASE WHEN event_id % 2 = 0 THEN px - 20 ELSE px + 20 END AS DECIMAL(18,8)) AS invalidation_level,
               CAST(k * 0.001 AS DECIMAL(18,8)) AS expected_move,
               CAST(k AS BIGINT) * 3600000000 AS horizon_us, CAST(k * 0.0105 AS DECIMAL(18,8)) AS confidence,
               'cfg-' || CAST(event_id % 3 AS STRING) || CASE WHEN value > 250 THEN '-hotfix' ELSE '' END AS config,
               px, k, event_id, user_id, value
        FROM {fx_base} WHERE event_type = 'purchase'""",
    "fx_risk": """
        SELECT 'dec-' || CAST(event_id AS STRING) AS decision_id, signal_id, instrument,
               ts + k * INTERVAL '1' SECOND AS ts, k < 80 AS approved,
               CASE WHEN k < 80 THEN 'ok' WHEN k < 90 THEN 'stale_data' ELSE 'daily_loss' END AS reason,
               CAST(CASE WHEN k < 80 THEN 1 + event_id % 10 WHEN k > 97 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS quantity,
               CAST(CASE WHEN k < 80 THEN CAST((1 + event_id % 10) * px AS DECIMAL(18,8)) ELSE 0 END AS DECIMAL(38,16)) AS notional,
               CAST(1 + event_id % 25 AS DECIMAL(18,8)) AS leverage, CAST(2 + user_id % 24 AS DECIMAL(18,8)) AS max_leverage,
               CAST(k AS DECIMAL(18,8)) AS risk_budget, CAST(px - 20 AS DECIMAL(18,8)) AS stop_price,
               'acct-' || CAST(user_id % 10 AS STRING) AS account, strategy_id, k, value, event_id, direction, px
        FROM {fx_signal} WHERE value >= 3""",
    "fx_request": """
        SELECT 'req-' || CAST(event_id AS STRING) AS request_id, decision_id AS risk_decision_id, instrument,
               ts + k * INTERVAL '10' SECOND AS ts,
               CASE WHEN (direction = 'long') = (value <= 200) THEN 'buy' ELSE 'sell' END AS side,
               CAST(quantity + CASE WHEN k < 5 THEN 1 ELSE 0 END AS DECIMAL(18,8)) AS quantity,
               CASE WHEN event_id % 2 = 0 THEN 'limit' ELSE 'market' END AS order_type,
               CASE WHEN event_id % 2 = 0 AND k < 75 THEN px END AS limit_price, k >= 60 AS reduce_only,
               'cid-' || CAST(event_id AS STRING) AS client_order_id,
               CASE WHEN k < 40 THEN 'gtc' WHEN k < 70 THEN 'ioc' WHEN k < 84 THEN 'fok' ELSE 'day' END AS time_in_force,
               account, strategy_id, signal_id, k, value, event_id, px
        FROM {fx_risk} WHERE k < 85
        UNION ALL
        SELECT 'req-' || CAST(event_id AS STRING) || '-again', decision_id, instrument, ts + (k + 6) * INTERVAL '10' SECOND,
               CASE WHEN (direction = 'long') = (value <= 200) THEN 'buy' ELSE 'sell' END, quantity, 'market', NULL,
               FALSE, 'cid-' || CAST(event_id AS STRING), 'gtc', account, strategy_id, signal_id, k, value, event_id, px
        FROM {fx_risk} WHERE k BETWEEN 20 AND 24""",
    "fx_trade": """
        SELECT 'venue-a' AS venue, 'f-' || CAST(event_id AS STRING) AS fill_id, client_order_id, account, strategy_id,
               instrument, side, CAST(quantity * CASE WHEN k < 30 THEN 0.5 WHEN k < 34 THEN 2 ELSE 1 END AS DECIMAL(18,8)) AS qty,
               CAST(px + CAST((k - 50) / 100.0 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS price,
               CAST(k * 0.01 AS DECIMAL(18,8)) AS fee, k < 50 AS maker, ts + k * INTERVAL '1' SECOND AS ts,
               limit_price, event_id AS recv_seq, k, reduce_only
        FROM {fx_request} WHERE quantity > 0 AND request_id = 'req-' || CAST(event_id AS STRING)""",
    "fx_decision": """
        SELECT CAST(o_orderkey AS STRING) AS decision_id, 'sig-' || CAST(o_orderkey AS STRING) AS signal_id,
               'acct-' || CAST(o_custkey % 20 AS STRING) AS account, 'INST-' || CAST(o_custkey AS STRING) AS instrument,
               CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderstatus <> 'F' AS approved, o_orderpriority AS reason,
               CAST(1 AS DECIMAL(18,8)) AS quantity, CAST(o_totalprice AS DECIMAL(38,16)) AS notional,
               CAST(1 + o_orderkey % 25 AS DECIMAL(18,8)) AS leverage, CAST(2 + o_custkey % 24 AS DECIMAL(18,8)) AS max_leverage,
               CAST(100 AS DECIMAL(18,8)) AS risk_budget, CAST(NULL AS DECIMAL(18,8)) AS stop_price
        FROM {orders}""",
    "fx_fill": """
        SELECT 'venue-a' AS venue, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS fill_id,
               CAST(l_orderkey AS STRING) AS client_order_id, 'acct-' || CAST(o_custkey % 20 AS STRING) AS account,
               'strat-' || CAST(l_suppkey % 3 AS STRING) AS strategy_id, 'INST-' || CAST(l_partkey % 50 AS STRING) AS instrument,
               CASE WHEN l_returnflag = 'R' OR l_quantity > 35 THEN 'sell' ELSE 'buy' END AS side,
               CAST(l_quantity AS DECIMAL(18,8)) AS qty, CAST(l_extendedprice AS DECIMAL(18,8)) AS price,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.0005 AS DECIMAL(18,8)) AS fee, l_linestatus = 'O' AS maker,
               CAST(l_shipdate AS TIMESTAMP) AS ts, l_partkey * 1000000 + l_suppkey AS recv_seq, l_linestatus = 'F' AND l_tax > 0.06 AS reduce_only
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_fill_once": """
        SELECT venue, fill_id, client_order_id, account, strategy_id, instrument, side, qty, price, fee, maker, ts, recv_seq, reduce_only
        FROM (SELECT *, row_number() OVER (PARTITION BY venue, fill_id ORDER BY ts, recv_seq, price) AS rn FROM {fx_fill}) f
        WHERE rn = 1""",
    "fx_order_event": """
        SELECT client_order_id, instrument, account, strategy_id,
               CASE WHEN reduce_only THEN CASE WHEN maker THEN 'canceled' ELSE 'new' END
                    WHEN side = 'sell' THEN 'filled' WHEN maker THEN 'partially_filled' ELSE 'accepted' END AS state,
               qty, reduce_only, CAST(substring(fill_id, length(client_order_id) + 2) AS BIGINT) AS event_seq, ts AS event_ts,
               recv_seq, fill_id
        FROM {fx_fill_once}""",
    "fx_order": """
        SELECT CAST(o_orderkey AS STRING) AS client_order_id, CAST(o_orderkey AS STRING) AS decision_id,
               'acct-' || CAST(o_custkey % 20 AS STRING) AS account,
               CAST(60 + o_orderkey % 40 AS DECIMAL(18,8)) AS qty, CAST(50 + o_custkey % 60 AS DECIMAL(18,8)) AS approved_qty,
               CAST(o_orderdate AS TIMESTAMP) AS ts
        FROM {orders}""",
    "fx_state": """
        SELECT CASE WHEN event_type = 'error' THEN CASE WHEN k < 30 THEN 'DEGRADED' WHEN k < 60 THEN 'STARTING' ELSE 'HALTED' END
                    ELSE CASE WHEN k < 50 THEN 'RECONCILING' ELSE 'READY' END END AS state, ts AS from_ts, event_id AS seq
        FROM {fx_base} WHERE event_type IN ('error', 'signup')""",
    "fx_kill": """
        SELECT ts AS engaged_at, ts + k * INTERVAL '1' MINUTE AS released_at, event_id AS seq
        FROM {fx_base} WHERE event_type = 'error' AND value > 60""",
    "fx_listing": """
        SELECT instrument, ts, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'list' ELSE 'delist' END AS kind
        FROM {fx_base} WHERE event_type = 'signup' OR (event_type = 'error' AND value > 50)""",
    "fx_policy": """
        SELECT 'instrument' AS scope, 'INST-' || CAST(p_partkey AS STRING) AS key, 'max_age_us' AS name,
               CAST(p_size AS DECIMAL(38,8)) * 3600000000 AS value FROM {part} WHERE p_size < 40
        UNION ALL
        SELECT DISTINCT 'feed', 'feed-' || event_type, 'max_age_us', CAST(length(event_type) AS DECIMAL(38,8)) * 14400000000 FROM {fx_base}
        UNION ALL
        SELECT 'account', 'acct-' || CAST(c_custkey AS STRING), 'max_leverage', CAST(1 + c_nationkey AS DECIMAL(38,8)) FROM {customer}
        UNION ALL
        SELECT 'instrument', 'INST-' || CAST(p_partkey AS STRING), 'max_leverage', CAST(p_size AS DECIMAL(38,8)) FROM {part} WHERE p_size < 15
        UNION ALL
        SELECT 'strategy', 'strat-' || CAST(r_regionkey AS STRING), 'max_leverage', CAST(8 + r_regionkey AS DECIMAL(38,8)) FROM {region}""",
    "fx_equity": """
        SELECT 'acct-' || CAST(o_custkey % 20 AS STRING) AS account, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,16)) AS equity,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) - 250000 AS DECIMAL(38,16)) AS pnl
        FROM {orders}""",
    "fx_budget_event": """
        SELECT 'acct-' || CAST(o_custkey % 20 AS STRING) AS account, 'b-' || CAST(o_orderkey AS STRING) AS event_id,
               CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq,
               CASE o_orderstatus WHEN 'O' THEN 'reserve' WHEN 'P' THEN 'adjust' ELSE 'release' END AS kind,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) - CASE WHEN o_orderstatus = 'P' THEN 200000 ELSE 0 END AS DECIMAL(38,16)) AS amount
        FROM {orders}""",
    "fx_budget_request": """
        SELECT 'acct-' || CAST(o_custkey % 200 AS STRING) AS account, CAST(o_orderkey AS STRING) AS request_id,
               CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS seq, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(38,16)) AS amount
        FROM {orders}""",
    "fx_budget": """
        SELECT 'acct-' || CAST(c_custkey AS STRING) AS account, CAST(1000000 + c_nationkey * 100000 AS DECIMAL(38,16)) AS budget
        FROM {customer}""",
    "fx_venue_position": """
        SELECT account, instrument, CAST(CASE WHEN account = 'acct-3' AND instrument < 'INST-2' THEN qty + 1 ELSE qty END AS DECIMAL(38,8)) AS qty
        FROM (SELECT account, instrument, SUM(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty
              FROM {fx_fill_once} GROUP BY account, instrument) p
        WHERE NOT (account = 'acct-5' AND instrument = 'INST-7')
        UNION ALL
        SELECT 'acct-ext', 'INST-' || CAST(n_nationkey AS STRING), CAST(1 + n_nationkey AS DECIMAL(38,8)) FROM {nation}""",
    "fx_venue_order": """
        SELECT client_order_id, CASE WHEN CAST(client_order_id AS BIGINT) % 97 = 5 THEN CAST(qty + 1 AS DECIMAL(18,8)) ELSE qty END AS qty
        FROM {fx_order} WHERE CAST(client_order_id AS BIGINT) % 101 <> 7
        UNION ALL
        SELECT 'external-' || CAST(n_nationkey AS STRING), CAST(1 AS DECIMAL(18,8)) FROM {nation}""",
    "fx_venue_fill": """
        SELECT fill_id, qty, CASE WHEN recv_seq % 331 = 4 THEN CAST(price + 1 AS DECIMAL(18,8)) ELSE price END AS price
        FROM {fx_fill_once} WHERE recv_seq % 397 <> 11""",
    "fx_balance": """
        SELECT account, CAST(SUM(CASE WHEN side = 'buy' THEN -CAST(qty AS BIGINT) ELSE CAST(qty AS BIGINT) END * price) AS DECIMAL(38,8)) AS balance
        FROM {fx_fill_once} GROUP BY account""",
    "fx_venue_balance": """
        SELECT account, CAST(CASE WHEN account = 'acct-8' THEN balance + 3 ELSE balance END AS DECIMAL(38,8)) AS balance FROM {fx_balance} WHERE account <> 'acct-2'""",
    "fx_position": """
        SELECT account, strategy_id, instrument, SUM(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty
        FROM {fx_fill_once} GROUP BY account, strategy_id, instrument""",
    "fx_stop": """
        SELECT 'INST-' || CAST(p_partkey AS STRING) AS instrument, 'acct-' || CAST(p_size AS STRING) AS account,
               CAST(p_retailprice AS DECIMAL(18,8)) AS stop_price,
               CASE WHEN p_size < 30 THEN TIMESTAMP '2001-12-01 00:00:00' END AS acked_at
        FROM {part}""",
    "fx_mark": """
        SELECT instrument, ts, fill_id AS seq, price
        FROM {fx_fill_once}""",
    "fx_mark_latest": """
        SELECT 'INST-' || CAST(p_partkey AS STRING) AS instrument, CAST(p_retailprice AS DECIMAL(18,8)) AS price FROM {part}""",
    "fx_funding": """
        SELECT 'INST-' || CAST(o_custkey % 50 AS STRING) AS instrument, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8' HOUR AS ts,
               MAX(CAST((o_custkey % 7 - 3) * 0.0001 AS DECIMAL(18,8))) AS rate
        FROM {orders} GROUP BY 1, 2""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view (or plain test table) as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {dep: view(spark, sf_dir, dep) for dep in sorted(set(_NAME.findall(VIEWS[name])))}
    return spark.sql(VIEWS[name].replace('{"bid"', '{{"bid"').replace("'\"}'", "'\"}}'"), **inputs)


def cte(*names: str) -> str:
    """The ``WITH`` clause that defines the views, dependencies first, for the SQL side."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dep in sorted(set(_NAME.findall(VIEWS[name]))):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[n])})" for n in ordered)
