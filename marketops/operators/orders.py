"""Order state, fills, slippage and execution guards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.quantiles import exact_quantiles, join_groups
from marketops.functions.reasons import not_ok
from marketops.functions.timing import bucket, micros, us
from marketops.functions.windows import previous
from marketops.operators.features import mid_spread
from marketops.operators.joins import asof_join, bucket_search, node_range, range_max, search_at_or_below, sorted_keys
from marketops.operators.portfolio import BY, ORDER, position_path, signed_qty
from marketops.session import materialize

# Our own transition table: states an order may move to. Terminal states lead nowhere.
ALLOWED_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "new": ("accepted", "partially_filled", "filled", "canceled", "rejected"),
    "accepted": ("partially_filled", "filled", "canceled"),
    "partially_filled": ("partially_filled", "filled", "canceled"),
    "filled": (),
    "canceled": (),
    "rejected": (),
}
WORKING = ("new", "accepted", "partially_filled")


def order_state(events: DataFrame, order: Sequence[str] = ("event_seq",)) -> DataFrame:
    """Latest state per order."""
    return events.groupBy("client_order_id").agg(F.max_by("state", F.struct(*order)).alias("state"))


def transition_audit(events: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED_TRANSITIONS, order: Sequence[str] = ("event_seq",),
                     segment: Column | None = None) -> DataFrame:
    """Transitions the table does not allow. Unknown states allow nothing; an event delivered again is a no-op."""
    segment = segment if segment is not None else F.floor(F.col(order[0]) / 1_000_000).cast("bigint")
    seen = previous(events.dropDuplicates(["client_order_id", *order, "state"]), ["client_order_id"], order, segment, {"from_state": "state"})
    legal = F.lit(False)
    for state, nexts in allowed.items():
        if nexts:
            legal = legal | ((F.col("from_state") == state) & F.col("state").isin(*nexts))
    bad = F.col("from_state").isNotNull() & ~F.coalesce(legal, F.lit(False))
    return seen.where(bad).select("client_order_id", *order, "from_state", F.col("state").alias("to_state"))


def fill_summary(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled and remaining quantity, vwap, maker share and fees per order."""
    value = F.col("qty") * F.col("price")
    sums = fills.groupBy("client_order_id").agg(
        F.sum("qty").alias("filled"), F.sum(value).alias("__value"), F.sum(F.when(F.col("maker"), F.col("qty")).otherwise(0)).alias("__maker"), F.sum("fee").alias("fees")
    )
    filled = F.coalesce(F.col("filled"), F.lit(0))
    per = F.nullif(F.col("filled").cast("double"), F.lit(0.0))
    out = orders.join(sums, "client_order_id", "left")
    return out.select(
        *orders.columns, filled.alias("filled"), (F.col("qty") - filled).alias("remaining"), (F.col("__value").cast("double") / per).alias("vwap"),
        (F.col("__maker").cast("double") / per).alias("maker_share"), F.coalesce(F.col("fees"), F.lit(0)).alias("fees"),
    )


def overfills(orders: DataFrame, fills: DataFrame, decisions: DataFrame) -> DataFrame:
    """Orders filled beyond their size, or larger than what was approved (no decision approves nothing)."""
    filled = fills.groupBy("client_order_id").agg(F.sum("qty").alias("filled"))
    approved = decisions.select("decision_id", F.col("quantity").alias("approved_qty"))
    out = orders.join(filled, "client_order_id", "left").join(approved, "decision_id", "left")
    ok = {
        "filled_above_ordered": F.coalesce(F.col("filled"), F.lit(0)) <= F.col("qty"),
        "ordered_above_approved": F.col("qty") <= F.col("approved_qty"),
    }
    return out.withColumn("reasons", not_ok(ok)).where(F.size("reasons") > 0)


def slippage(fills: DataFrame, snapshots: DataFrame, max_slippage_bps: float, arrival: str, tolerance: str | int, limit: str = "limit_price", width: str = "1 day") -> DataFrame:
    """Signed cost in basis points against the arrival mid and against the limit; positive is worse.

    The arrival mid is the one known at ``arrival``, the time the order was sent, and no older than ``tolerance``; without it the fill is a breach.
    """
    quotes = mid_spread(snapshots).select("instrument", "ts", "seq", "mid")
    joined = asof_join(fills, quotes, ["instrument"], on=arrival, right_on="ts", tolerance=tolerance, width=width)
    sign = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1)
    mid, px = F.col("asof.mid").cast("double"), F.col("price").cast("double")
    bound = F.col(limit).cast("double")
    return (
        joined.withColumn("arrival_mid", F.col("asof.mid"))
        .withColumn("slippage_bps", sign * (px - mid) / F.nullif(mid, F.lit(0.0)) * 10_000)
        .withColumn("limit_bps", sign * (px - bound) / F.nullif(bound, F.lit(0.0)) * 10_000)
        .withColumn("breach", ~F.coalesce(F.col("slippage_bps") <= max_slippage_bps, F.lit(False)) | F.coalesce(F.col("limit_bps") > 0, F.lit(False)))
        .drop("asof")
    )


def slippage_summary(graded: DataFrame, by: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """Fills, exact percentiles of their cost, and breaches per group."""
    counts = graded.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col("breach"), 1)).alias("breaches"))
    found = exact_quantiles(graded, by, "slippage_bps", {"p50": 0.5, "p95": 0.95})
    return join_groups(counts, found, by).select(*by, "n", "p50", "p95", "breaches")


def spread_and_band_guard(requests: DataFrame, snapshots: DataFrame, max_spread_bps: Column | float, band_bps: Column | float,
                          reference: str, tolerance: str | int, width: str = "1 day") -> DataFrame:
    """Market orders with the reasons why spread limit or price band would stop them.

    The band is measured from ``reference`` (the price the order was decided on) to the current mid. A quote older than ``tolerance`` is
    no price; one that is not live or delayed is a reason of its own.
    """
    quotes = mid_spread(snapshots).select("instrument", "ts", "seq", "mid", "spread_bps", "quality")
    joined = asof_join(requests.where(F.col("order_type") == "market"), quotes, ["instrument"], tolerance=tolerance, width=width)
    mid, ref = F.col("asof.mid").cast("double"), F.col(reference).cast("double")
    ok = {
        "no_price": F.col("asof").isNotNull(),
        "quote_quality": F.col("asof.quality").isin("live", "delayed"),
        "spread": F.col("asof.spread_bps") <= max_spread_bps,
        "price_band": F.abs(mid - ref) / F.nullif(ref, F.lit(0.0)) * 10_000 <= band_bps,
    }
    return joined.withColumn("reasons", not_ok(ok)).drop("asof")


def reduce_only_audit(fills: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: str | int = "1 day") -> DataFrame:
    """Reduce-only fills that raised the absolute position or flipped its side. The reduce-only flag is
    the order's, joined onto the fills beforehand."""
    path = position_path(fills, by, order, width).withColumn("position_before", F.col("position") - signed_qty())
    after, before = F.col("position"), F.col("position_before")
    grew = (F.abs(after) > F.abs(before)) | (F.signum(after.cast("double")) * F.signum(before.cast("double")) < 0)
    return path.where(F.coalesce(F.col("reduce_only"), F.lit(False)) & F.coalesce(grew, F.lit(True)))


def stage_latency(lineage: DataFrame) -> DataFrame:
    """Exact percentiles of the time from signal to decision to request to first fill, in microseconds."""
    stages = {
        "signal_to_decision": us("decision_ts") - us("signal_ts"),
        "decision_to_request": us("request_ts") - us("decision_ts"),
        "request_to_fill": us("first_fill_ts") - us("request_ts"),
        "signal_to_fill": us("first_fill_ts") - us("signal_ts"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), lag.alias("lag")) for n, lag in stages.items()])
    rows = lineage.select(F.inline(pairs)).where(F.col("lag").isNotNull())
    found = exact_quantiles(rows, ["stage"], "lag", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.groupBy("stage").agg(F.count("*").alias("n")).join(found, "stage").select("stage", "n", "p50", "p95", "p99")


def stale_orders(orders: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """Working orders whose signal has expired, or is unknown, at ``as_of``."""
    live = signals.select("signal_id", "deadline")
    joined = orders.where(F.col("state").isin(*WORKING)).join(live, "signal_id", "left")
    return joined.where(~F.coalesce(F.col("deadline") > F.lit(as_of).cast("timestamp"), F.lit(False)))


def _trail_search(k: float, width_us: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """First trailing-stop hit of each entry inside its bucket, and the extreme reached by then."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ticks, asks = group[group["entry_id"].isna()], group[group["entry_id"].notna()]
        hit = np.full(len(asks), -1, dtype="int64")
        extreme = asks["extreme"].to_numpy("float64")
        best = extreme.copy()
        if len(ticks) and len(asks):
            order, begin, end = sorted_keys(ticks, asks, width_us)
            at, price = ticks["at"].to_numpy("int64")[order], ticks["price"].to_numpy("float64")[order]
            sign, n = asks["sign"].to_numpy("int64"), len(price)
            for s in (1, -1):
                mine = np.flatnonzero(sign == s)
                # With the sign flipped for shorts, a hit is always a value at or below factor * running maximum.
                q, factor, start = s * price, 1 - s * k, begin[mine]
                drop = search_at_or_below(q, np.arange(n) + 1, factor * q)
                earliest = np.append(np.minimum.accumulate(np.where(drop >= 0, drop, n)[::-1])[::-1], n)
                direct = search_at_or_below(q, start, factor * s * extreme[mine])
                place = np.minimum(np.where(direct >= 0, direct, n), earliest[start])
                found = place < end[mine]
                hit[mine[found]] = at[place[found]]
                peak = range_max(q, start, np.where(found, place + 1, end[mine]))
                best[mine] = s * np.maximum(s * extreme[mine], peak)
        return pd.DataFrame({"entry_id": asks["entry_id"].to_numpy(), "hit_us": hit, "extreme": best})

    return search


def trailing_stop_path(entries: DataFrame, snapshots: DataFrame, k: float, until: str, width: str | int = "10 minutes", fanout: int = 36,
                       price: str = "last") -> DataFrame:
    """Trailing stop per position entry: the level it reached and when it was first hit.

    ``entries(entry_id, instrument, direction, ts, price, closed_at)``. A long stop trails the highest
    price since entry times (1 - k), a short one the lowest times (1 + k); prices after ``closed_at``
    (or ``until``) do not count. Buckets of ``width`` and blocks of ``fanout`` buckets are judged from
    pre-aggregated rows: their extremes and whether the price falls (rises) by ``k`` inside them. An
    entry walks its own block by buckets, then whole blocks, then the deciding block by buckets; only
    its first and its deciding bucket are searched tick by tick.
    """
    width_us = micros(width)
    ticks = snapshots.select("instrument", bucket("ts", width).alias("bucket"), us("ts").alias("at"), "seq", F.col(price).cast("double").alias("price"))
    begin = entries.select(
        "entry_id", "instrument", bucket("ts", width).alias("bucket"), us("ts").alias("at"), F.when(F.col("direction") == "long", 1).otherwise(-1).alias("sign"),
        F.col("price").cast("double").alias("extreme"), F.least(us("closed_at"), us(F.lit(until))).alias("until"),
    )
    long = F.col("sign") == 1

    def search(asks: DataFrame) -> DataFrame:
        return bucket_search(asks, ticks, _trail_search(k, width_us), "entry_id string, hit_us long, extreme double")

    def shape(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hi: str, lo: str, inner: Sequence[str] = ()) -> DataFrame:
        """Extremes of each node and whether a stop trailing inside it alone would be hit."""
        run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        fell, rose = F.col(lo) <= (1 - k) * F.max(hi).over(run), F.col(hi) >= (1 + k) * F.min(lo).over(run)
        if inner:
            before = run.rowsBetween(Window.unboundedPreceding, -1)
            fell = (F.col("fell") == 1) | F.coalesce(F.col(lo) <= (1 - k) * F.max(hi).over(before), F.lit(False))
            rose = (F.col("rose") == 1) | F.coalesce(F.col(hi) >= (1 + k) * F.min(lo).over(before), F.lit(False))
        walked = rows.select(*keys, F.col(hi).alias("h"), F.col(lo).alias("l"), fell.cast("int").alias("fell"), rose.cast("int").alias("rose"))
        return walked.groupBy(*keys).agg(F.max("h").alias("hi"), F.min("l").alias("lo"), F.max("fell").alias("fell"), F.max("rose").alias("rose"))

    # Written once: all three walks read it, and each would sort the ticks again.
    fine = materialize(shape(ticks, ["instrument", "bucket"], ["at", "seq"], "price", "price"))
    blocked = fine.withColumn("block", F.floor(F.col("bucket") / fanout).cast("bigint"))
    coarse = shape(blocked, ["instrument", "block"], ["bucket"], "hi", "lo", inner=("fell", "rose"))

    def walk(asks: DataFrame, nodes: DataFrame, node: str, final: str) -> DataFrame:
        """Add to each ask the first node whose row tells of a hit (or the node ``final``), the extreme
        before it, and the extreme after all nodes."""
        seen = asks.select("entry_id", "instrument", "sign", "extreme", final, F.explode("nodes").alias(node)).join(nodes, ["instrument", node])
        earlier = Window.partitionBy("entry_id").orderBy(node).rowsBetween(Window.unboundedPreceding, -1)
        level = F.when(long, F.greatest("extreme", F.max("hi").over(earlier))).otherwise(F.least("extreme", F.min("lo").over(earlier)))
        seen = seen.withColumn("level", level)
        hit = F.when(long, (F.col("fell") == 1) | (F.col("lo") <= (1 - k) * F.col("level"))).otherwise((F.col("rose") == 1) | (F.col("hi") >= (1 + k) * F.col("level")))
        stops = F.when(hit | (F.col(node) == F.col(final)), F.col(node))
        found = seen.groupBy("entry_id").agg(
            F.min(stops).alias("stop_node"), F.min_by(F.when(stops.isNotNull(), F.col("level")), stops).alias("stop_extreme"),
            F.max("hi").alias("hi"), F.min("lo").alias("lo"),
        )
        joined = asks.drop("nodes").join(found, "entry_id", "left")
        after = F.when(long, F.greatest("extreme", "hi")).otherwise(F.least("extreme", "lo"))
        return joined.withColumn("extreme", F.coalesce("stop_extreme", after)).drop("hi", "lo", "stop_extreme")

    own = materialize(search(begin))
    first = begin.drop("extreme").join(own, "entry_id")
    end_bucket = F.floor(F.col("until") / width_us).cast("bigint")
    end_block = F.floor(F.col("until") / (width_us * fanout)).cast("bigint")
    own_block = F.floor(F.col("bucket") / fanout).cast("bigint")
    waiting = first.where("hit_us < 0").select("entry_id", "instrument", "sign", "until", "extreme", end_bucket.alias("end_bucket"), end_block.alias("end_block"),
                                               own_block.alias("own_block"), F.col("bucket").alias("own"))
    none = F.array().cast("array<bigint>")
    near = waiting.withColumn("nodes", node_range(F.col("own") + 1, F.least("end_bucket", (F.col("own_block") + 1) * fanout - 1)))
    near = walk(near, fine, "bucket", "end_bucket").withColumnRenamed("stop_node", "near_bucket")
    over = near.withColumn("nodes", F.when(F.col("near_bucket").isNull(), node_range(F.col("own_block") + 1, F.col("end_block"))).otherwise(none))
    over = walk(over, coarse, "block", "end_block").withColumnRenamed("stop_node", "hit_block")
    inside = F.sequence(F.col("hit_block") * fanout, F.least("end_bucket", (F.col("hit_block") + 1) * fanout - 1))
    far = walk(over.withColumn("nodes", F.when(F.col("hit_block").isNotNull(), inside).otherwise(none)), fine, "bucket", "end_bucket")
    decided = materialize(far.withColumn("bucket", F.coalesce("near_bucket", "stop_node")))
    second = search(decided.where(F.col("bucket").isNotNull()).select(
        "entry_id", "instrument", "bucket", (F.col("bucket") * width_us - 1).alias("at"), "sign", "extreme", "until"
    )).select("entry_id", F.col("hit_us").alias("later_hit"), F.col("extreme").alias("later_extreme"))
    passed = decided.select("entry_id", F.col("extreme").alias("passed_extreme"))
    out = first.join(passed, "entry_id", "left").join(second, "entry_id", "left")
    extreme = F.coalesce("later_extreme", "passed_extreme", "extreme")
    hit_us = F.when(F.col("hit_us") >= 0, F.col("hit_us")).when(F.col("later_hit") >= 0, F.col("later_hit"))
    return out.select(
        "entry_id", "instrument", extreme.alias("extreme"), (extreme * (1 - F.col("sign") * k)).alias("stop_level"), F.timestamp_micros(hit_us).alias("hit_at")
    )
