"""Point-in-time features. Every frame ends at the row itself or before it."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketops.functions.timing import bucket, us
from marketops.functions.windows import ROW_NUMBER, previous, rolling
from marketops.schemas import MONEY, PRICE

BY, ORDER = ("instrument",), ("ts", "seq")


def mid_spread(df: DataFrame) -> DataFrame:
    """Mid, absolute spread and spread in basis points of the mid."""
    mid = ((F.col("bid") + F.col("ask")) / 2).cast(PRICE)
    spread = (F.col("ask") - F.col("bid")).cast(PRICE)
    bps = spread.cast("double") / F.nullif(mid, F.lit(0)).cast("double") * 10_000
    return df.withColumns({"mid": mid, "spread": spread, "spread_bps": bps})


def bars(df: DataFrame, width: str, slide: str | None = None, price: str = "last", volume: str = "volume", ts: str = "ts",
         tie: str = "seq", by: Sequence[str] = BY) -> DataFrame:
    """Open, high, low, close, volume, ticks and vwap per tumbling or sliding window.

    All aggregates combine map-side, so a busy instrument shuffles one row per task and window. Works
    unchanged on a stream with a watermark.
    """
    when = F.struct(F.col(ts), F.col(tie))
    traded = (F.col(price) * F.col(volume)).cast(MONEY)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        df.groupBy(*by, window.alias("window"))
        .agg(
            F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"),
            F.sum(volume).alias("volume"), F.count("*").alias("ticks"),
            (F.sum(traded).cast("double") / F.nullif(F.sum(volume), F.lit(0)).cast("double")).alias("vwap"),
        )
        .select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "open", "high", "low", "close", "volume", "ticks", "vwap")
    )


def _when_full(window: WindowSpec, n: int, value: Column) -> Column:
    return F.when(F.col(ROW_NUMBER) > n, value)


def rolling_volatility(df: DataFrame, n: int, price: str = "last", width: str | int = "1 hour") -> DataFrame:
    """Sample deviation of the last ``n`` log returns; NULL until ``n`` returns exist."""
    px = F.col(price).cast("double")
    priced = previous(df, BY, ORDER, bucket("ts", width), {"__p": px})
    ret = F.ln(F.when(px > 0, px) / F.when(F.col("__p") > 0, F.col("__p")))
    rows = priced.withColumn("__r", ret)

    def cols(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-(n - 1), 0)
        full = F.count("__r").over(frame) == n
        return {"volatility": F.when(full, F.stddev_samp("__r").over(frame))}

    out = rolling(rows.drop(*["volatility"]), BY, ORDER, bucket("ts", width), cols, before=n - 1)
    return out.drop("__r", "__p").withColumn("volatility_method", F.lit(f"stddev_samp_log_return_{n}"))


def liquidity_measure(df: DataFrame, n: int, price: str = "last", volume: str = "volume", width: str | int = "1 hour", normalize: str | int = "1 day") -> DataFrame:
    """Notional traded over the last ``n`` updates, and the instrument's rank by it at the close of the
    previous time bucket, 0 lowest to 1 highest (NULL where it did not trade then)."""
    rows = df.drop("liquidity").withColumn("__t", (F.col(price) * F.col(volume)).cast(MONEY))

    def cols(w: WindowSpec) -> dict[str, Column]:
        return {"liquidity": F.sum("__t").over(w.rowsBetween(-(n - 1), 0))}

    raw = rolling(rows, BY, ORDER, bucket("ts", width), cols, before=n - 1).drop("__t")
    raw = raw.withColumn("__b", bucket("ts", normalize))
    latest = raw.groupBy("__b", "instrument").agg(F.max_by("liquidity", F.struct(*ORDER)).alias("__l"))
    # One row per instrument and bucket: as many rows per window as there are markets.
    rank = F.percent_rank().over(Window.partitionBy("__b").orderBy("__l"))
    ranked = latest.select((F.col("__b") + 1).alias("__b"), "instrument", rank.alias("liquidity_rank"))
    out = raw.join(ranked, ["__b", "instrument"], "left").drop("__b")
    return out.withColumn("liquidity_method", F.lit(f"rolling_notional_{n}"))


def momentum(df: DataFrame, n: int, price: str = "last", width: str | int = "1 hour") -> DataFrame:
    """Price over the price ``n`` updates ago, minus one."""
    px = F.col(price).cast("double")

    def cols(w: WindowSpec) -> dict[str, Column]:
        past = F.lag(px, n).over(w)
        return {"momentum": px / F.nullif(past, F.lit(0.0)) - 1}

    return rolling(df, BY, ORDER, bucket("ts", width), cols, before=n)


def breakout(df: DataFrame, n: int, price: str = "last", width: str | int = "1 hour") -> DataFrame:
    """1 above the maximum of the previous ``n`` prices, -1 below their minimum, else 0; NULL until full."""
    px = F.col(price)

    def cols(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-n, -1)
        mark = F.when(px > F.max(px).over(frame), 1).when(px < F.min(px).over(frame), -1).otherwise(0)
        return {"breakout": _when_full(w, n, mark)}

    return rolling(df, BY, ORDER, bucket("ts", width), cols, before=n)


def pullback(df: DataFrame, n: int, k: float, price: str = "last", width: str | int = "1 hour") -> DataFrame:
    """Up over ``n`` updates, yet at least the share ``k`` below the highest of them; NULL until full."""
    px = F.col(price).cast("double")

    def cols(w: WindowSpec) -> dict[str, Column]:
        high = F.max(px).over(w.rowsBetween(-n, 0))
        return {"pullback": _when_full(w, n, (px > F.lag(px, n).over(w)) & (px <= high * (1 - k)))}

    return rolling(df, BY, ORDER, bucket("ts", width), cols, before=n)


def leakage_audit(features: DataFrame, decisions: DataFrame, key: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Features used by a decision although they became available only after it, or whose frame
    reaches past it.

    ``features(key, available_at, frame_end)``, ``decisions(key, decision_id, ts)``. An unknown
    availability is a violation.
    """
    f = features.select(*key, "available_at", "frame_end")
    used = decisions.select(*key, "decision_id", "ts").join(f, list(key), "left")
    late = ~F.coalesce(F.col("available_at") <= F.col("ts"), F.lit(False))
    ahead = F.coalesce(F.col("frame_end") > F.col("ts"), F.lit(False))
    return used.withColumn("violation", F.when(late, "available_after_decision").when(ahead, "frame_reaches_forward")).where("violation is not null")


def emit_signals(features: DataFrame, rule: Column, strategy_id: str, zone: float, horizon_us: int, confidence: Column,
                 expected_move: Column, stop: float, price: str = "last") -> DataFrame:
    """Rows where ``rule`` is non-zero become signals: 1 long, -1 short. No sizes, no leverage.

    ``zone`` and ``stop`` are fractions of the price. The id is a hash of strategy, instrument, time
    and sequence, so running twice gives the same ids.
    """
    px = F.col(price)
    band, away = (px * Decimal(str(share)) for share in (zone, stop))
    shaped = features.withColumn("__side", rule).where(F.col("__side").isin(1, -1))
    identity = F.concat_ws("|", F.lit(strategy_id), "instrument", us("ts").cast("string"), F.col("seq").cast("string"))
    return shaped.select(
        F.sha2(identity, 256).alias("signal_id"), "instrument",
        F.when(F.col("__side") == 1, "long").otherwise("short").alias("direction"), "ts", F.lit(strategy_id).alias("strategy_id"),
        F.struct((px - band).cast(PRICE).alias("low"), (px + band).cast(PRICE).alias("high")).alias("entry_zone"),
        (px - F.col("__side") * away).cast(PRICE).alias("invalidation_level"), expected_move.cast(PRICE).alias("expected_move"),
        F.lit(horizon_us).cast("bigint").alias("horizon_us"), confidence.cast(PRICE).alias("confidence"),
        F.create_map(F.lit("feature_seq"), F.col("seq").cast("string")).alias("metadata"),
    )
