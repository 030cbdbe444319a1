"""Signal lifecycle: deadlines, outcomes, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketops.functions.timing import micros, shift, us
from marketops.functions.windows import running
from marketops.operators.joins import asof_join
from marketops.session import materialize


def signal_deadline(signals: DataFrame, max_age: str = "max_age_us", policy_expiry: str = "policy_expiry", invalidated_at: str = "invalidated_at") -> DataFrame:
    """Earliest of policy expiry, horizon end, data-staleness deadline and invalidation, and its cause.

    A signal without a staleness policy is already expired; a missing policy expiry or invalidation is
    no deadline at all. At equal instants the cause listed first wins.
    """
    causes = {
        "policy": F.col(policy_expiry),
        "horizon": shift("ts", F.col("horizon_us")),
        "staleness": shift("ts", F.coalesce(F.col(max_age).cast("bigint"), F.lit(0))),
        "invalidation": F.col(invalidated_at),
    }
    out = signals.withColumn("deadline", F.least(*causes.values()))
    cause = F.coalesce(*[F.when(instant == F.col("deadline"), F.lit(name)) for name, instant in causes.items()])
    return out.withColumn("cause", cause)


def active_signals(signals: DataFrame, as_of: str) -> DataFrame:
    """Signals that may open or increase at ``as_of``: ts <= as_of < deadline."""
    now = F.lit(as_of).cast("timestamp")
    return signals.where((F.col("ts") <= now) & (now < F.col("deadline")))


def signal_outcomes(signals: DataFrame, snapshots: DataFrame, tolerance: str | int, price: str = "last", width: str = "1 day") -> DataFrame:
    """Realized move from signal time to horizon end, signed by direction, and whether it reached the expected move.

    Prices older than ``tolerance`` do not count. Without one at the horizon's end (delisted, end of the data) a signal is ``censored``: its outcome
    is NULL, and ``followed_us`` is how long it could be followed, up to its instrument's last price; of others it is the
    horizon. Without a price at the signal there is no outcome at all, and ``followed_us`` is NULL.
    """
    ticks = snapshots.select("instrument", "ts", "seq", F.col(price).alias("px"))
    entry = asof_join(signals.withColumn("__end", shift("ts", F.col("horizon_us"))), ticks, ["instrument"], tolerance=tolerance, width=width, name="__in")
    both = asof_join(entry, ticks, ["instrument"], on="__end", right_on="ts", width=width, name="__out")
    sign = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1)
    start, end = F.col("__in.px").cast("double"), F.col("__out.px").cast("double")
    fresh = F.coalesce(us("__end") - us("__out.ts") <= micros(tolerance), F.lit(False))
    out = both.withColumn("realized", F.when(fresh, sign * (end - start) / F.nullif(start, F.lit(0.0))))
    out = out.withColumns({
        "hit": F.col("realized") >= F.col("expected_move").cast("double"), "censored": start.isNotNull() & ~fresh,
        "followed_us": F.when(start.isNotNull(), F.when(fresh, F.col("horizon_us")).otherwise(F.greatest(us("__out.ts") - us("ts"), F.lit(0)))),
    })
    return out.drop("__end", "__in", "__out")


def hit_curve(outcomes: DataFrame, by: Sequence[str], width: int = 86_400_000_000) -> DataFrame:
    """Product-limit estimate of the share of signals that have not reached their expected move after ``followed_us``, per group.

    A hit counts at its horizon; a miss leaves the risk set there, a censored signal where it was lost from sight, so neither is taken for
    the other. Equal durations are counted first; one scan backward gives how many were still at risk, one forward the product. ``width`` µs
    of duration form one parallel segment.
    """
    t = F.col("followed_us")
    per = outcomes.where(t.isNotNull()).groupBy(*by, "followed_us").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("*").alias("__n"))
    segment = F.floor(t / width).cast("bigint")
    risk = running(per, by, ["followed_us"], segment, {"at_risk": ("sum", F.col("__n"))}, reverse=True)
    left = F.col("at_risk") - F.col("hits")
    step = {"__log": ("sum", F.when(left > 0, F.log(left / F.col("at_risk"))).otherwise(0.0)), "__ends": ("sum", F.when(left == 0, 1).otherwise(0))}
    found = running(materialize(risk), by, ["followed_us"], segment, step)
    return found.select(*by, "followed_us", "at_risk", "hits", F.when(F.col("__ends") > 0, 0.0).otherwise(F.exp("__log")).alias("waiting"))


def confidence_calibration(outcomes: DataFrame, buckets: int = 10) -> DataFrame:
    """Hit rate, mean confidence and Brier score per confidence bucket; confidence 1 joins the top one."""
    conf = F.col("confidence").cast("double")
    # Whole units of the eighth decimal keep the bucket edges exact.
    units = (F.col("confidence").cast("decimal(18,8)") * 100_000_000).cast("bigint")
    number = F.least(F.floor(units * buckets / 100_000_000), F.lit(buckets - 1)).cast("int")
    hit = F.col("hit").cast("double")
    return (
        outcomes.where(F.col("hit").isNotNull())
        .groupBy(number.alias("bucket"))
        .agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg(conf).alias("mean_confidence"), F.avg((conf - hit) * (conf - hit)).alias("brier"))
    )


def strategy_immutability(signals: DataFrame, config: str = "config") -> DataFrame:
    """Strategy ids seen with more than one configuration."""
    digest = F.sha2(F.coalesce(F.col(config), F.lit("")), 256)
    seen = signals.select("strategy_id", digest.alias("digest"), us("ts").alias("at")).groupBy("strategy_id", "digest").agg(F.min("at").alias("at"))
    return (
        seen.groupBy("strategy_id")
        .agg(F.count("*").alias("variants"), F.timestamp_micros(F.max("at")).alias("latest_variant_since"))
        .where("variants > 1")
    )
