"""Runtime states, safety audits, feed health and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.timing import bucket, micros, us
from marketops.functions.windows import previous
from marketops.operators.joins import asof_join, covered_by
from marketops.session import materialize

RUNTIME_STATES = ("STARTING", "RECONCILING", "READY", "DEGRADED", "HALTED")
MUST_RECONCILE_AFTER = ("STARTING",)
#: States that mean a lost connection or a stop; being READY again takes a reconciliation in between.
INTERRUPTED = ("DEGRADED", "HALTED")


def state_timeline(states: DataFrame, order: Sequence[str] = ("from_ts", "seq"), width: str | int = "1 day", scope: Sequence[str] = ()) -> DataFrame:
    """Intervals of each runtime state with their length, and what is wrong with the step that follows.

    ``restart_not_reconciled``: a restart that is not followed by RECONCILING. ``reconnect_not_reconciled``: READY straight after an
    interruption. ``unknown_state``: not a state at all. The last interval is open: NULL ``to_ts``.
    """
    seen = previous(states, scope, order, bucket(order[0], width), {"to_ts": "from_ts", "next_state": "state"}, reverse=True)
    restart = F.col("state").isin(*MUST_RECONCILE_AFTER) & F.col("next_state").isNotNull() & (F.col("next_state") != "RECONCILING")
    reconnect = F.col("state").isin(*INTERRUPTED) & (F.col("next_state") == "READY")
    known = F.coalesce(F.col("state").isin(*RUNTIME_STATES), F.lit(False))
    return seen.select(
        *scope, "state", *order, "to_ts", (us("to_ts") - us("from_ts")).alias("duration_us"),
        F.when(~known, "unknown_state").when(restart, "restart_not_reconciled").when(reconnect, "reconnect_not_reconciled").alias("violation"),
    )


def time_in_state(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("state").agg(
        F.count("*").alias("visits"), F.sum("duration_us").alias("total_us"), F.count("violation").alias("violations")
    )


def exposure_outside_ready(requests: DataFrame, states: DataFrame, path: DataFrame, by: Sequence[str] = ("account", "instrument"),
                           width: str | int | None = "10 minutes", path_width: str | int | None = "1 day") -> DataFrame:
    """Requests sent while the runtime was not READY and that do not provably lower exposure.

    In DEGRADED and HALTED a reduce-only request against a known opposite position of at least its size
    is tolerated. An unknown state or position is a violation. ``path`` is the position path.
    """
    # Each walk reads its sides twice, so the path and the first walk's result are written once, narrow.
    path = materialize(path.select(*by, "ts", "position", F.col("fill_id").alias("seq")))
    stated = asof_join(requests, states.select("from_ts", "seq", "state"), [], right_on="from_ts", width=width, name="__state")
    at = materialize(stated.select(*requests.columns, F.struct(F.col("__state.state").alias("state")).alias("__state")))
    held = asof_join(at, path, list(by), width=path_width, name="__held")
    state, pos = F.col("__state.state"), F.col("__held.position")
    opposite = F.when(F.col("side") == "buy", pos < 0).when(F.col("side") == "sell", pos > 0)
    reduces = F.col("reduce_only") & opposite & (F.col("quantity") <= F.abs(pos))
    fine = (state == "READY") | (state.isin("DEGRADED", "HALTED") & reduces)
    return held.where(~F.coalesce(fine, F.lit(False))).select(*requests.columns, state.alias("state"), pos.alias("position"))


def kill_switch_audit(requests: DataFrame, switches: DataFrame, width: str | int | None = "10 minutes") -> DataFrame:
    """New exposure requested while the kill switch was engaged."""
    graded = covered_by(requests, switches, [], "engaged_at", "released_at", width=width, flag="__killed")
    return graded.where(F.col("__killed") & ~F.coalesce(F.col("reduce_only"), F.lit(False))).drop("__killed")


# The nine mandatory invariants, in their order.
INVARIANTS = (
    "max_exposure", "leverage", "reduce_only", "fill_counted_once", "duplicate_order_events",
    "stale_inputs", "nothing_lost_on_restart", "failure_blocks_exposure", "replay_identical",
)


def invariant_report(violations: Mapping[str, DataFrame], samples: int = 3) -> DataFrame:
    """One row per invariant with the number of violations and its first ids in order.

    Each value of ``violations`` is a query with a column ``id``. Invariants without rows report zero.
    """
    unknown = set(violations) - set(INVARIANTS)
    if unknown:
        raise ValueError(f"not an invariant: {sorted(unknown)}")
    spark = next(iter(violations.values())).sparkSession
    rows = None
    for name, df in violations.items():
        part = df.select(F.lit(name).alias("invariant"), F.col("id").cast("string").alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows)
    first = Window.partitionBy("invariant").orderBy("id")
    sampled = rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= samples)
    sampled = sampled.groupBy("invariant").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    # Literals, so that no task starts a Python worker.
    listed = F.array(*[F.struct(F.lit(i + 1).alias("number"), F.lit(n).alias("invariant")) for i, n in enumerate(INVARIANTS) if n in violations])
    names = spark.range(1).select(F.inline(listed))
    counts = rows.groupBy("invariant").agg(F.count("*").alias("violations"))
    out = names.join(counts, "invariant", "left").join(sampled, "invariant", "left")
    return out.select("number", "invariant", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"))


def feed_health(events: DataFrame, width: str, late_after: str | int, feed: Sequence[str] = ("venue", "channel"), ts: str = "event_ts", edges: bool = True) -> DataFrame:
    """Events, missing sequence numbers, late events and stale share per feed and tumbling window.

    Runs on a batch or, with a watermark, on a stream; lateness is receipt minus event time, so it is
    counted before any watermark drops a row. ``missing`` holds for deduplicated events; a hole between two windows counts in the later one, unless
    ``edges`` is off. A stream closes windows one by one and counts holes inside them only.
    """
    late = us("receipt_ts") - us(ts) > micros(late_after)
    stale = F.when(F.col("quality").isin("live", "delayed"), 0.0).otherwise(1.0) if "quality" in events.columns else F.lit(None).cast("double")
    inside = (F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("missing")
    per = events.groupBy(*feed, F.window(ts, width).alias("w")).agg(
        F.count("*").alias("n"), inside, F.count(F.when(late, 1)).alias("late"), F.avg(stale).alias("stale_share"), F.min("seq").alias("__lo"), F.max("seq").alias("__hi"),
    ).select(*feed, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "missing", "late", "stale_share", "__lo", "__hi")
    if edges and not events.isStreaming:
        # One row per feed and window; a year of windows forms a segment.
        per = previous(per, feed, ["window_start"], bucket("window_start", "365 days"), {"__p": "__hi"})
        per = per.withColumn("missing", F.col("missing") + F.coalesce(F.col("__lo") - 1 - F.col("__p"), F.lit(0)))
    return per.select(*feed, "window_start", "window_end", "n", "missing", "late", "stale_share")


def alerts(metrics: DataFrame, thresholds: Mapping[str, float], scope: Sequence[str], ts: str = "window_start", width: str | int = "1 day") -> DataFrame:
    """Threshold breaches, once per breach episode: the first row of each unbroken run of breaches."""
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()])
    rows = metrics.select(*scope, ts, F.inline(named)).withColumn("breach", F.coalesce(F.col("value") > F.col("threshold"), F.lit(True)))
    seen = previous(rows, [*scope, "metric"], [ts], bucket(ts, width), {"__was": "breach"})
    return seen.where(F.col("breach") & ~F.coalesce("__was", F.lit(False))).drop("breach", "__was")
