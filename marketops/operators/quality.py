"""Idempotency, gaps, clock checks, staleness and feed quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.quantiles import exact_quantiles, join_groups
from marketops.functions.timing import bucket, micros, us
from marketops.functions.windows import previous, running, scan
from marketops.session import materialize

SOURCE_KEY = ("venue", "channel", "instrument", "seq")
FEED = ("venue", "channel", "instrument")
REPLAY_ORDER = ("event_ts", "receipt_ts", "venue", "channel", "instrument", "seq")


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key. Spark keeps one row per key and task before it shuffles, so a key with
    very many copies costs no more than any other."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_events(df: DataFrame, key: Sequence[str] = SOURCE_KEY, order: Sequence[str] = ("receipt_ts", "persisted_ts", "payload")) -> DataFrame:
    return first_of(df, key, order)


def dedup_signals(df: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    return first_of(df, ["signal_id"], order)


def dedup_fills(df: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per venue fill id; run before any position or PnL."""
    return first_of(df, ["venue", "fill_id"], order)


def dedup_requests(df: DataFrame, order: Sequence[str] = ("ts", "request_id")) -> DataFrame:
    """First by request id, then first by client order id."""
    return first_of(first_of(df, ["request_id"], order), ["client_order_id"], order)


def row_digest(columns: Sequence[str], df: DataFrame) -> Column:
    """64-bit digest of the columns; maps count through their sorted entries, NULL differs from empty."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    parts = [F.array_sort(F.map_entries(c)) if kinds[c] == "map" else F.col(c) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return F.xxhash64(*parts, *nulls)


def conflicting_duplicates(df: DataFrame, key: Sequence[str], payload: Sequence[str] | None = None) -> DataFrame:
    """Keys whose copies differ in payload, with the number of variants."""
    payload = payload or [c for c in df.columns if c not in key]
    variants = df.select(*key, row_digest(payload, df).alias("__digest")).groupBy(*key, "__digest").agg(F.count("*").alias("__copies"))
    return (
        variants.groupBy(*key)
        .agg(F.count("*").alias("variants"), F.sum("__copies").alias("copies"))
        .where("variants > 1")
    )


def _seq_segment(span: int, seq: str = "seq") -> Column:
    return ((F.col(seq) - F.pmod(F.col(seq), F.lit(span))) / span).cast("bigint")


def sequence_gaps(df: DataFrame, feed: Sequence[str] = FEED, seq: str = "seq", span: int = 1_000_000) -> DataFrame:
    """Missing sequence ranges per feed. ``span`` sequence numbers make one parallel segment."""
    seen = previous(df.select(*feed, seq), feed, [seq], _seq_segment(span, seq), {"__p": seq})
    gaps = seen.where(F.col(seq) > F.col("__p") + 1)
    return gaps.select(*feed, (F.col("__p") + 1).alias("gap_from"), (F.col(seq) - 1).alias("gap_to"))


def gap_repair_state(
    df: DataFrame, snapshot: Column, feed: Sequence[str] = FEED, seq: str = "seq", ts: str = "event_ts", span: int = 1_000_000,
    tolerance: int = 0,
) -> DataFrame:
    """Mark rows after a gap until the next snapshot event of the feed repairs it. Up to ``tolerance``
    missing numbers are no gap (for feeds that share their numbering with others).

    ``in_gap`` covers the first row after the hole up to, not including, the repairing snapshot.
    ``repaired_at`` is that snapshot's time; NULL means the gap is still open, so fail closed.
    """
    cut = _seq_segment(span, seq)
    seen = previous(df, feed, [seq], cut, {"__p": seq})
    marks = seen.withColumns({
        "__gap": F.when(F.col(seq) > F.col("__p") + 1 + tolerance, F.col(seq)),
        "__heal": F.when(snapshot, F.col(seq)),
        "__heal_ts": F.when(snapshot, F.col(ts)),
    })
    # Gaps are seen from the row before, so they are marked first and written once.
    marks = materialize(marks.drop("__p"))
    ahead = scan(marks, feed, [seq], cut, {"__last_gap": ("max", "__gap"), "__last_heal": ("max", "__heal"), "__next_heal": ("next", "__heal_ts")})
    open_gap = F.col("__last_gap").isNotNull() & ~F.coalesce(F.col("__last_heal") >= F.col("__last_gap"), F.lit(False))
    return ahead.select(*df.columns, open_gap.alias("in_gap"), F.when(open_gap, F.col("__next_heal")).alias("repaired_at"))


def clock_regressions(
    df: DataFrame, feed: Sequence[str] = FEED, order: Sequence[str] = ("receipt_ts", "seq"), ts: str = "event_ts", width: str | int = "1 hour"
) -> DataFrame:
    """Rows whose event time lies below the highest event time received before them."""
    seen = running(df, feed, order, bucket(order[0], width), {"__high": ("max", ts)}, inclusive=False)
    late = us("__high") - us(ts)
    return seen.withColumn("regression_us", late).where("regression_us > 0").drop("__high")


def worst(*qualities: Column) -> Column:
    """Worst of several qualities, live < delayed < stale < invalid; anything unknown is invalid."""
    ranks = [
        F.when(q == "live", 0).when(q == "delayed", 1).when(q == "stale", 2).otherwise(3) for q in qualities
    ]
    rank = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.when(rank == 0, "live").when(rank == 1, "delayed").when(rank == 2, "stale").otherwise("invalid")


def classify_staleness(df: DataFrame, as_of: str | Column, max_age: str = "max_age_us", delayed: str | None = None) -> DataFrame:
    """Grade rows by event age and receipt age against the policy column attached by ``policy_join``.

    ``as_of`` is an instant or a column. A missing policy value or clock counts as stale; the feed's
    own quality can only make things worse. Ages above ``delayed`` (optional column) count as delayed.
    """
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of

    def grade(age: Column) -> Column:
        fresh = F.coalesce(age <= F.col(max_age), F.lit(False))
        slow = F.lit(False) if delayed is None else F.coalesce(age > F.col(delayed), F.lit(False))
        return F.when(~fresh, "stale").when(slow, "delayed").otherwise("live")

    aged = df.withColumns({"age_us": us(now) - us("ts"), "receipt_age_us": us(now) - us("receipt_ts")})
    return aged.withColumn("quality", worst(F.col("quality"), grade(F.col("age_us")), grade(F.col("receipt_age_us"))))


def sticky_quality(
    df: DataFrame, by: Sequence[str] = ("instrument",), order: Sequence[str] = ("ts", "seq"),
    heals: Column | None = None, width: str | int = "1 hour",
) -> DataFrame:
    """Stale or invalid stays so until a fresh snapshot or gap recovery (``heals``); a row that is merely
    live again does not heal. Default: a live row flagged ``is_snapshot`` heals."""
    heals = heals if heals is not None else (F.col("quality") == "live") & F.col("is_snapshot")
    heals = F.coalesce(heals, F.lit(False))
    bad = ~F.coalesce(F.col("quality").isin("live", "delayed"), F.lit(False))
    mark = F.when(bad, worst(F.col("quality"))).when(heals, F.lit("ok"))
    seen = running(df, by, order, bucket(order[0], width), {"__mark": ("last", mark)})
    held = F.when(F.col("__mark").isNull() | (F.col("__mark") == "ok"), F.col("quality")).otherwise(F.col("__mark"))
    return seen.withColumn("effective_quality", held).drop("__mark")


def feed_silence(df: DataFrame, limit: str | int | None = None, feed: Sequence[str] = FEED, ts: str = "event_ts",
                 tie: Sequence[str] = ("seq",), limit_column: str | None = None, width: str | int = "1 hour", as_of: str | None = None) -> DataFrame:
    """Intervals between neighbouring events longer than the policy: the feed was disconnected.

    With ``as_of`` a feed whose last event lies further back than the policy allows is reported too, up to ``as_of``.

    The limit is a duration, or a column of microseconds attached by ``policy_join`` (NULL: any
    silence counts)."""
    keep = [limit_column] if limit_column else []
    seen = previous(df.select(*feed, ts, *tie, *keep), feed, [ts, *tie], bucket(ts, width), {"__p": ts})
    allowed = F.col(limit_column) if limit_column else F.lit(micros(limit))
    silent = F.coalesce(us(ts) - us("__p") > allowed, F.col("__p").isNotNull())
    gaps = seen.where(silent).select(*feed, F.col("__p").alias("from_ts"), F.col(ts).alias("to_ts"))
    if as_of is None:
        return gaps
    last = df.groupBy(*feed).agg(F.max(ts).alias("from_ts"), *([F.max_by(limit_column, F.struct(ts, *tie)).alias("__limit")] if limit_column else []))
    now = F.lit(as_of).cast("timestamp")
    dead = F.coalesce(us(now) - us("from_ts") > (F.col("__limit") if limit_column else F.lit(micros(limit))), F.col("from_ts") < now)
    return gaps.unionByName(last.where(dead).select(*feed, "from_ts", now.alias("to_ts")))


def ingest_latency(df: DataFrame, late_after: str | int, width: str = "1 day", feed: Sequence[str] = ("venue", "channel")) -> DataFrame:
    """Exact percentiles of event-to-receipt lag (µs) and late events per feed and tumbling window."""
    lag, persist = us("receipt_ts") - us("event_ts"), us("persisted_ts") - us("receipt_ts")
    rows = df.select(*feed, F.window("event_ts", width)["start"].alias("window_start"), lag.alias("lag"), persist.alias("persist"))
    keys = [*feed, "window_start"]
    counts = rows.groupBy(*keys).agg(F.max("persist").alias("max_persist"), F.count("*").alias("n"), F.count(F.when(F.col("lag") > micros(late_after), 1)).alias("late"))
    found = exact_quantiles(rows, keys, "lag", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return join_groups(counts, found, keys).select(*keys, "p50", "p95", "p99", "max_persist", "n", "late")


def interval_volume(df: DataFrame, semantics: str, by: Sequence[str] = ("instrument",), order: Sequence[str] = ("ts", "seq"), width: str | int = "1 hour") -> DataFrame:
    """Volume per update. ``cumulative`` volumes are differenced, a falling counter being a reset;
    ``interval`` volumes pass through, as the adapter declared."""
    if semantics == "interval":
        return df.withColumn("interval_volume", F.col("volume"))
    if semantics != "cumulative":
        raise ValueError("semantics is 'interval' or 'cumulative'")
    seen = previous(df, by, order, bucket(order[0], width), {"__p": "volume"})
    v, p = F.col("volume"), F.col("__p")
    return seen.withColumn("interval_volume", F.when(p.isNull() | (v < p), v).otherwise(v - p)).drop("__p")


def total_order(df: DataFrame, order: Sequence[str] = REPLAY_ORDER) -> DataFrame:
    """Deterministic replay order, as a range-partitioned sort over all executors."""
    return df.orderBy(*order)
