"""Streaming reads, dedup, sessions, joins, sticky quality and the gated micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from marketops.functions.timing import micros, us
from marketops.operators.quality import SOURCE_KEY
from marketops.schemas import RAW_EVENT


def stream_events(spark: SparkSession, path: str | None = None, schema: T.StructType = RAW_EVENT, topic: str | None = None,
                  servers: str | None = None, glob: str | None = None, files_per_batch: int = 1000, ts: Sequence[str] = ()) -> DataFrame:
    """Recorded events as a stream, from Parquet files or from a Kafka topic holding JSON values.

    Columns named in ``ts`` that were stored without a zone become UTC timestamps, as watermarks need.
    """
    if topic is not None:
        source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
        df = source.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    else:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        df = reader.parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ts}) if ts else df


def dedup_stream(events: DataFrame, delay: str, key: Sequence[str] = SOURCE_KEY, ts: str = "event_ts") -> DataFrame:
    """First arrival of each key inside the watermark. Older repeats are the batch ledger's business:
    an id that must count once for ever goes through ``append_audit``."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def session_activity(events: DataFrame, gap: str, delay: str, feed: Sequence[str], ts: str = "event_ts") -> DataFrame:
    """Unbroken activity per feed; what lies between two sessions is silence longer than ``gap``."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(*feed, F.session_window(ts, gap).alias("s"))
        .agg(F.count("*").alias("n"))
        .select(*feed, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def missing_decisions_stream(signals: DataFrame, decisions: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Signals for which no decision arrives in time: a left outer stream join, empty side kept."""
    s = signals.withWatermark("ts", delay)
    d = decisions.select(F.col("signal_id").alias("d_signal"), "decision_id", F.col("ts").alias("d_ts")).withWatermark("d_ts", delay)
    limit = F.expr(f"INTERVAL {micros(timeout)} MICROSECOND")
    on = (F.col("signal_id") == F.col("d_signal")) & F.col("d_ts").between(F.col("ts"), F.col("ts") + limit)
    return s.join(d, on, "left_outer").where(F.col("decision_id").isNull()).drop("d_signal", "decision_id", "d_ts")


def alert_stream(metrics: DataFrame, breach: Column, key: Sequence[str], ts: str, quiet: str) -> DataFrame:
    """The first breach of each episode. An episode of a key ends with a row that does not breach, or with the quiet time
    without a breach. Rows of a micro-batch are taken in order of ts; a row older than its key's state never changes
    it, and alerts unless the key is in breach. Breaches without a time all alert."""
    rows = metrics.withColumns({"__breach": F.coalesce(breach, F.lit(False)), "__at": us(ts)})
    state = T.StructType([T.StructField("breach", T.BooleanType()), T.StructField("at", T.LongType()), T.StructField("last", T.LongType())])
    columns, limit = metrics.columns, micros(quiet)

    def step(_: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches), ignore_index=True)
        hit = df["__breach"].astype(bool)
        # Times are NULL or whole microseconds; at one time a breach comes first.
        df = df.assign(__calm=~hit).sort_values(["__at", "__calm"], kind="mergesort")
        timed = df["__at"].notna()
        untimed, df = df[~timed & ~df["__calm"]], df[timed]
        was, at, last = held.get if held.exists else (False, None, None)
        late = df["__at"] < at if at is not None else pd.Series(False, index=df.index)
        out = [untimed]
        old, new = df[late], df[~late]
        if len(old) and not was:
            out.append(old[~old["__calm"] & old["__calm"].shift(fill_value=True)])
        if len(new):
            bad = ~new["__calm"]
            before = bad.shift(fill_value=bool(was))
            seen = new["__at"].where(bad).ffill().shift()
            seen = seen.fillna(last) if last is not None else seen
            out.append(new[bad & (~before | (new["__at"] - seen > limit))])
            times = new["__at"][bad]
            held.update((bool(bad.iloc[-1]), int(new["__at"].iloc[-1]), int(times.iloc[-1]) if len(times) else last))
        yield pd.concat(out)[columns]

    return rows.groupBy(*key).applyInPandasWithState(step, metrics.schema, state, "append", "NoTimeout")


_RANK = {"live": 0, "delayed": 1, "stale": 2, "invalid": 3}


def _sticky_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], kind="mergesort")
    held = state.get[0] if state.exists else ""
    quality = rows["quality"].where(rows["quality"].isin(list(_RANK)), "invalid")
    bad = quality.isin(["stale", "invalid"])
    heal = (rows["quality"] == "live") & rows["is_snapshot"].fillna(False).astype(bool)
    mark = pd.Series([None] * len(rows), index=rows.index, dtype=object)
    mark[bad] = quality[bad]
    mark[heal] = "ok"
    mark = mark.ffill().fillna(held or "ok")
    rows["effective_quality"] = rows["quality"].where(mark == "ok", mark)
    last = mark.iloc[-1]
    state.update(("" if last == "ok" else last,))
    yield rows


def sticky_quality_stream(events: DataFrame, by: str = "instrument") -> DataFrame:
    """Streaming ``sticky_quality``: one short mark of state per instrument. Rows of a micro-batch are
    taken in (ts, seq) order; ``events`` has ts, seq, quality and is_snapshot."""
    out = T.StructType([*events.schema.fields, T.StructField("effective_quality", T.StringType())])
    state = T.StructType([T.StructField("mark", T.StringType())])
    return events.groupBy(by).applyInPandasWithState(_sticky_state, out, state, "append", "NoTimeout")


def run_to_table(df: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Drain everything available into a Parquet table with its checkpoint beside it."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_each_batch(df: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a batch operator on every micro-batch: where a stream itself cannot (windows over rows, as-of
    joins, the risk gate). ``step`` must tolerate a repeated batch, as ``append_audit`` does."""
    query = df.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
