"""Stateful streams with event-time timers: rows of a key in order of event time, whatever the order of arrival.

Rows wait in their cell's state until the watermark has passed them. Timers then hand them on, sorted, with a small memory of each key, and wake
the cell again when it asked for that. So a result may be due to time alone: a feed that went silent, a signal nobody decided.

A key's rows are taken by one task, as any ordered fold must, and many keys share a cell of state, so that a key costs no calls of its own; state holds
what arrived within the watermark's delay and the memory. Rows whose key is NULL only tell the time (a clock stream may be unioned in). Rows without a time never become final: quarantine them first. Rows later than the delay are dropped by the
watermark. State lives in RocksDB, which these streams switch on for the session.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from marketops.functions.timing import micros, us

AT = "event_us"  # (a leading underscore would be renamed on the way)
#: (rows of a cell of keys in order, memory by key, watermark in µs) -> (rows out, memory by key, instant to be woken at or None)
CellStep = Callable[[pd.DataFrame, dict, int], tuple[pd.DataFrame | None, dict, int | None]]


#: Keys are dealt to so many cells; state and timers are kept per cell, so their cost does not grow with the number of keys.
CELLS = 256
CELL = "cell_of_keys"


class InOrder(StatefulProcessor):
    def __init__(self, step: CellStep, by: Sequence[str], order: Sequence[str], columns: Sequence[str]):
        self.step, self.by, self.order, self.columns = step, list(by), list(order), list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.memory = handle.getValueState("memory", "value BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for df in rows:
            df = df[df[AT].notna() & df[self.by].notna().any(axis=1)].drop(columns=CELL)
            if len(df):
                self.waiting.appendValue((pickle.dumps(df),))
                last = max(int(df[AT].max()), last or 0)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [pickle.loads(blob) for (blob,) in self.waiting.get()]
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=self.columns)
        ready = rows[AT] <= now if len(rows) else pd.Series(False, index=rows.index)
        if ready.any():
            rest = rows[~ready]
            if len(rest):
                self.waiting.put([(pickle.dumps(rest),)])
            else:
                self.waiting.clear()
        memory = pickle.loads(self.memory.get()[0]) if self.memory.exists() else {}
        out, kept, wake = self.step(rows[ready].sort_values(self.order, kind="mergesort", ignore_index=True), memory, now)
        if kept:
            self.memory.update((pickle.dumps(kept),))
        elif memory or self.memory.exists():
            self.memory.clear()
        if wake is not None:
            self.handle.registerTimer(wake // 1000 + 1)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def in_order(df: DataFrame, by: Sequence[str], ts: str, delay: str, order: Sequence[str], out: T.StructType, step: CellStep) -> DataFrame:
    """Run ``step`` on the rows of a cell of keys in (ts, *order), once the watermark has passed them. A step sees the event time in µs as ``event_us``."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = df.withColumn(AT, us(ts)).withWatermark(ts, delay)
    celled = rows.withColumn(CELL, F.pmod(F.xxhash64(*by), F.lit(CELLS)).cast("int"))
    return celled.groupBy(CELL).transformWithStateInPandas(InOrder(step, by, [AT, *order], rows.columns), out, "append", "eventTime")


def keys_of(rows: pd.DataFrame, by: Sequence[str]) -> pd.Series:
    """One value per row that tells its key."""
    if len(by) == 1:
        return rows[by[0]].astype(object).where(rows[by[0]].notna(), None)
    clean = [rows[c].astype(object).where(rows[c].notna(), None) for c in by]
    return pd.Series(list(zip(*clean, strict=True)), index=rows.index, dtype=object)


_RANK = ("live", "delayed", "stale", "invalid")


def sticky_quality(events: DataFrame, delay: str, by: str = "instrument") -> DataFrame:
    """``quality.sticky_quality`` on a stream: rows (ts, seq, quality, is_snapshot) come out once final, with ``effective_quality``.

    The memory is one mark per instrument.
    """
    columns = events.columns

    def step(rows, known, now):
        if not len(rows):
            return None, known, None
        quality = rows["quality"].where(rows["quality"].isin(_RANK), "invalid")
        bad = quality.isin(["stale", "invalid"])
        heal = (rows["quality"] == "live") & rows["is_snapshot"].fillna(False).astype(bool)
        keys = keys_of(rows, [by])
        marks = pd.Series([None] * len(rows), index=rows.index, dtype=object).mask(bad, quality).mask(heal, "ok")
        before = pd.Series([known.get(k, "ok") for k in keys], index=rows.index, dtype=object)
        marks = marks.groupby(keys, sort=False).ffill().fillna(before)
        out = rows[columns].assign(effective_quality=rows["quality"].where(marks == "ok", marks))
        known = {k: m for k, m in (known | dict(zip(keys, marks, strict=True))).items() if m != "ok"}
        return out, known, None

    schema = T.StructType([*events.schema.fields, T.StructField("effective_quality", T.StringType())])
    return in_order(events, [by], "ts", delay, ["seq"], schema, step)


def silences(events: DataFrame, limit: str, delay: str, feed: Sequence[str], ts: str = "event_ts") -> DataFrame:
    """Each silence longer than ``limit``: a row (feed, from_ts, NULL) when the limit has passed without an event, even if none ever follows, and a
    row (feed, from_ts, to_ts) when the feed is back.

    Before rows are dealt by feed, each task keeps the first and last event of each feed and bucket of the limit's width: nothing longer
    than the limit lies within a bucket, so a hot feed sends few rows.
    """
    width = micros(limit)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            bucket = us_of(df[ts]) // width
            grouped = df.groupby([*[df[c] for c in feed], bucket], dropna=False, sort=False)[ts]
            for found in (grouped.min(), grouped.max()):
                yield found.rename_axis([*feed, "bucket"]).reset_index()[[*feed, ts]].astype({c: object for c in feed})

    timed = events.select(*feed, ts)
    few = timed.mapInPandas(ends, timed.schema)

    def step(rows, memory, now):
        memory, out = dict(memory), []
        for key, at in zip(zip(*(keys_of(rows, [c]) for c in feed), strict=True), rows[AT].astype("int64").tolist(), strict=True):
            last, told = memory.get(key, (None, False))
            if last is not None and at - last > width:
                if not told:
                    out.append((*key, last, None))
                out.append((*key, last, at))
            if last is None or at > last:
                memory[key] = (at, False)
        for key, (last, told) in memory.items():
            if not told and now - last > width:
                out.append((*key, last, None))
                memory[key] = (last, True)
        frame = pd.DataFrame(out, columns=[*feed, "from_us", "to_us"]).astype({"from_us": "Int64", "to_us": "Int64"}) if out else None
        return frame, memory, min((last + width for last, told in memory.values() if not told), default=None)

    kinds = {f.name: f for f in events.schema.fields}
    schema = T.StructType([*[kinds[c] for c in feed], T.StructField("from_us", T.LongType()), T.StructField("to_us", T.LongType())])
    found = in_order(few, feed, ts, delay, [], schema, step)
    return found.select(*feed, F.timestamp_micros("from_us").alias("from_ts"), F.timestamp_micros("to_us").alias("to_ts"))


def us_of(times: pd.Series) -> pd.Series:
    return pd.Series(times.to_numpy().astype("datetime64[us]").astype(np.int64), index=times.index)


def undecided(signals: DataFrame, decisions: DataFrame, timeout: str, delay: str, keep: str = "30 days") -> DataFrame:
    """(signal_id, ts, cause): signals without a decision from their time on within the timeout, reported when it is over as ``missing``, and once more as
    ``late`` if a decision comes within ``keep`` after it. To risk both are rejections. Memory of a signal ends when it is decided, or with ``keep``.
    """
    limit, forget = micros(timeout), micros(timeout) + micros(keep)
    s = signals.select("signal_id", F.col("ts").alias("ts"), F.lit(0).alias("kind"))
    d = decisions.select("signal_id", F.col("ts").alias("ts"), F.lit(1).alias("kind"))

    def step(rows, memory, now):
        # Rows come in order of time, so a decision met before its signal was made before it.
        memory, out = dict(memory), []
        for key, at, kind in zip(keys_of(rows, ["signal_id"]), rows[AT].astype("int64").tolist(), rows["kind"].tolist(), strict=True):
            asked, told = memory.get(key, (None, False))
            if kind == 0:
                memory[key] = (at if asked is None else asked, told)
            elif asked is not None:
                if at - asked > limit:
                    out += [(key, asked, cause) for cause in (("late",) if told else ("missing", "late"))]
                del memory[key]
        wake = None
        for key, (asked, told) in list(memory.items()):
            if not told and now - asked > limit:
                out.append((key, asked, "missing"))
                told = True
                memory[key] = (asked, told)
            if now - asked > forget:
                del memory[key]
            else:
                due = asked + (forget if told else limit)
                wake = due if wake is None else min(wake, due)
        return pd.DataFrame(out, columns=["signal_id", "at", "cause"]) if out else None, memory, wake

    schema = T.StructType([T.StructField("signal_id", T.StringType()), T.StructField("at", T.LongType()), T.StructField("cause", T.StringType())])
    found = in_order(s.unionByName(d), ["signal_id"], "ts", delay, ["kind"], schema, step)
    return found.select("signal_id", F.timestamp_micros("at").alias("ts"), "cause")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], delay: str, tie: str = "seq", prefix: str = "asof_") -> DataFrame:
    """``joins.asof_join`` of two streams: each left row, once final, with the latest right row at or before it, whose columns get the prefix.

    The memory is one right row per key, so a micro-batch reads nothing of the past but that row; older right rows are gone when the
    watermark has passed the next one. Left rows of any number may wait for a key; none is paired with more than one row.
    """
    lcols, rcols = [c for c in left.columns if c not in by], [c for c in right.columns if c not in by]
    lnames, rnames = [f"l_{c}" for c in lcols], [f"r_{c}" for c in rcols]
    ltypes, rtypes = ({f.name: f.dataType for f in df.schema.fields} for df in (left, right))
    both = left.select(*by, F.col("ts").alias("ts"), F.lit(1).alias("side"), F.lit(None).cast(rtypes[tie]).alias("place"), *[F.col(c).alias(n) for c, n in zip(lcols, lnames, strict=True)]).unionByName(
        right.select(*by, F.col("ts").alias("ts"), F.lit(0).alias("side"), F.col(tie).alias("place"), *[F.col(c).alias(n) for c, n in zip(rcols, rnames, strict=True)]), allowMissingColumns=True)
    names = [*by, *lnames, *rnames]

    def step(rows, memory, now):
        if not len(rows):
            return None, memory, None
        is_right = rows["side"] == 0
        keys = keys_of(rows, by)
        # Where each row's latest right row of its key stands.
        at = pd.Series(np.arange(len(rows)), index=rows.index).where(is_right).groupby(keys, sort=False, dropna=False).ffill()
        asks = ~is_right
        source, told = at[asks].tolist(), [memory.get(k) for k in keys[asks]]
        out = rows.loc[asks, [*by, *lnames]].reset_index(drop=True)
        for place, n in enumerate(rnames):
            values = rows[n].to_numpy(dtype=object)
            out[n] = pd.Series([values[int(i)] if i == i else m[place] if m else None for i, m in zip(source, told, strict=True)], dtype=object)
        newest = rows[is_right].drop_duplicates(subset=list(by), keep="last")
        memory = memory | dict(zip(keys_of(newest, by), newest[rnames].itertuples(index=False, name=None), strict=True))
        return out[names], memory, None

    schema = T.StructType([*[T.StructField(c, ltypes[c]) for c in by], *[T.StructField(n, ltypes[c]) for c, n in zip(lcols, lnames, strict=True)], *[T.StructField(n, rtypes[c]) for c, n in zip(rcols, rnames, strict=True)]])
    found = in_order(both, by, "ts", delay, ["side", "place"], schema, step)
    return found.select(*by, *[F.col(n).alias(c) for c, n in zip(lcols, lnames, strict=True)], *[F.col(n).alias(f"{prefix}{c}") for c, n in zip(rcols, rnames, strict=True)])
