"""Replay parity and walk-forward evaluation as column arithmetic over stored events."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.timing import bucket, micros, shift, us
from marketops.functions.windows import running
from marketops.operators.features import mid_spread
from marketops.operators.joins import asof_join, param_grid
from marketops.operators.portfolio import difference
from marketops.session import materialize


def replay_parity(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Rows that only one of two runs produced, with multiplicity; empty when the replay is identical.

    Maps compare by their sorted entries.
    """
    maps = [f.name for f in run_a.schema.fields if f.dataType.typeName() == "map"]

    def plain(df: DataFrame) -> DataFrame:
        return df.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps}) if maps else df

    return difference(plain(run_a), plain(run_b), "run_a", "run_b")


def simulated_receive_order(events: DataFrame, latency: str | int = 0, tie: Sequence[str] = ("venue", "channel", "instrument", "seq")) -> DataFrame:
    """Events in the order a consumer would have received them, with added latency."""
    out = events.withColumn("available_at", shift("receipt_ts", micros(latency)))
    return out.orderBy("available_at", *tie)


def evaluate_signals(signals: DataFrame, snapshots: DataFrame, fee_bps: float, slippage_bps: float, tolerance: str | int, funding: DataFrame | None = None,
                     latency: str | int = 0, participation: float = 1.0, width: str = "1 day") -> DataFrame:
    """Return of each signal net of fees, half-spread, slippage and funding.

    Entry is the quote known ``latency`` after the signal, exit the one known at the horizon's end plus
    ``latency``, neither older than ``tolerance``. A signal with an entry but no such exit is ``censored``. Funding is the sum of the rates of
    ``funding(instrument, ts, rate)`` after entry and up to exit; longs pay positive ones. The filled share is capped by ``participation`` of the volume quoted at entry when the
    signals carry ``quantity``. Where a price, or that volume, is unknown, so are the results.
    """
    delay = micros(latency)
    quotes = mid_spread(snapshots).select("instrument", "ts", "seq", "mid", "spread_bps", "volume")
    timed = signals.withColumns({"__in_at": shift("ts", delay), "__out_at": shift("ts", F.col("horizon_us") + delay)})
    entered = asof_join(timed, quotes, ["instrument"], on="__in_at", right_on="ts", tolerance=tolerance, width=width, name="__in")
    left = asof_join(entered, quotes, ["instrument"], on="__out_at", right_on="ts", tolerance=tolerance, width=width, name="__out")
    due = F.lit(0.0)
    if funding is not None:
        summed = running(funding, ["instrument"], ["ts"], bucket("ts", width), {"paid": ("sum", F.col("rate"))}).select("instrument", "ts", "paid")
        rates = materialize(summed)
        for at in ("__in", "__out"):
            left = asof_join(left, rates, ["instrument"], on=f"{at}_at", right_on="ts", tie=("ts",), width=width, name=f"{at}_rate")
        due = F.coalesce("__out_rate.paid", F.lit(0)).cast("double") - F.coalesce("__in_rate.paid", F.lit(0)).cast("double")
    sign = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1)
    start, end = F.col("__in.mid").cast("double"), F.col("__out.mid").cast("double")
    half_spreads = (F.greatest(F.col("__in.spread_bps"), F.lit(0.0)) + F.greatest(F.col("__out.spread_bps"), F.lit(0.0))) / 2
    # A spread that cannot be told has no cost, so the row has none; ``greatest`` would skip it.
    cost_bps = F.when(start.isNotNull() & end.isNotNull(), F.lit(2 * (fee_bps + slippage_bps)) + half_spreads)
    out = left.withColumn("gross", sign * (end - start) / F.nullif(start, F.lit(0.0))).withColumn("cost", cost_bps / 10_000 + sign * due)
    out = out.withColumn("censored", start.isNotNull() & end.isNull())
    if "quantity" in signals.columns:
        share = F.col("__in.volume").cast("double") * participation / F.nullif(F.col("quantity").cast("double"), F.lit(0.0))
        ratio = F.when(share.isNotNull(), F.least(F.lit(1.0), share))
    else:
        ratio = F.lit(1.0)
    out = out.withColumn("fill_ratio", ratio).withColumn("net", (F.col("gross") - F.col("cost")) * F.col("fill_ratio"))
    return out.drop("__in", "__out", "__in_at", "__out_at", "__in_rate", "__out_rate")


def walk_forward_folds(start: str, train: str | int, test: str | int, embargo: str | int, folds: int) -> dict[str, int | str]:
    """Time-ordered folds: each trains on ``train``, waits ``embargo``, tests on ``test``, then rolls by ``test``."""
    return {"start": start, "train": micros(train), "test": micros(test), "embargo": micros(embargo), "folds": folds}


def fold_table(df: DataFrame, plan: Mapping[str, int | str]) -> DataFrame:
    """The folds as rows (fold, role, from_ts, to_ts)."""
    step, t0 = plan["test"], us(F.lit(plan["start"]))
    base = df.sparkSession.range(plan["folds"]).select(F.col("id").cast("int").alias("fold"), (t0 + F.col("id") * step).alias("a"))
    test_from = F.col("a") + plan["train"] + plan["embargo"]
    spans = F.array(
        F.struct(F.lit("train").alias("role"), F.col("a").alias("x"), (F.col("a") + plan["train"]).alias("y")),
        F.struct(F.lit("test").alias("role"), test_from.alias("x"), (test_from + step).alias("y")),
    )
    return base.select("fold", F.inline(spans)).select("fold", "role", F.timestamp_micros("x").alias("from_ts"), F.timestamp_micros("y").alias("to_ts"))


def assign_folds(df: DataFrame, plan: Mapping[str, int | str], ts: str = "ts") -> DataFrame:
    """Each row once per fold and role it belongs to, computed from its time alone: no join.

    A row repeats at most train/test + 2 times.
    """
    at = us(ts) - us(F.lit(plan["start"]))
    step, train, gap, n = plan["test"], plan["train"], plan["embargo"], plan["folds"]
    first = F.greatest(F.floor((at - train) / step).cast("int") + 1, F.lit(0))
    last = F.least(F.floor(at / step).cast("int"), F.lit(n - 1))
    training = F.when((at >= 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tested = F.floor((at - train - gap) / step).cast("int")
    testing = F.when((tested >= 0) & (tested < n), F.array(tested)).otherwise(F.array().cast("array<int>"))

    def role(folds: Column, name: str) -> Column:
        return F.transform(folds, lambda f: F.struct(f.alias("fold"), F.lit(name).alias("role")))

    return df.select("*", F.inline(F.concat(role(training, "train"), role(testing, "test"))))


def parameter_sweep(evaluated: DataFrame, grid: Sequence[Mapping[str, float | int | str]], plan: Mapping[str, int | str],
                    rule: Callable[[Column], Column], seed: int, value: str = "net") -> DataFrame:
    """One row of metrics per parameter set, fold and role; the grid and the seed are part of the row. Sets that trade
    nothing in a fold have ``n`` = 0 and NULL metrics.

    ``rule`` maps the ``params`` struct to the rows a set would trade. Rows fan out inside one stage
    and are summed there, so the shuffle carries one row per task, set and fold.
    """
    tried = param_grid(assign_folds(evaluated.where(F.col(value).isNotNull()), plan), grid)
    kept = tried.where(F.coalesce(rule(F.col("params")), F.lit(False)))
    v = F.col(value)
    every = param_grid(fold_table(evaluated, plan).select("fold", "role"), grid).select(F.col("params.param_id").alias("param_id"), "params", "fold", "role")
    traded = (
        kept.groupBy(F.col("params.param_id").alias("param_id"), "fold", "role")
        .agg(
            F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("vol"), F.avg((v > 0).cast("double")).alias("hit_rate"),
            F.sum(v).alias("total"),
        )
    )
    return (
        every.join(traded, ["param_id", "fold", "role"], "left")
        .select("params.*", "fold", "role", F.coalesce("n", F.lit(0)).alias("n"), "mean", "vol", (F.col("mean") / F.nullif(F.col("vol"), F.lit(0.0))).alias("sharpe"), "hit_rate", "total",
                F.lit(seed).alias("seed"))
    )


def robust_selection(sweep: DataFrame, params: Sequence[str]) -> DataFrame:
    """Rank parameter sets by out-of-sample evidence: mean test Sharpe, less its spread over folds, less
    the decay from training, less the distance to the neighbouring sets. The best in-sample result
    alone never wins. The sweep holds one row per set, fold and role, so these windows stay small.

    ``params`` are the grid's columns. Neighbours of a set differ from it by one step of one parameter along the values that occur; a set names
    the coordinates of its neighbours, and an equi join on them finds those that were tried.
    """
    train, test = F.col("role") == "train", F.col("role") == "test"
    per = sweep.groupBy("param_id").agg(
        F.avg(F.when(test, F.col("sharpe"))).alias("oos"), F.coalesce(F.stddev_samp(F.when(test, F.col("sharpe"))), F.lit(0.0)).alias("spread"),
        F.min(F.when(test, F.col("sharpe"))).alias("worst"), F.avg(F.when(train, F.col("sharpe"))).alias("ins"),
    )
    per = materialize(per)
    placed = sweep.select("param_id", *params).distinct()
    for name in params:
        axis = placed.select(name).distinct().withColumn(f"__at_{name}", F.row_number().over(Window.orderBy(name)))
        placed = placed.join(axis, name)
    placed = materialize(placed.select("param_id", *[f"__at_{name}" for name in params]).join(per.select("param_id", F.col("oos").alias("v")), "param_id"))
    steps = [F.struct(*[(F.col(f"__at_{n}") + (step if n == name else 0)).alias(f"__at_{n}") for n in params]) for name in params for step in (1, -1)]
    told = placed.select("v", F.explode(F.array(*steps)).alias("__at")).select("v", "__at.*")
    near = placed.drop("v").join(told, [f"__at_{name}" for name in params]).groupBy("param_id").agg(F.avg("v").alias("neighbours"))
    joined = per.join(near, "param_id", "left")
    instability = F.coalesce(F.abs(F.col("oos") - F.col("neighbours")), F.lit(0.0))
    decay = F.greatest(F.coalesce(F.col("ins") - F.col("oos"), F.lit(0.0)), F.lit(0.0))
    scored = joined.select("param_id", "oos", "spread", "worst", decay.alias("decay"), instability.alias("instability"),
                           (F.col("oos") - F.col("spread") - decay - instability).alias("score"))
    order = Window.orderBy(F.desc_nulls_last("score"), "param_id")
    return scored.withColumn("rank", F.row_number().over(order))


def performance_metrics(returns: DataFrame, by: Sequence[str], value: str = "net", traded: str | None = None, order: Sequence[str] = ("ts", "signal_id"),
                        width: str | int = "1 day", periods: float = 1.0) -> DataFrame:
    """Mean, volatility, Sharpe-type ratio, hit rate, profit factor, largest fall of the summed returns
    and turnover per group."""
    v = F.col(value)
    keep = dict.fromkeys([*by, *order, value, *([traded] if traded else [])])
    rows = materialize(returns.where(v.isNotNull()).select(*keep))
    cum = materialize(running(rows, by, order, bucket(order[0], width), {"__c": ("sum", v)}))
    peak = running(cum, by, order, bucket(order[0], width), {"__p": ("max", "__c")})
    # The starting point, before any return, is a peak too.
    fall = F.greatest(F.col("__p"), F.lit(0.0)) - F.col("__c")
    gains, losses = F.sum(F.when(v > 0, v)), F.sum(F.when(v < 0, -v))
    turnover = F.sum(F.abs(F.col(traded))) if traded else F.count("*") * 2
    return peak.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("vol"),
        (F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe"),
        F.avg((v > 0).cast("double")).alias("hit_rate"), (gains / F.nullif(losses, F.lit(0.0))).alias("profit_factor"),
        F.max(fall).alias("max_dd"), turnover.cast("double").alias("turnover"),
    )
