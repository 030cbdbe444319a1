"""Point-in-time, lineage, reconciliation and policy joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketops.functions.reasons import not_ok
from marketops.functions.timing import bucket, micros, us
from marketops.functions.windows import running, scan
from marketops.schemas import PRICE
from marketops.session import materialize


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str = "ts",
    right_on: str | None = None,
    tie: Sequence[str] = ("seq",),
    tolerance: str | int | None = None,
    direction: str = "backward",
    strict: bool = False,
    width: str | int = "1 hour",
    name: str = "asof",
) -> DataFrame:
    """Each left row with the latest right row at or before it (``forward``: earliest at or after).

    The right row arrives as the struct ``name``, NULL where none lies within ``tolerance``. Among
    right rows of one instant the highest ``tie`` counts backward, the lowest forward. ``strict``
    leaves out right rows of the same instant. As in SQL, a NULL key or time matches nothing. One union and one segmented window, so a hot key is
    spread over its time buckets of ``width``; no pairs of rows are ever formed.
    """
    right_on = right_on or on
    back = direction == "backward"
    # Walking towards the left row, right rows of the same instant come first unless strict.
    right_first = back != strict
    lcols = F.struct(*left.columns)
    rcols = F.struct(*right.columns)
    tie_type = right.select(F.struct(*tie).alias("t")).schema["t"].dataType
    dated = F.col(right_on).isNotNull()
    for c in by:
        dated = dated & F.col(c).isNotNull()
    rows = left.select(
        *by, F.col(on).cast("timestamp").alias("__ts"), F.lit(1 if right_first else 0).alias("__side"),
        F.lit(None).cast(tie_type).alias("__tie"), lcols.alias("__left"),
    ).unionByName(
        right.where(dated).select(
            *by, F.col(right_on).cast("timestamp").alias("__ts"), F.lit(0 if right_first else 1).alias("__side"),
            F.struct(*tie).alias("__tie"), rcols.alias("__right"),
        ),
        allowMissingColumns=True,
    )
    found = scan(
        rows, by, ["__ts", "__side", "__tie"], bucket("__ts", width), {name: ("last", "__right")}, reverse=not back, wanted=F.col("__left").isNotNull()
    )
    known = F.col("__ts").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    match = F.when(known, F.col(name))
    if tolerance is not None:
        gap = us(match[right_on]) - us("__ts")
        match = F.when((-gap if back else gap) <= micros(tolerance), match)
    return found.select("__left.*", match.alias(name))


def signal_lineage(signals: DataFrame, decisions: DataFrame, requests: DataFrame, fills: DataFrame) -> DataFrame:
    """signal -> decision -> request -> fills, keeping signals that stop early.

    Joined from the fills back, so no join ever meets a NULL key and no task collects them.
    """
    s = signals.select("signal_id", "instrument", "strategy_id", F.col("ts").alias("signal_ts"))
    d = decisions.select("signal_id", "decision_id", "approved", F.col("ts").alias("decision_ts"))
    r = requests.select(
        F.col("risk_decision_id").alias("decision_id"), "request_id", "client_order_id", F.col("ts").alias("request_ts")
    )
    f = fills.groupBy("client_order_id").agg(
        F.count("*").alias("fills"), F.sum("qty").alias("filled"), F.min("ts").alias("first_fill_ts"), F.max("ts").alias("last_fill_ts")
    )
    filled = r.join(f, "client_order_id", "left")
    decided = d.join(filled, "decision_id", "left")
    return s.join(decided, "signal_id", "left")


def missing_decisions(signals: DataFrame, decisions: DataFrame, timeout: str | int) -> DataFrame:
    """Signals without a decision inside the timeout; to risk they count as rejected."""
    first = decisions.groupBy("signal_id").agg(F.min("ts").alias("__decided"))
    late = us("__decided") - us("ts") > micros(timeout)
    joined = signals.join(first, "signal_id", "left")
    why = F.when(F.col("__decided").isNull(), "missing").when(late, "late")
    return joined.withColumn("cause", why).where(F.col("cause").isNotNull()).drop("__decided")


def authorize_requests(requests: DataFrame, decisions: DataFrame, max_age: str | int) -> DataFrame:
    """Whether each request may act on its decision, with every reason why not.

    The decision's direction is the one of its signal, so ``decisions`` carries ``direction``.
    A decision is consumed by its first request in (ts, request_id) order.
    """
    d = decisions.select(
        F.col("decision_id").alias("risk_decision_id"), F.col("ts").alias("__dts"), F.col("approved").alias("__approved"),
        F.col("instrument").alias("__instrument"), F.col("quantity").alias("__quantity"), F.col("direction").alias("__direction"),
    )
    first = requests.groupBy("risk_decision_id").agg(F.min(F.struct("ts", "request_id")).alias("__first"))
    joined = requests.join(d, "risk_decision_id", "left").join(first, "risk_decision_id", "left")
    age = us("ts") - us("__dts")
    side = F.when(F.col("__direction") == "long", "buy").when(F.col("__direction") == "short", "sell")
    ok = {
        "decision_missing": F.col("__dts").isNotNull(),
        "decision_stale": age.between(0, micros(max_age)),
        "decision_rejected": F.col("__approved"),
        "instrument_mismatch": F.col("instrument") == F.col("__instrument"),
        "side_mismatch": (F.col("side") == side) != F.coalesce(F.col("reduce_only"), F.lit(False)),
        "already_consumed": F.col("request_id") == F.col("__first.request_id"),
        "quantity_above_approved": F.col("quantity") <= F.col("__quantity"),
    }
    out = joined.withColumn("reasons", not_ok(ok)).withColumn("authorized", F.size("reasons") == 0)
    return out.select(*requests.columns, "authorized", "reasons")


def reconcile(local: DataFrame, venue: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float | Decimal = 0) -> DataFrame:
    """Full outer comparison of two keyed tables: match, differs, only_local or only_venue per key.

    Numbers may differ by ``tolerance``; anything else must be equal, NULL only to NULL.
    """
    numeric = {f.name for f in local.schema.fields if f.dataType.typeName() in ("decimal", "double", "float", "long", "integer", "short")}
    a = local.select(*keys, F.struct(*values).alias("local"))
    b = venue.select(*keys, F.struct(*values).alias("venue"))
    joined = a.join(b, list(keys), "full_outer")
    same = F.lit(True)
    for name in values:
        x, y = F.col(f"local.{name}"), F.col(f"venue.{name}")
        equal = x.eqNullSafe(y)
        if name in numeric and tolerance:
            equal = equal | F.coalesce(F.abs(x - y) <= F.lit(tolerance), F.lit(False))
        same = same & equal
    status = (
        F.when(F.col("venue").isNull(), "only_local").when(F.col("local").isNull(), "only_venue").when(same, "match").otherwise("differs")
    )
    return joined.select(*keys, status.alias("status"), "local", "venue")


def reconcile_book(parts: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str], Sequence[str]]], tolerance: float | Decimal = 0) -> DataFrame:
    """(kind, id, status) of everything on which local and venue records differ: open orders, fills, balances, positions.

    Each part is (local, venue, keys, values). A row of any kind keeps the runtime out of READY; ``only_venue`` orders are the unknown
    external ones that need an operator.
    """
    out = None
    for kind, (local, venue, keys, values) in parts.items():
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
        found = reconcile(local, venue, keys, values, tolerance).where("status <> 'match'").select(F.lit(kind).alias("kind"), key.alias("id"), "status")
        out = found if out is None else out.unionByName(found)
    return out


def reconciliation_passed(result: DataFrame) -> DataFrame:
    """One row: how many keys differ and whether new exposure may resume."""
    bad = F.count(F.when(F.col("status") != "match", 1))
    return result.agg(F.count("*").alias("n_keys"), bad.alias("differences"), (bad == 0).alias("passed"))


def covered_by(
    df: DataFrame, spans: DataFrame, by: Sequence[str], start: str, end: str, on: str = "ts", width: str | int = "1 day", flag: str = "covered"
) -> DataFrame:
    """Flag rows that lie in any interval [start, end) of the same key; an open end is NULL.

    A row is inside some interval exactly when the latest end among the intervals already begun lies
    after it, so even overlapping intervals need no range join. A NULL key, time or start lies in none.
    """
    forever = F.lit("9999-12-31").cast("timestamp")
    rows = df.select(*by, F.col(on).cast("timestamp").alias("__ts"), F.lit(1).alias("__side"), F.struct(*df.columns).alias("__left"))
    dated = F.col(start).isNotNull()
    for c in by:
        dated = dated & F.col(c).isNotNull()
    begun = spans.where(dated).select(
        *by, F.col(start).cast("timestamp").alias("__ts"), F.lit(0).alias("__side"),
        F.coalesce(F.col(end).cast("timestamp"), forever).alias("__to"),
    )
    both = rows.unionByName(begun, allowMissingColumns=True)
    seen = running(both, by, ["__ts", "__side"], bucket("__ts", width), {"__until": ("max", "__to")})
    inside = F.coalesce(F.col("__until") > F.col("__ts"), F.lit(False))
    return seen.where(F.col("__left").isNotNull()).select("__left.*", inside.alias(flag))


def point_in_time_members(
    df: DataFrame, membership: DataFrame, on: str = "ts", width: str | int = "1 day", keep_all: bool = False
) -> DataFrame:
    """Rows whose instrument was a member at that time (``keep_all``: every row, flagged ``member``)."""
    out = covered_by(df, membership, ["instrument"], "valid_from", "valid_to", on, width, "member")
    return out if keep_all else out.where("member").drop("member")


def policy_join(df: DataFrame, policy: DataFrame, scopes: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """Attach each named policy value; the first scope listed (the most specific) that sets it wins.

    ``policy(scope, key, name, value)`` is unique per scope, key and name. Each scope is one equi join;
    Spark broadcasts the policy where its size allows and sorts and merges otherwise.
    """
    out, lookups = df, {name: [] for name in names}
    for i, (scope, column) in enumerate(scopes.items()):
        picks = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"__p{i}_{j}") for j, n in enumerate(names)]
        side = policy.where((F.col("scope") == scope) & F.col("name").isin(*names)).groupBy(F.col("key").alias(f"__k{i}")).agg(*picks)
        out = out.join(side, F.col(column) == F.col(f"__k{i}"), "left")
        for j, n in enumerate(names):
            lookups[n].append(F.col(f"__p{i}_{j}"))
    return out.select(*df.columns, *[F.coalesce(*cols).alias(n) for n, cols in lookups.items()])


def search_at_or_below(values: np.ndarray, begin: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Index of the first value at or after ``begin`` that is <= ``goal``, or -1; all searches at once.

    A pyramid of pairwise minima is climbed and descended, so one search costs a logarithm.
    """
    top = np.iinfo("int64").max
    tiers = [values]
    while len(tiers[-1]) > 1:
        low = tiers[-1]
        tiers.append(np.minimum(low[0::2], np.append(low[1::2], top)[: len(low[0::2])]))
    sizes = np.array([len(t) for t in tiers])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(tiers)
    node, tier = begin.copy(), np.zeros(len(begin), dtype="int64")
    hit = np.zeros(len(begin), dtype=bool)
    live = np.flatnonzero(node < len(values))
    while len(live):
        good = flat[starts[tier[live]] + node[live]] <= goal[live]
        hit[live[good]] = True
        live = live[~good]
        node[live] += 1
        climb = live[node[live] % 2 == 0]
        node[climb] //= 2
        tier[climb] += 1
        live = live[tier[live] < len(tiers)]
        live = live[node[live] < sizes[tier[live]]]
    falling = np.flatnonzero(hit & (tier > 0))
    while len(falling):
        tier[falling] -= 1
        node[falling] *= 2
        node[falling] += flat[starts[tier[falling]] + node[falling]] > goal[falling]
        falling = falling[tier[falling] > 0]
    return np.where(hit, node, -1)


def sorted_keys(ticks: pd.DataFrame, asks: pd.DataFrame, width_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ticks' order by (instrument, time, seq), and for each search the first tick after its start and
    the end of its ticks: those of its own instrument and bucket, no later than its ``until``."""
    codes, _ = pd.factorize(pd.concat([ticks["instrument"], asks["instrument"]]))
    n, start = len(ticks), asks["at"].to_numpy("int64")
    stop = np.minimum((asks["bucket"].to_numpy("int64") + 1) * width_us, asks["until"].to_numpy("int64") + 1)
    at = ticks["at"].to_numpy("int64")
    low = min(at.min(), start.min(), stop.min())
    span = max(at.max(), start.max(), stop.max()) - low + 2
    tick_keys = codes[:n] * span + (at - low)
    base = codes[n:] * span - low
    order = np.lexsort((ticks["seq"].to_numpy(), tick_keys))
    keys = tick_keys[order]
    begin = np.searchsorted(keys, base + start, side="right")
    end = np.searchsorted(keys, base + stop, side="left")
    return order, begin, np.maximum(begin, end)


def range_max(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest of ``values[begin:end]`` for many ranges at once; -inf where a range is empty."""
    out = np.full(len(begin), -np.inf)
    size = end - begin
    row, reach = values, 1
    while reach <= len(values):
        mine = (size >= reach) & (size < 2 * reach)
        out[mine] = np.maximum(row[begin[mine]], row[end[mine] - reach])
        row = np.maximum(row[:-reach], row[reach:]) if len(row) > reach else row[:0]
        reach *= 2
    return out


def first_crossing(width_us: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """First price after each search start at or beyond its level, inside the search's bucket."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ticks, asks = group[group["signal_id"].isna()], group[group["signal_id"].notna()]
        hit = np.full(len(asks), -1, dtype="int64")
        if len(ticks) and len(asks):
            order, begin, end = sorted_keys(ticks, asks, width_us)
            at, price = ticks["at"].to_numpy("int64")[order], ticks["price"].to_numpy("int64")[order]
            level, long = asks["level"].to_numpy("int64"), asks["is_long"].to_numpy(bool)
            for side, sign in ((long, 1), (~long, -1)):
                place = search_at_or_below(sign * price, begin[side], sign * level[side])
                hit[side] = np.where((place >= 0) & (place < end[side]), at[place], -1)
        return pd.DataFrame({"signal_id": asks["signal_id"].to_numpy(), "hit_us": hit})

    return search


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no (instrument, bucket) group is split between two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = (batch["instrument"].iloc[-1], batch["bucket"].iloc[-1])
        same = ((batch["instrument"] == key[0]) & (batch["bucket"] == key[1])).to_numpy()
        cut = 0 if same.all() else len(same) - int(same[::-1].argmin())
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and (held[-1]["instrument"].iloc[-1], held[-1]["bucket"].iloc[-1]) != key:
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def bucket_search(asks: DataFrame, ticks: DataFrame, search: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 50_000) -> DataFrame:
    """Run a vectorised ``search`` over the ticks of each (instrument, bucket) together with its searches.

    Only ticks of buckets that are searched go to Python. A bucket with more than ``most`` searches is dealt in shares, each with the bucket's
    ticks. One shuffle by instrument, bucket and share; a task walks its sorted groups batch by batch and holds no
    more than one batch and one bucket of one instrument. The number of tasks is fixed because the work
    per row is Python's, which the size of the shuffled data does not show.
    """
    # Read twice, so written once.
    asks = materialize(asks.where(F.col("instrument").isNotNull()))
    shares = asks.groupBy("instrument", "bucket").agg(F.ceil(F.count("*") / most).cast("int").alias("__shares"))
    key = next(c for c in asks.columns if c.endswith("_id"))
    dealt = asks.join(shares, ["instrument", "bucket"]).withColumn("share", F.pmod(F.hash(key), F.col("__shares"))).drop("__shares")
    copied = ticks.join(shares, ["instrument", "bucket"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    pool = dealt.unionByName(copied, allowMissingColumns=True)
    tasks = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (search(group) for group in whole_groups(batches))

    return pool.repartition(tasks, "instrument", "bucket", "share").sortWithinPartitions("instrument", "bucket", "share").mapInPandas(run, schema)


def _units(price: str) -> Column:
    """A price as a whole number of its eighth decimal, exact in 64 bits."""
    return (F.col(price).cast(PRICE) * 100_000_000).cast("bigint")


def node_range(first: Column, last: Column) -> Column:
    """Bucket numbers first..last as an array, empty when there are none."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def extremes_tree(fine: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Per level the table (instrument, parent, kids): each parent's children with their lowest and highest value, in order.

    ``fine(instrument, node, lowest, highest)`` are the nodes of level 0. A parent holds ``fanout`` consecutive nodes; on the last level one root
    per instrument holds all, so that any span of time is covered.
    """
    tree, nodes = [], fine
    for level in range(levels):
        parent = F.floor(F.col("node") / fanout).cast("bigint") if level < levels - 1 else F.lit(0).cast("bigint")
        kids = nodes.groupBy("instrument", parent.alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "lowest", "highest"))).alias("kids"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
        tree.append(kids.select("instrument", "parent", "kids"))
        nodes = kids.select("instrument", F.col("parent").alias("node"), "lowest", "highest")
    return tree


def first_invalidation(signals: DataFrame, snapshots: DataFrame, width: str | int = "10 minutes", fanout: int = 36, levels: int = 3, price: str = "last") -> DataFrame:
    """First snapshot after the signal and within its horizon that crosses the invalidation level.

    Long signals are invalidated at or below the level, short ones at or above. The extremes of every instrument form a tree over buckets of
    ``width``. A signal looks once into each level on its way up, at the siblings behind its own node, takes the lowest level on which one crosses,
    and goes down from there, again one look a level: equi joins on unique keys, as many as twice the levels, however long the horizon is. Only its own bucket
    and the first crossing bucket are searched tick by tick.
    """
    width_us = micros(width)
    ticks = snapshots.select("instrument", bucket("ts", width).alias("bucket"), us("ts").alias("at"), "seq", _units(price).alias("price"))
    asks = signals.where(F.col("horizon_us") > 0).select(
        "signal_id", "instrument", us("ts").alias("at"), (us("ts") + F.col("horizon_us")).alias("until"),
        (F.col("direction") == "long").alias("is_long"), _units("invalidation_level").alias("level"), bucket("ts", width).alias("bucket"),
    )
    fine = ticks.groupBy("instrument", F.col("bucket").alias("node")).agg(F.min("price").alias("lowest"), F.max("price").alias("highest"))
    tree = extremes_tree(fine, fanout, levels)

    def crossing(kids: str, after: Column | None, last: Column | None) -> Column:
        """The first child behind ``after`` and up to ``last`` that crosses the level."""
        long, level = F.col("is_long"), F.col("level")

        def fits(kid: Column) -> Column:
            crosses = F.when(long, kid["lowest"] <= level).otherwise(kid["highest"] >= level)
            return crosses if after is None else crosses & (kid["node"] > after) & (kid["node"] <= last)

        return F.get(F.filter(kids, fits), F.lit(0))["node"]

    walk = asks.where(F.col("instrument").isNotNull()).withColumns({"end": F.floor(F.col("until") / width_us).cast("bigint"), "found": F.lit(None).cast("bigint"), "height": F.lit(None).cast("int")})
    columns = walk.columns
    for height, table in enumerate(tree):
        node, last = (F.floor(F.col(c) / fanout**height).cast("bigint") for c in ("bucket", "end"))
        parent = F.floor(node / fanout).cast("bigint") if height < levels - 1 else F.lit(0).cast("bigint")
        seen = walk.withColumn("parent", parent).join(table, ["instrument", "parent"], "left").withColumn("here", crossing("kids", node, last))
        new = F.col("found").isNull() & F.col("here").isNotNull()
        walk = seen.withColumns({"height": F.when(new, F.lit(height)).otherwise(F.col("height")), "found": F.coalesce("found", "here")}).select(*columns)
    for height in range(levels - 1, 0, -1):
        inner = F.col("height") == height
        seen = walk.withColumn("parent", F.when(inner, F.col("found"))).join(tree[height - 1], ["instrument", "parent"], "left").withColumn("here", crossing("kids", None, None))
        walk = seen.withColumns({"found": F.when(inner, F.col("here")).otherwise(F.col("found")), "height": F.when(inner, F.lit(height - 1)).otherwise(F.col("height"))}).select(*columns)
    later = walk.where(F.col("found").isNotNull()).select("signal_id", "instrument", (F.col("found") * width_us - 1).alias("at"), "until", "is_long", "level", F.col("found").alias("bucket"))
    hits = bucket_search(asks.unionByName(later), ticks, first_crossing(width_us), "signal_id string, hit_us long")
    first = hits.where("hit_us >= 0").groupBy("signal_id").agg(F.min("hit_us").alias("__hit"))
    inside = F.col("__hit") <= us("ts") + F.col("horizon_us")
    out = signals.join(first, "signal_id", "left")
    return out.withColumn("invalidated_at", F.when(inside, F.timestamp_micros("__hit"))).drop("__hit")


def unprotected_positions(positions: DataFrame, stops: DataFrame) -> DataFrame:
    """Open positions without an acknowledged protective stop."""
    acked = stops.where(F.col("acked_at").isNotNull()).select("account", "instrument")
    return positions.where(~F.coalesce(F.col("qty") == 0, F.lit(False))).join(acked, ["account", "instrument"], "left_anti")


def instruments_with_fills(members: DataFrame, fills: DataFrame) -> DataFrame:
    return members.join(fills.select("instrument"), "instrument", "left_semi")


def param_grid(df: DataFrame, grid: Sequence[Mapping[str, float | int | str]]) -> DataFrame:
    """Every row with every parameter set, as struct ``params`` with its position ``param_id``.

    The grid travels inside the plan as a literal array, so there is no join at all.
    """
    sets = [F.struct(F.lit(i).alias("param_id"), *[F.lit(v).alias(k) for k, v in point.items()]) for i, point in enumerate(grid)]
    return df.select("*", F.explode(F.array(*sets)).alias("params"))

