"""Positions, PnL and equity from fills that were deduplicated first."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.timing import bucket
from marketops.functions.windows import running, scan
from marketops.schemas import MONEY
from marketops.session import materialize

BY = ("account", "instrument")
ORDER = ("ts", "fill_id")
_SUM_QTY = "decimal(19,8)"


def signed_qty() -> Column:
    """Bought quantity, or sold as negative; NULL for a fill whose side or quantity is unknown."""
    return F.when(F.col("side") == "buy", F.col("qty")).when(F.col("side") == "sell", -F.col("qty"))


def cash_flow() -> Column:
    """Money received: sales minus purchases, before fees."""
    return -(signed_qty().cast("decimal(18,8)") * F.col("price"))


def position_path(fills: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: str | int = "1 day") -> DataFrame:
    """Signed position after each fill; unknown from a fill of unknown side or quantity on."""
    unknown = F.when(signed_qty().isNull(), 1).otherwise(0)
    path = running(fills, by, order, bucket(order[0], width), {"position": ("sum", signed_qty()), "__unknown": ("sum", unknown)})
    return path.withColumn("position", F.when(F.col("__unknown") == 0, F.col("position"))).drop("__unknown")


def known_sum(value: Column) -> Column:
    """The sum, or NULL where one of the values is unknown."""
    return F.when(F.count(F.when(value.isNull(), 1)) == 0, F.sum(value))


def positions(fills: DataFrame, as_of: str | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Position per key at ``as_of`` (inclusive), or at the end; NULL where a fill's side or quantity is unknown."""
    rows = fills if as_of is None else fills.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    return rows.groupBy(*by).agg(known_sum(signed_qty()).alias("qty"))


def pnl_mark_to_market(fills: DataFrame, marks: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Cash flow minus fees plus position at the mark; the order of fills does not matter.

    ``marks(instrument, price)`` holds one row per instrument. The PnL is NULL without a mark, with a fill of unknown side, quantity, price or fee,
    and where a sum passes what its decimals hold.
    """
    sums = fills.groupBy(*by).agg(
        known_sum(signed_qty()).try_cast(_SUM_QTY).alias("qty"), known_sum(cash_flow()).try_cast(MONEY).alias("cash"), known_sum(F.col("fee")).try_cast(MONEY).alias("fees")
    )
    marked = sums.join(marks.select("instrument", F.col("price").alias("mark")), "instrument", "left")
    open_value = F.when(F.col("qty") == 0, F.lit(0)).otherwise(F.col("qty") * F.col("mark"))
    return marked.select(*by, "qty", "cash", "fees", (F.col("cash") - F.col("fees") + open_value).cast(MONEY).alias("pnl"))


def pnl_fifo_realized(fills: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: str | int = "1 day", span: int | None = 10_000) -> DataFrame:
    """Realized PnL with lots closed first-in first-out, before fees.

    Unit number k of the buys always pairs with unit number k of the sells. Both sides are laid out on
    one axis of cumulative quantity; between neighbouring break points one buy price meets one sell
    price. ``span`` units of that axis form one parallel segment; without it segments hold equal numbers of rows.
    """
    lots = fills.where((F.col("qty") > 0) & F.col("side").isin("buy", "sell")).select(*by, *order, "side", "qty", "price")
    axis = running(lots, [*by, "side"], order, bucket(order[0], width), {"__x": ("sum", "qty")})
    marked = axis.select(
        *by, "__x", "side",
        F.when(F.col("side") == "buy", F.col("price")).alias("__b"), F.when(F.col("side") == "sell", F.col("price")).alias("__s"),
    )
    step = None if span is None else F.floor(F.col("__x") / span).cast("bigint")
    marked = materialize(marked)
    # Ends of equal x differ by no quantity, so their order does not matter.
    pieces = scan(marked, by, ["__x"], step, {"__buy": ("next", "__b"), "__sell": ("next", "__s"), "__from": ("lag", "__x")})
    length = (F.col("__x") - F.coalesce(F.col("__from"), F.lit(Decimal(0)))).cast("decimal(18,8)")
    both = F.col("__buy").isNotNull() & F.col("__sell").isNotNull()
    gain = F.when(both, (F.col("__sell") - F.col("__buy")) * length)
    return pieces.groupBy(*by).agg(
        F.coalesce(F.sum(gain), F.lit(Decimal(0))).cast(MONEY).alias("realized"),
        F.coalesce(F.sum(F.when(both, length)), F.lit(Decimal(0))).alias("matched_qty"),
    )


def equity_curve(fills: DataFrame, marks: DataFrame, start: Decimal | int, last_day: str, by: Sequence[str] = BY) -> DataFrame:
    """Equity per account and UTC day, carried over days without fills or marks, up to ``last_day``.

    ``marks(instrument, ts, seq, price)``; each day closes at its last mark. Fills are summed per
    account, instrument and day before anything is expanded to days.

    What a pair of account and instrument adds to the equity changes only on days with fills, and while something is held with the marks. So only
    days on which a position is open are laid out per pair; a flat pair gives one change on the day it became flat. Changes are summed per account
    and day, accumulated, and carried over the days once per account. An open position without a mark makes the account's equity unknown.
    """
    account, instrument = by
    until = F.lit(last_day).cast("date")

    def held(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        nxt = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
        to = F.coalesce(F.date_sub(nxt, 1), until)
        spread = df.where(F.col("day") <= until).withColumn("__to", to)
        return spread.withColumn("day", F.explode(F.sequence("day", F.least("__to", until)))).drop("__to")

    # At most one row per key and day, so these windows are as long as the calendar.
    daily = fills.groupBy(*by, F.to_date("ts").alias("day")).agg(
        known_sum(signed_qty()).alias("q"), known_sum(cash_flow() - F.col("fee")).cast(MONEY).alias("c")
    )
    upto = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    book = daily.where(F.col("day") <= until).select(*by, "day", F.sum("q").over(upto).try_cast(_SUM_QTY).alias("q"), F.sum("c").over(upto).try_cast(MONEY).alias("c"))
    closes = marks.groupBy(instrument, F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct("ts", "seq")).alias("mark"))
    steps = book.withColumn("__next", F.lead("day").over(Window.partitionBy(*by).orderBy("day")))
    open_ = F.coalesce(F.col("q") != 0, F.lit(True))
    # Cash changes with fills only.
    cash = book.withColumn("__was", F.lag("c").over(Window.partitionBy(*by).orderBy("day")))
    moved = cash.select(account, "day", (F.col("c") - F.coalesce("__was", F.lit(Decimal(0)))).cast(MONEY).alias("__cash"), F.when(F.col("c").isNull(), 1).otherwise(0).alias("__bad"))
    moved = moved.groupBy(account, "day").agg(F.sum("__cash").alias("__cash"), F.sum("__bad").alias("__bad"))
    last_held = F.coalesce(F.date_sub("__next", 1), until)
    days = steps.where(open_).select(*by, "q", F.explode(F.sequence("day", last_held)).alias("day"))
    valued = days.join(held(closes, [instrument]), [instrument, "day"], "left")
    value = F.col("q") * F.col("mark")
    worth = valued.groupBy(account, "day").agg(F.sum(value).cast(MONEY).alias("__worth"), F.count(F.when(value.isNull(), 1)).alias("__blind"))
    first = book.groupBy(account).agg(F.min("day").alias("__first"))
    calendar = first.select(account, F.explode(F.sequence("__first", until)).alias("day"))
    line = calendar.join(moved, [account, "day"], "left").join(worth, [account, "day"], "left")
    so_far = Window.partitionBy(account).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    complete = (F.coalesce(F.sum("__bad").over(so_far), F.lit(0)) == 0) & (F.coalesce("__blind", F.lit(0)) == 0)
    total = F.sum("__cash").over(so_far) + F.coalesce("__worth", F.lit(Decimal(0))) + F.lit(start)
    return line.select(account, "day", F.when(complete, total).cast(MONEY).alias("equity"))


def position_episodes(path: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ORDER, width: str | int = "1 day") -> DataFrame:
    """Flat-to-flat trades with open and close time, largest size and PnL net of fees (NULL while open)."""
    path = materialize(path.select(*dict.fromkeys([*by, *order, "ts", "position", "side", "qty", "price", "fee"])))
    flat = F.when(F.col("position") == 0, 1).otherwise(0).cast("bigint")
    numbered = running(path, by, order, bucket(order[0], width), {"episode": ("sum", flat)}, inclusive=False)
    numbered = numbered.withColumn("episode", F.coalesce("episode", F.lit(0)))
    closed = F.max(flat) == 1
    money = (cash_flow() - F.col("fee")).cast(MONEY)
    return numbered.groupBy(*by, "episode").agg(
        F.min("ts").alias("opened"), F.when(closed, F.max("ts")).alias("closed"), F.max(F.abs("position")).alias("max_qty"),
        F.when(closed, F.sum(money)).alias("pnl"), F.count("*").alias("fills"),
    )


DIGEST = "__digest"


def differing_ranges(a: DataFrame, b: DataFrame, fanout: int = 1024, levels: int = 2) -> tuple[DataFrame, DataFrame, int]:
    """Both tables cut down to the ranges of row digests in which they differ, and how many of these there are.

    A digest tree: level by level, each table's rows are counted and their digests summed per child range, where they lie; of the ranges that
    differ only the children are looked at further. What is shuffled is one row per range and task, and the driver learns range numbers, at most
    ``fanout`` times those of the level before. Two 64-bit digests of all columns are summed, with multiplicity.
    """
    names = a.columns

    def digested(df: DataFrame) -> DataFrame:
        row = [F.xxhash64(*names, *[F.col(c).isNull() for c in names]), F.xxhash64(F.lit("second"), *names, *[F.col(c).isNull() for c in names])]
        return df.select(*names, row[0].alias(DIGEST), row[1].alias(DIGEST + "2"))

    a, b = digested(a), digested(b.select(*names))
    width = 1
    for _ in range(levels):
        width *= fanout
        part = F.pmod(F.col(DIGEST), F.lit(width))

        def sums(df: DataFrame, sign: int, part: Column = part) -> DataFrame:
            big = "decimal(38,0)"
            return df.groupBy(part.alias("part")).agg(
                (F.count("*") * sign).alias("n"), (F.sum(F.col(DIGEST).cast(big)) * sign).cast(big).alias("x"), (F.sum(F.col(DIGEST + "2").cast(big)) * sign).cast(big).alias("y"))

        net = sums(a, 1).unionByName(sums(b, -1)).groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y")])
        apart = [r.part for r in net.where("n <> 0 OR x <> 0 OR y <> 0").select("part").collect()]
        if len(apart) > fanout:  # so many ranges differ that further levels would spare little
            break
        a, b = (df.where(part.isin(apart)) if apart else df.limit(0) for df in (a, b))
        if not apart:
            break
    return a.select(*names), b.select(*names), len(apart)


def difference(a: DataFrame, b: DataFrame, left: str = "only_a", right: str = "only_b") -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; only rows of ranges that differ are shuffled and compared."""
    a, b, _ = differing_ranges(a, b)
    only_a = a.exceptAll(b).select(F.lit(left).alias("side"), "*")
    return only_a.unionByName(b.exceptAll(a).select(F.lit(right).alias("side"), "*"))


def rebuild_parity(full: DataFrame, checkpoint: DataFrame, tail: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Positions where checkpoint plus tail differs from the full rebuild; empty when nothing was lost.

    ``full`` and ``tail`` are fills, ``checkpoint`` is a table of positions.
    """
    kind = "decimal(38,8)"
    rebuilt = checkpoint.select(*by, F.col("qty").cast(kind)).unionByName(positions(tail, by=by).select(*by, F.col("qty").cast(kind)))
    rebuilt = rebuilt.groupBy(*by).agg(F.sum("qty").cast(kind).alias("qty"))
    # Positions are few and the comparison reads both sides several times; the fills are read once.
    return difference(materialize(positions(full, by=by).select(*by, F.col("qty").cast(kind))), materialize(rebuilt), "full", "rebuilt")
