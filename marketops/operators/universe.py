"""Universe selection and point-in-time membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketops.functions.timing import bucket
from marketops.functions.windows import previous
from marketops.operators.joins import point_in_time_members
from marketops.session import materialize


def select_universe(liquidity: DataFrame, k_min: int, k_max: int) -> DataFrame:
    """Per date the ``k_max`` most liquid instruments by what was known the day before.

    ``liquidity(date, instrument, liquidity)`` is pre-aggregated here per date and instrument; the
    rank keeps at most ``k_max`` rows per date and task before the shuffle. Dates with fewer than
    ``k_min`` members are flagged ``undersized``; a date without any, between the first and the last, has
    one row without instrument.
    """
    daily = liquidity.groupBy(F.date_add("date", 1).alias("date"), "instrument").agg(F.sum("liquidity").alias("liquidity"))
    w = Window.partitionBy("date").orderBy(F.desc("liquidity"), F.asc("instrument"))
    top = daily.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_max)
    sizes = F.count("*").over(Window.partitionBy("date"))
    members = top.select("date", "instrument", "rank", "liquidity", (sizes < k_min).alias("undersized"))
    known = liquidity.select(F.date_add("date", 1).alias("date")).distinct()
    days = known.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    empty = days.join(known, "date", "left_anti").withColumn("undersized", F.lit(k_min > 0))
    return members.unionByName(empty, allowMissingColumns=True)


def membership_intervals(listings: DataFrame, width: str | int = "30 days") -> DataFrame:
    """Listing and delisting events to [valid_from, valid_to); repeats of the same kind collapse."""
    key, order = ["instrument"], ["ts", "seq"]
    cut = bucket("ts", width)
    seen = previous(listings, key, order, cut, {"__kind": "kind"})
    changes = materialize(seen.where(~F.col("kind").eqNullSafe(F.col("__kind"))).select("instrument", "ts", "seq", "kind"))
    ends = previous(changes, key, order, cut, {"valid_to": "ts"}, reverse=True)
    spans = ends.where(F.col("kind") == "list").select("instrument", F.col("ts").alias("valid_from"), "valid_to")
    return materialize(spans.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))


def survivorship_audit(df: DataFrame, membership: DataFrame, on: str = "ts", width: str | int = "1 day") -> DataFrame:
    """Evaluated rows outside membership, and delisted members that were never evaluated while listed."""
    graded = point_in_time_members(df.select("instrument", on), membership, on=on, width=width, keep_all=True)
    seen = graded.groupBy("instrument").agg(F.count(F.when(~F.col("member"), 1)).alias("outside"), F.count(F.when(F.col("member"), 1)).alias("inside"))
    listed = membership.groupBy("instrument").agg(F.count("*").alias("spells"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("open"))
    both = seen.join(listed, "instrument", "full_outer")
    never = (F.col("open") == 0) & (F.coalesce("inside", F.lit(0)) == 0)
    found = F.array_compact(F.array(
        F.when(F.col("outside") > 0, F.struct(F.col("outside").alias("n"), F.lit("outside_membership").alias("violation"))),
        F.when(never, F.struct(F.col("spells").alias("n"), F.lit("delisted_never_evaluated").alias("violation"))),
    ))
    return both.select("instrument", F.inline(found))
