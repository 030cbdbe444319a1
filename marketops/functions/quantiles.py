"""Exact quantiles of any number of values, without one task that holds a group.

Equal values are counted where they lie, the distinct ones are range-partitioned by group and value, and a segmented running sum gives each
the ranks it covers. A quantile is then the value, or the mean of the two values, whose ranks hold its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketops.functions.timing import as_column
from marketops.functions.windows import running


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """A join on the group columns in which NULL equals NULL; they come from the left."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], F.lit(True)) if by else F.lit(True)
    return left.join(renamed, same, how).drop(*[f"__r_{c}" for c in by])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, shares: Mapping[str, float]) -> DataFrame:
    """(by, name...): each group's quantiles, linear between neighbouring values; NULL values do not count, groups without values are absent."""
    counts = df.select(*by, as_column(value).alias("__value")).where("__value IS NOT NULL").groupBy(*by, "__value").agg(F.count("*").alias("__n"))
    ranked = running(counts, by, ["__value"], None, {"__upto": ("sum", F.col("__n"))})
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    placed = join_groups(ranked, totals, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n")), F.col("__value").cast("double")))

    low = {name: F.floor((F.col("__total") - 1) * F.lit(q)) for name, q in shares.items()}
    picked = placed.groupBy(*by).agg(
        *[at(rank).alias(f"__lo_{name}") for name, rank in low.items()], *[at(F.least(rank + 1, F.col("__total") - 1)).alias(f"__hi_{name}") for name, rank in low.items()],
        F.max("__total").alias("__total"),
    )

    def between(name: str, q: float) -> Column:
        place = (F.col("__total") - 1) * F.lit(q)
        return F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (place - F.floor(place))

    return picked.select(*by, *[between(name, q).alias(name) for name, q in shares.items()])
