"""Reason codes: an array of everything that failed, in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed(checks: Mapping[str, Column]) -> Column:
    """Array of the names whose *breach* is true. A NULL breach counts as a breach (fail closed)."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(breach, F.lit(True)), F.lit(name)) for name, breach in checks.items()])
    )


def not_ok(checks: Mapping[str, Column]) -> Column:
    """Array of the names whose *ok* condition is false or unknown."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )


def split_valid(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without any breach, and the rest with ``reasons`` and ``first_reason``."""
    graded = df.withColumn("reasons", failed(checks))
    valid = graded.where(F.size("reasons") == 0).drop("reasons")
    bad = graded.where(F.size("reasons") > 0).withColumn("first_reason", F.col("reasons")[0])
    return valid, bad
