"""Registry of queries: a DataFrame plan over the derived views and the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketops.functions.windows import numbered
from marketops.operators.quality import dedup_fills
from marketops.session import materialize, shared_dir
from marketops.sources.fixtures import cte, view


class Inputs:
    """The derived views of one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def ledger(self, *columns: str) -> DataFrame:
        """Fills counted once, stored as the table every position and PnL is built from; only the named columns, if any are."""
        once = dedup_fills(self("fx_fill"), order=("ts", "recv_seq", "price"))
        return materialize(once.select(*columns) if columns else once)

    def fresh_folder(self) -> str:
        return f"{shared_dir(self.spark)}/marketops-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Query:
    plan: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, views: Sequence[str] = (), sql: str | None = None):
    def register(plan: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        text = f"{cte(*views)}\n{sql}" if sql and views else sql
        if text and "FROM fold f JOIN" in text:
            text = text.replace("WITH ", "WITH RECURSIVE ", 1)
        QUERIES[name] = Query(plan, text)
        return plan

    return register


def as_placed(df: DataFrame) -> DataFrame:
    """``place``: where each row stands in the order in which its partitions hold the rows, counted from 1 per partition and summed over them."""
    # Written once: read again, adaptive execution may cut the sorted rows into other partitions, whose numbers would not agree.
    marked = materialize(df.withColumn("__at", F.monotonically_increasing_id()))
    return numbered(marked, [], ["__at"], F.shiftright("__at", 33), "place").drop("__at")


def nudge(digits: int) -> float:
    """Added before rounding so that exact ties, which the engines break differently, are none."""
    return float(f"1.7e-{digits + 3}")


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as the SQL rounds; Spark's ``round`` takes the shortest decimal that prints the double,
    which puts a value just below a half upon it."""
    scale = 10.0**digits
    y = value * scale
    whole = F.floor(F.abs(y)).cast("double")
    size = whole + F.when(F.abs(y) - whole >= 0.5, 1.0).otherwise(0.0)
    # From 2^52 on a double is whole; NaN counts as larger.
    return F.when(F.abs(y) >= 2.0**52, y).otherwise(F.when(y < 0, -size).otherwise(size)) / scale


def plain(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Types both engines hash alike: decimals and doubles as rounded doubles, timestamps without a
    zone, arrays of text joined. ``special`` sets the digits of single columns."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(field.name)
        if kind in ("decimal", "double", "float"):
            keep = special.get(field.name, digits)
            # Adding zero turns a negative zero into a plain one.
            col = rounded(col.cast("double") + nudge(keep), keep) + F.lit(0.0)
        elif kind == "timestamp":
            col = col.cast("timestamp_ntz")
        elif kind == "array":
            col = F.array_join(col, ",")
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


# Small pieces of SQL text used by many of the checks.

def d(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {nudge(digits):.12f}, {digits}) + 0.0 AS {name}"


def breaches(checks: Mapping[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({b}, TRUE) THEN '{n}' END" for n, b in checks.items()) + ")"


def unmet(checks: Mapping[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, FALSE) THEN '{n}' END" for n, ok in checks.items()) + ")"


def n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"
