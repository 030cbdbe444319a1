"""Running and rolling windows that survive a hot key.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task. Here a key is first cut
into *segments*: any value that never decreases along the window order, usually a time bucket.

``scan``     aggregates of all rows before, nearest values before and behind, and both neighbours, in one sort.
             Segment totals are pre-aggregated map-side, the totals (a few per key) are accumulated per key, and each
             segment receives what lies outside it as extra header and footer rows. The rows themselves
             are shuffled once, by (key, segment). ``running`` and ``previous`` are short forms.
``rolling``  frames of a fixed number of rows. Rows are numbered with ``running`` and cut into
             equal chunks; each chunk also gets the few neighbouring rows its frames reach into.

The input is read twice, once with few columns for the totals. Operators that chain windows therefore
write the narrow intermediate result first (``materialize``), or work would double with every step.

Both keep every row and give the same values as the plain window.

Where even one time bucket of a key may be too large for a task, pass no segment (``width=None`` in the
operators): the rows are then range-partitioned by key and order, which splits at any row, and written
to a table in the shared folder so that their partition number can serve as the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.functions.timing import as_column
from marketops.session import materialize

SEGMENT, IS_ROW, ROW_NUMBER = "__segment", "__is_row", "__row_number"
CHUNK, HOME = "__chunk", "__home"


def _over(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def range_segments(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Equal-sized segments whatever the skew: the partition number after a sort-range shuffle.

    The written table freezes the numbers; a partition lost later is read again, not cut anew.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by, *order).withColumn(name, F.spark_partition_id().cast("bigint"))
    return materialize(ranged)


def _fixed(df: DataFrame, col: Column) -> bool:
    """Whether values of the expression have a fixed width, so that hash aggregation can keep them in place."""
    kind = df.select(col.alias("c")).schema["c"].dataType
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    aggs: Mapping[str, tuple[str, Column | str]],
    inclusive: bool = True,
    reverse: bool = False,
    wanted: Column | None = None,
) -> DataFrame:
    """Add ``name -> (kind, value)`` from the rows before and behind each row of its key, in one sort.

    ``sum``, ``max``, ``min``, ``last`` (nearest non-null) take the rows up to this one, ``next`` (nearest non-null) those from this one on;
    ``inclusive`` counts the row itself. ``lag`` and ``lead`` are the neighbouring rows' values, NULLs included. ``reverse`` walks from the latest row back.
    ``order`` must be unique within a key for all but sums and extremes. Only rows that are ``wanted`` come out.

    Rows are shuffled once, by (key, segment). What lies outside a segment reaches it as a header row before and a footer row behind its rows,
    taken from segment totals: hash aggregates where values and a single order column have fixed width, and otherwise
    the segment's outermost row that has a value, found by a row number that Spark limits to one per segment and task before it shuffles.
    """
    columns = df.columns
    if segment is None:
        df = range_segments(df, by, order, "__range")
        segment = F.col("__range")
    kinds = {name: kind for name, (kind, _) in aggs.items()}
    plain = {name: as_column(value) for name, (_, value) in aggs.items()}
    near = [name for name, kind in kinds.items() if kind in ("last", "next", "lag", "lead")]
    hashed = all(len(order) == 1 and _fixed(df, F.col(order[0])) and _fixed(df, plain[name]) for name in near)
    at = {name: f"__v_{i}" for i, name in enumerate(aggs)}

    def held(name: str) -> Column:
        # Wrapped, a neighbour's NULL differs from no neighbour.
        return plain[name] if hashed or kinds[name] not in ("lag", "lead") else F.struct(plain[name].alias("v"))

    rows = df.select(*columns, segment.alias(SEGMENT), *[held(name).alias(at[name]) for name in aggs])
    keep = wanted if wanted is not None else F.lit(True)
    along, against = (F.desc, F.asc) if reverse else (F.asc, F.desc)
    earlier = Window.partitionBy(*by).orderBy(along(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(against(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str) -> Column:
        value, kind = F.col(at[name]), kinds[name]
        if kind in ("sum", "max", "min"):
            return _over(kind, value)
        # A row without a place in the order is the first of all, or in reverse the last.
        place = F.col(order[0])
        shown = F.lit(True) if kind in ("lag", "lead") else value.isNotNull()
        unplaced = F.max(F.when(place.isNull(), value))
        if (kind in ("last", "lag")) != reverse:
            return F.when(F.max(F.when(shown, place)).isNotNull(), F.max_by(value, F.when(shown, place))).otherwise(unplaced)
        return F.when(F.max(F.when(shown & place.isNull(), 1)).isNotNull(), unplaced).otherwise(F.min_by(value, F.when(shown, place)))

    def carried(name: str) -> Column:
        kind, col = kinds[name], F.col(at[name])
        if kind in ("sum", "max", "min", "last"):
            return _over(kind, col).over(earlier)
        if kind == "next":
            return F.last(col, ignorenulls=True).over(later)
        # The neighbouring segment's outermost row, whatever its value.
        return F.last(col).over(earlier if kind == "lag" else later)

    tables: list[tuple[DataFrame, list[str]]] = []
    summed = [name for name in aggs if hashed or name not in near]
    if summed:
        totals = rows.groupBy(*by, SEGMENT).agg(*[total(name).alias(at[name]) for name in summed])
        tables.append((totals.select(*by, SEGMENT, *[carried(name).alias(at[name]) for name in summed]), summed))
    for name in near if not hashed else []:
        before = kinds[name] in ("last", "lag")
        # One row of each segment: its outermost with a value, or any, for segments that only ask.
        empty = F.col(at[name]).isNull()
        edge = Window.partitionBy(*by, SEGMENT).orderBy(empty, *[against(c) if before else along(c) for c in order])
        outer = rows.select(*by, SEGMENT, *order, at[name]).withColumn("__n", F.row_number().over(edge)).where("__n = 1")
        tables.append((outer.select(*by, SEGMENT, F.last(at[name], ignorenulls=True).over(earlier if before else later).alias(at[name])), [name]))

    out = rows.withColumn(IS_ROW, F.lit(1))
    for table, names in tables:
        table = table.where(reduce(or_, [F.col(at[n]).isNotNull() for n in names]))
        heads = [n for n in names if kinds[n] not in ("next", "lead")]
        tails = [n for n in names if kinds[n] in ("next", "lead")]
        for part, place in ((heads, 0), (tails, 2)):
            if part:
                out = out.unionByName(table.select(*by, SEGMENT, *[at[n] for n in part], F.lit(place).alias(IS_ROW)), allowMissingColumns=True)
    whole = Window.partitionBy(*by, SEGMENT).orderBy(F.asc(IS_ROW), *[along(c) for c in order])
    frame = whole.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = ", ".join(f"`{c}`" for c in [*by, SEGMENT])
    steps = ", ".join([f"`{IS_ROW}` ASC", *[f"`{c}` {'DESC' if reverse else 'ASC'}" for c in order]])

    def added(name: str) -> Column:
        kind, col = kinds[name], F.col(at[name])
        if kind in ("sum", "max", "min", "last"):
            return _over(kind, col).over(frame)
        if kind in ("lag", "lead") and hashed:
            return (F.lag if kind == "lag" else F.lead)(col).over(whole)
        nearest = F.expr(f"{'lag' if kind == 'lag' else 'lead'}(`{at[name]}`, 1) IGNORE NULLS OVER (PARTITION BY {parts} ORDER BY {steps})")
        if kind == "next":
            return F.coalesce(col, nearest) if inclusive else nearest
        return nearest["v"]

    found = out.select(*columns, F.col(IS_ROW), *[added(name).alias(name) for name in aggs])
    return found.where((F.col(IS_ROW) == 1) & keep).drop(IS_ROW)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    aggs: Mapping[str, tuple[str, Column | str]],
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add ``name -> (kind, value)`` accumulated over all earlier rows of the key: ``sum``, ``max``, ``min`` or ``last``, as in ``scan``."""
    return scan(df, by, order, segment, aggs, inclusive, reverse)


def previous(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    columns: Mapping[str, Column | str],
    reverse: bool = False,
) -> DataFrame:
    """Values of the row just before (``reverse``: just after), NULLs included, as ``lag`` gives."""
    if len(columns) == 1:
        ((name, value),) = columns.items()
        return scan(df, by, order, segment, {name: ("lag", value)}, reverse=reverse)
    whole = F.struct(*[as_column(c).alias(name) for name, c in columns.items()])
    out = scan(df, by, order, segment, {"__prev": ("last", whole)}, inclusive=False, reverse=reverse)
    return out.select("*", *[F.col(f"__prev.{name}").alias(name) for name in columns]).drop("__prev")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column | None, name: str) -> DataFrame:
    """Exact row number per key, from 1."""
    return running(df, by, order, segment, {name: ("sum", F.lit(1).cast("bigint"))})


def rolling(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    before: int,
    after: int = 0,
    chunk_rows: int = 200_000,
) -> DataFrame:
    """Add columns over frames reaching at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` receives the ordered window and returns the expressions to add.
    """
    size = max(chunk_rows, before, after, 1)
    rows = numbered(df, by, order, segment, ROW_NUMBER)
    index = F.col(ROW_NUMBER) - 1
    offset = F.pmod(index, F.lit(size))
    chunk = ((index - offset) / size).cast("bigint")

    def place(number: Column, home: bool) -> Column:
        return F.struct(number.alias(CHUNK), F.lit(home).alias(HOME))

    copies = [place(chunk, True)]
    if before:
        copies.append(F.when(offset >= size - before, place(chunk + 1, False)))
    if after:
        copies.append(F.when((offset < after) & (chunk > 0), place(chunk - 1, False)))
    placed = rows.select("*", F.inline(F.array_compact(F.array(*copies))))
    window = Window.partitionBy(*by, CHUNK).orderBy(ROW_NUMBER)
    added = columns(window)
    out = placed.select(*df.columns, HOME, *[c.alias(name) for name, c in added.items()])
    return out.where(F.col(HOME)).drop(HOME)
