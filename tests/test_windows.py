"""Segmented windows give the values of the plain window, whatever the skew and the segments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketops.functions.timing import bucket
from marketops.functions.windows import numbered, previous, rolling, running, scan
from marketops.operators.joins import asof_join


@pytest.fixture(scope="module")
def ticks(spark):
    """One key holds most rows, one bucket of it holds a third; NULL keys and NULL values occur."""
    rng = random.Random(3)
    t0, rows = datetime(2024, 1, 1), []
    for seq in range(900):
        key = rng.choice(["hot"] * 8 + ["b", None])
        minutes = 90 if seq % 3 == 0 else rng.randrange(0, 6000)
        rows.append((key, t0 + timedelta(minutes=minutes), seq, rng.choice([None, rng.randrange(-50, 50)])))
    return spark.createDataFrame(rows, "k string, ts timestamp, seq long, v long").cache()


WIDTHS = ["1 hour", "7 days", "1 minute", None]


def same(a, b):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(a.collect(), key=key) == sorted(b.select(*a.columns).collect(), key=key)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_running(ticks, width, inclusive, reverse):
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "near": ("last", "v")}
    got = running(ticks, ["k"], ["ts", "seq"], bucket("ts", width), aggs, inclusive=inclusive, reverse=reverse)
    order = [F.desc("ts"), F.desc("seq")] if reverse else ["ts", "seq"]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = ticks.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"), F.last("v", True).over(w).alias("near"))
    same(got, want)


@pytest.mark.parametrize("width", WIDTHS)
def test_running_without_key(ticks, width):
    got = running(ticks, [], ["ts", "seq"], bucket("ts", width), {"s": ("sum", "v")})
    w = Window.partitionBy(F.lit(1)).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    same(got, ticks.withColumn("s", F.sum("v").over(w)))


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("reverse", [True, False])
def test_previous_is_lag(ticks, width, reverse):
    got = previous(ticks, ["k"], ["ts", "seq"], bucket("ts", width), {"p": "v", "q": "seq"}, reverse=reverse)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    step = F.lead if reverse else F.lag
    same(got, ticks.select("*", step("v").over(w).alias("p"), step("seq").over(w).alias("q")))


@pytest.mark.parametrize("width", WIDTHS)
def test_numbered(ticks, width):
    w = Window.partitionBy("k").orderBy("ts", "seq")
    same(numbered(ticks, ["k"], ["ts", "seq"], bucket("ts", width), "n"), ticks.withColumn("n", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("chunk", [4, 7, 50, 100_000])
@pytest.mark.parametrize("width", ["1 hour", None])
def test_rolling_frames_reach_across_chunks(ticks, chunk, width):
    def cols(w):
        return {"m": F.max("v").over(w.rowsBetween(-4, -1)), "c": F.count("*").over(w.rowsBetween(-4, 2)), "a": F.lag("seq", 4).over(w), "z": F.lead("seq", 2).over(w)}

    got = rolling(ticks, ["k"], ["ts", "seq"], bucket("ts", width), cols, before=4, after=2, chunk_rows=chunk)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    same(got, ticks.select("*", *[c.alias(n) for n, c in cols(w).items()]))


@pytest.mark.parametrize("width", ["1 hour", None])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tolerance", [None, "30 minutes"])
def test_asof_join_against_brute_force(spark, ticks, width, direction, strict, tolerance):
    left = ticks.where("seq % 4 = 0").withColumnRenamed("seq", "id").withColumnRenamed("v", "lv")
    right = ticks.where("seq % 4 <> 0")
    got = {r.id: (r.asof.seq if r.asof else None) for r in asof_join(left, right, ["k"], tolerance=tolerance, direction=direction, strict=strict, width=width).collect()}
    rights = right.collect()
    limit = timedelta(minutes=30) if tolerance else timedelta(days=999)
    for row in left.collect():
        near = None
        for r in rights:
            gap = row.ts - r.ts if direction == "backward" else r.ts - row.ts
            if row.k is None or r.k != row.k or gap < timedelta(0) or (strict and not gap) or gap > limit:
                continue
            rank = (r.ts, r.seq)
            if near is None or (rank > near if direction == "backward" else rank < near):
                near = rank
        assert got[row.id] == (near[1] if near else None)
    assert len(got) == left.count()


def test_hot_key_is_spread_over_tasks(ticks):
    """No hash partition of the row shuffle holds a whole hot key."""
    seg = ticks.withColumn("s", bucket("ts", "1 hour")).where("k = 'hot'")
    sizes = [r["count"] for r in seg.repartition(8, "k", "s").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
@pytest.mark.parametrize("order", [["ts", "seq"], ["seq"]])
def test_scan_looks_both_ways(ticks, width, inclusive, reverse, order):
    aggs = {"s": ("sum", "v"), "near": ("last", "v"), "coming": ("next", "v"), "p": ("lag", "v"), "q": ("lead", "v"), "at": ("next", F.struct("v", "seq"))}
    if order == ["seq"]:
        del aggs["at"]  # all of fixed width: totals are hash aggregates
    segment = bucket("ts", width) if order == ["ts", "seq"] else F.floor(F.col("seq") / 100).cast("long")
    got = scan(ticks, ["k"], order, segment, aggs, inclusive, reverse)
    along, against = ([F.desc(c) for c in order], [F.asc(c) for c in order]) if reverse else ([F.asc(c) for c in order], [F.desc(c) for c in order])
    here = 0 if inclusive else -1
    w, b = (Window.partitionBy("k").orderBy(*o) for o in (along, against))
    up, down = (x.rowsBetween(Window.unboundedPreceding, here) for x in (w, b))
    want = ticks.select("*", F.sum("v").over(up).alias("s"), F.last("v", True).over(up).alias("near"), F.last("v", True).over(down).alias("coming"), F.lag("v").over(w).alias("p"),
                        F.lead("v").over(w).alias("q"), F.last(F.struct("v", "seq"), True).over(down).alias("at"))
    same(got, want.drop(*({"at"} - aggs.keys())))


def test_scan_returns_wanted_rows_only(ticks):
    got = scan(ticks, ["k"], ["ts", "seq"], bucket("ts", "1 hour"), {"near": ("last", "v")}, wanted=F.col("v").isNull())
    w = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    same(got, ticks.select("*", F.last("v", True).over(w).alias("near")).where("v IS NULL"))


def test_no_sort_aggregates(ticks):
    right = ticks.where("v IS NOT NULL").select("k", "ts", "seq", F.concat(F.lit("text "), "v").alias("payload"))
    plans = [asof_join(ticks, right, ["k"]), scan(ticks, ["k"], ["seq"], F.floor(F.col("seq") / 100).cast("long"), {"a": ("next", "v"), "b": ("lag", "v"), "c": ("max", "v")})]
    for df in plans:
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
