"""Findings of the third round: rows placed alike by every reader, rounding as the SQL rounds."""

from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal as D
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketops.operators import monitoring, portfolio, risk
from marketops.operators.risk import SIZING_INPUTS, size_positions
from marketops.plans.registry import as_placed, d, plain
from marketops.session import scratch_tables


def test_sorted_rows_are_written_once_before_they_are_numbered(spark):
    """Read twice, they could be cut otherwise the second time: at 600,000 events five in six places were wrong."""
    before = scratch_tables()
    out = as_placed(spark.range(5_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("wide")).orderBy(F.desc("id")))
    assert scratch_tables() == before + 1
    assert out.where("place <> 5000 - id").count() == 0 and out.count() == 5_000


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    values = [11.87154983, 0.00004983, -11.87155017, 0.5, -0.0, 1e300, -2.5, float("nan"), float("inf"), None, 4503599627370497.0]
    for digits in (2, 4, 6):
        got = [r.x for r in plain(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), digits).collect()]
        want = [r[0] for r in duckdb.connect().execute(f"SELECT {d('x', 'x', digits)} FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
        assert [str(x) for x in got] == [str(x) for x in want]


def test_a_quantity_a_thousandth_of_a_unit_short_is_whole(spark):
    row = {"entry": D("182.96"), "stop": D("175.6"), "risk_budget": D(200000), "max_notional": D(4000), "liquidity": D(83000), "liquidity_fraction": D("0.5"), "equity": D(8000), "limit": D(9)}
    schema = ", ".join(f"{c} decimal(18,8)" for c in SIZING_INPUTS)
    (found,) = size_positions(spark.createDataFrame([tuple(row[c] for c in SIZING_INPUTS)], schema)).collect()
    assert found.quantity == D("21.86270223")


def test_correlation_by_tiles_is_that_of_whole_series(spark, monkeypatch):
    """Groups hold more markets than a tile, bars come in several steps, and no sums of pairs are shuffled."""
    monkeypatch.setattr(risk, "_TILE", (7, 11))
    monkeypatch.setattr(risk, "_CELLS", 33)
    rng, t0 = np.random.default_rng(3), datetime(2024, 1, 1)
    table = {f"I{i}": {d: float(rng.normal()) if i % 9 else 0.5 for d in range(40) if rng.random() < 0.4} for i in range(60)}
    rows = [(k, t0 + timedelta(days=day), r) for k, bars in table.items() for day, r in bars.items()] + [(None, t0, 1.0), ("I1", t0 + timedelta(days=50), None)]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp, ret double")
    want = {}
    for a, b in combinations(sorted(table), 2):
        days = sorted(table[a].keys() & table[b].keys())
        if len(days) >= 5:
            x, y = ([table[k][day] for day in days] for k in (a, b))
            want[a, b] = (len(days), float(np.corrcoef(x, y)[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else None)
    out = risk.return_correlation(df, min_bars=5, block_size=5, most_blocks=3)
    got = {(r.a, r.b): (r.n, r.corr) for r in out.collect()}
    assert got.keys() == want.keys() and all(g[0] == w[0] and (g[1] is w[1] or abs(g[1] - w[1]) < 1e-9) for g, w in ((got[k], want[k]) for k in want))
    strong = risk.return_correlation(df, min_bars=5, block_size=5, most_blocks=3, threshold=0.8)
    assert {(r.a, r.b) for r in strong.collect()} == {k for k, (_, c) in want.items() if c is not None and abs(c) >= 0.8}
    assert strong._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_returns_go_to_sixteen_groups_at_most(spark, monkeypatch):
    """With 64 groups the shuffle of 90,000 markets was 1 GB; two groups are a partition's work, whatever their bytes."""

    def arrived(min_bars, threshold):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array(["x"]), pa.array([0.0]), pa.array([rows], pa.int64())], names=["a", "b", "corr", "n"])

        return run

    monkeypatch.setattr(risk, "_block_correlations", arrived)
    returns = spark.range(300).select(F.concat(F.lit("I"), F.col("id")).alias("instrument"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.lit(0.5).alias("ret"))
    out = risk.return_correlation(returns, block_size=1)
    assert 300 < out.agg(F.sum("n")).first()[0] <= 16 * 300
    assert out.rdd.getNumPartitions() == 16 * 17 // 2


def test_rebuild_parity_stores_positions_before_comparing(spark):
    fills = spark.createDataFrame([("a", "i", "buy", D(5)), ("a", "j", "sell", D(2))], "account string, instrument string, side string, qty decimal(18,8)")
    before = scratch_tables()
    out = portfolio.rebuild_parity(fills, portfolio.positions(fills.where("instrument = 'i'")), fills)
    assert scratch_tables() == before + 2
    assert sorted((r.side, r.instrument, int(r.qty)) for r in out.collect()) == [("full", "i", 5), ("rebuilt", "i", 10)]


def test_invariant_report_starts_no_python_worker(spark):
    out = monitoring.invariant_report({"leverage": spark.range(5).select("id")})
    assert "ExistingRDD" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [(r.number, r.violations, r.sample_ids) for r in out.collect()] == [(2, 5, ["0", "1", "2"])]
