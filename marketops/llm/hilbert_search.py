"""Nearest neighbours by several shifted Hilbert curves.

Each curve has its own random rotation to a few dimensions and its own shift. Every distinct vector gets a key on every curve;
Spark range-partitions the keys, and prefix sums over the partitions give each vector its rank on the curve. A query looks
at the ranks ``reach`` (a share of all vectors) before and after its own. The order is cut into blocks of ``block`` ranks; a
query goes to every block its window touches, where its exact distances to the block's vectors are computed together with
those of other queries; the best of all blocks and curves are merged.

A window is a share of the data, not a number of rows, so recall stays the same at every size. On vectors without
structure (independent directions) near neighbours are hardly nearer than others and the share must be large.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do those whose dimension is not
the most frequent one. Equal vectors are searched once, and keep as many ids as a result can show, the smallest; a
result lists ties by id. Rows that repeat an id and its vector count once. Few candidates give short results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketops.llm.common import Scratch, parallelism


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers (``bits`` bits each), as one integer."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> level) & 1
    return key


class Curves:
    """Rotations, shifts and scales of the curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int):
        rng = np.random.default_rng(11)
        size = sample.shape[1]
        dims = min(dims, size)
        self.bits = bits
        self.axes = [np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(curves)]
        self.low, self.width, self.shift = [], [], []
        for axes in self.axes:
            p = sample @ axes
            low, high = p.min(0), p.max(0)
            # The grid is twice as wide as the sample; the shift moves the sample within it.
            width = np.where(high > low, 2 * (high - low), 1.0)
            self.low.append(low)
            self.width.append(width)
            self.shift.append(rng.random(dims) * 0.5)

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        cells = ((vectors @ self.axes[curve] - self.low[curve]) / self.width[curve] + self.shift[curve]) * (1 << self.bits)
        return hilbert(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def nearest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the ``k`` nearest points of each query, with all ties of the last."""
    rows, cols, scores = [], [], []
    own = (points * points).sum(1)
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        rough = own - 2 * (q @ points.T)
        limit = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        near = rough <= (limit + 1e-9 * (1 + np.abs(limit) + own.max()))[:, None]
        r, c = np.nonzero(near)
        d = np.sqrt(((q[r] - points[c]) ** 2).sum(1))
        rows.append(r + i)
        cols.append(c)
        scores.append(d)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def search(vectors: DataFrame, is_query: Column, k: int = 10, curves: int = 16, dims: int = 4, bits: int = 8, reach: float = 0.06, block: int = 4096, sample: int = 4096, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by Euclidean distance, itself excluded.

    ``sample`` bounds the rows that the scales of the curves are fitted on; all rows are indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    parts = parallelism(spark)
    as_given = F.col(vector)
    rows = vectors.where(usable(as_given)).select(F.col(id_).cast("bigint").alias("id"), F.transform(as_given, lambda x: x + F.lit(0).cast("float")).alias("vec"), is_query.alias("asks"))
    rows = rows.where("id IS NOT NULL").dropDuplicates(["id", "vec"])
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.range(0).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    rows = scratch.store(rows.where(F.size("vec") == sizes["size"]))
    first_ids = rows.withColumn("__n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("__n") <= k + 1)
    points = scratch.store(first_ids.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("vec", "ids", F.get("ids", F.lit(0)).alias("first")))
    total = points.count()
    fitted = Curves(np.array([r["vec"] for r in points.orderBy(F.xxhash64("vec"), "first").limit(sample).collect()], np.float64), curves, dims, bits)
    asked = scratch.store(rows.where("asks").select("id", "vec").join(points.select("vec", "first"), "vec").select(F.col("id").alias("query_id"), "first"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(fitted.keys(x, c)), batch.column("first")], names=["curve", "key", "first"])

    order = ["curve", "key", "first"]
    # The position after a range shuffle and a sort, frozen by the written table.
    ranged = points.select("vec", "first").mapInArrow(keyed, "curve int, key bigint, first bigint").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = scratch.store(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("curve", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranks = scratch.store(ranged.join(bases, ["curve", "part"]).select("curve", "first", (F.col("at") - F.col("low") + F.col("base")).alias("rank")))

    window = max(int(np.ceil(reach * total)), k + 1)
    slab = 64 * block  # queries of one task come from so many ranks
    whole = lambda c, by: F.floor(c / F.lit(by)).cast("bigint")
    placed = ranks.join(points, "first")
    at = whole(F.col("rank"), block)
    near = F.sequence(whole(F.greatest(at * block - window, F.lit(0)), slab), whole(F.least(at * block + block + window, F.lit(total - 1)), slab))
    data = placed.select("curve", at.alias("block"), F.explode(near).alias("slab"), "first", "ids", "vec")
    seekers = ranks.join(asked.select("first").distinct(), "first").join(points.select("first", "vec"), "first")
    touched = F.sequence(whole(F.greatest(F.col("rank") - window, F.lit(0)), block), whole(F.least(F.col("rank") + window, F.lit(total - 1)), block))
    seekers = seekers.select(F.col("curve").alias("q_curve"), F.explode(touched).alias("q_block"), whole(F.col("rank"), slab).alias("q_slab"), F.col("first").alias("query"), F.col("vec").alias("q_vec"))

    def meet(queries: pd.DataFrame, block_: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block_):
            return pd.DataFrame({"query": [], "first": [], "ids": pd.Series([], dtype=object), "score": []})
        q, p = np.stack(queries["q_vec"].to_numpy()).astype(np.float64), np.stack(block_["vec"].to_numpy()).astype(np.float64)
        r, c, d = nearest(q, p, k + 1)
        return pd.DataFrame({"query": queries["query"].to_numpy()[r], "first": block_["first"].to_numpy()[c], "ids": block_["ids"].to_numpy()[c], "score": d})

    met = seekers.groupBy("q_curve", "q_block", "q_slab").cogroup(data.groupBy("curve", "block", "slab")).applyInPandas(meet, "query bigint, first bigint, ids array<bigint>, score double")
    found = met.groupBy("query", "first").agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("query").orderBy("score", "first")
    kept = found.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k + 1)
    listed = asked.join(kept.select(F.col("query").alias("first"), "score", "ids"), "first").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    result = scratch.store(listed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.drop()
    return result
