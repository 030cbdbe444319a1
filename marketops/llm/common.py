"""Helpers the operators share: Arrow text as bytes, rolling hashes, packed columns, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketops.session import shared_dir  # noqa: F401  (operators import it from here)

#: Bytes of text one vectorised step works on; its arrays take some thirty times as much.
STEP_BYTES = 500_000

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_A
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    _table = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)
    _base = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, self._base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.inverse = np.full(n + 1, np.uint64(pow(int(self._base), -1, 2**64)), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self._table[data] * powers[:n], out=self.prefix[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Of every range of one length, by start."""
        n = len(self.prefix) - length
        return mixed((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])

    #: Some words of 1,024 letters and more have equal polynomials modulo 2**64 whatever the base, so no range longer than this is hashed at once.
    _longest = 256

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        short = np.minimum(end, start + self._longest)
        found = mixed((self.prefix[short] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * MIX_A)
        left = np.flatnonzero(short < end)
        while len(left):
            begin = short[left]
            short[left] = np.minimum(end[left], begin + self._longest)
            found[left] = mixed(found[left] * MIX_B + (self.prefix[short[left]] - self.prefix[begin]) * self.inverse[begin])
            left = left[short[left] < end[left]]
        return found


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal disjoint ranges; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > ends[:-1]]
    return starts[first], np.r_[ends[:-1][first[1:]], ends[-1]]


def table_batches(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch: texts are long, and batches lie outside the heap, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


class Scratch:
    """Tables of one call in the shared folder; ``drop`` deletes all but the kept one."""

    def __init__(self, spark: SparkSession):
        import uuid

        bounded_batches(spark)
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/marketops-llm-{uuid.uuid4().hex}", 0
        self.tables: list[str] = []

    def store(self, df: DataFrame) -> DataFrame:
        """The rows, written once; lineage ends here and a lost executor costs no more than a read."""
        self.count += 1
        folder = f"{self.root}/{self.count}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def bucketed(self, df: DataFrame, parts: int, key: str) -> DataFrame:
        """A table whose rows lie together by key, so that later joins on it move the other side only."""
        import uuid

        name = f"marketops_llm_{uuid.uuid4().hex}"
        df.write.bucketBy(parts, key).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, keep_last: bool = True) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for i in range(1, self.count + (not keep_last)):
            path = hadoop.fs.Path(f"{self.root}/{i}")
            path.getFileSystem(conf).delete(path, True)
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns alone, so that extra columns, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def documents_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
