"""Versioned Parquet datasets, payload parsing, manifests and the append-only audit log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.operators.quality import SOURCE_KEY, row_digest
from marketops.schemas import PRICE, RAW_EVENT
from marketops.session import delete_folder, shared_dir

PARTITIONS = ("venue", "instrument", "event_type", "date")


def scan_dataset(spark: SparkSession, path: str, schema: T.StructType = RAW_EVENT, venue: str | None = None, instruments: Sequence[str] | None = None,
                 event_type: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Historical events with their declared schema. Filters name partition columns, so files outside
    them are never opened. ``version`` tells which dataset version a row belongs to."""
    declared = T.StructType(list(schema.fields))  # a copy: the given schema stays as it is
    for name, kind in (("date", T.DateType()), ("version", T.IntegerType())):
        if name not in declared.names:
            declared.add(name, kind)
    df = spark.read.schema(declared).option("basePath", path).parquet(path)
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    if instruments is not None:
        df = df.where(F.col("instrument").isin(*instruments))
    if event_type is not None:
        df = df.where(F.col("event_type") == event_type)
    if date_from is not None:
        df = df.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col("date") <= F.lit(date_to).cast("date"))
    return df


def write_dataset(df: DataFrame, path: str, version: int, ts: str = "event_ts", partitions: Sequence[str] = PARTITIONS) -> None:
    """Write a new immutable version below ``path``; an existing version is an error.

    Rows are rebalanced by partition: Spark splits a very busy partition over several tasks and files
    and lets one task write many small ones.
    """
    dated = df.withColumn("date", F.to_date(ts)) if "date" not in df.columns else df
    dated.hint("rebalance", *[F.col(c) for c in partitions]).write.mode("errorifexists").partitionBy(*partitions).parquet(f"{path.rstrip('/')}/version={version}")


def read_version(df: DataFrame, as_of_version: int, key: Sequence[str] = SOURCE_KEY, version: str = "version") -> DataFrame:
    """Per source key the newest correction not above the requested version; history stays on disk."""
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.xxhash64(*df.columns))
    known = df.where(F.col(version) <= as_of_version)
    return known.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


_PAYLOAD = T.StructType([T.StructField(n, T.StringType()) for n in ("bid", "ask", "last", "volume", "__corrupt")])


def normalize_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payload text to snapshot columns, and the malformed rows with the reason.

    ``malformed_json`` is not JSON at all; ``bad_number`` lacks a finite number that fits. ``scale_loss`` tells that a number
    of a good row had digits beyond the eighth, which are rounded.
    """
    parsed = raw.withColumn("__p", F.from_json("payload", _PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    names = ("bid", "ask", "last", "volume")
    numbers = parsed.withColumns({n: F.col(f"__p.{n}").try_cast(PRICE) for n in names})
    missing = loss = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
        loss = loss | F.coalesce(F.col(n) != F.col(f"__p.{n}").try_cast("decimal(38,28)"), F.lit(False))  # as many whole digits as a price
    corrupt = F.col("__p").isNull() | F.col("__p.__corrupt").isNotNull()
    graded = numbers.withColumn("malformed", F.when(corrupt, "malformed_json").when(missing, "bad_number")).withColumn("scale_loss", loss).drop("__p")
    good = graded.where(F.col("malformed").isNull()).drop("malformed", "payload")
    return good, graded.where(F.col("malformed").isNotNull()).select(*raw.columns, "malformed")


def config_hash(config: Mapping) -> str:
    """SHA-256 of a configuration, independent of key order."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def dataset_manifest(df: DataFrame, config: Mapping, ts: str = "event_ts", by: Sequence[str] = ()) -> DataFrame:
    """Rows, time range, order-independent content digest and configuration hash, in one pass.

    The digest sums a 64-bit hash of every row, so any partitioning and order give the same value.
    """
    digest = row_digest(df.columns, df)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        F.sum(digest.cast("decimal(38,0)")).alias("digest"), F.lit(config_hash(config)).alias("config_hash"),
    )


def append_audit(df: DataFrame, path: str, key: Sequence[str], day: Column | None = None, key_parts: int = 64) -> None:
    """Append rows whose key the log does not hold yet, whatever day they come on: every key counts once for ever.

    The log is partitioned by a hash of the key, so a batch reads the key columns of the parts its own keys fall into and
    no others. ``log_date`` is data. ``key_parts`` must stay the same for one log. Of rows of a batch with one key the earliest day
    stays, then the smallest row hash; NULL key values are equal to each other.
    """
    spark = df.sparkSession
    unknown = F.lit("1970-01-01").cast("date")
    dated = df.withColumns({
        "log_date": F.coalesce(F.to_date(day if day is not None else F.col("ts")), unknown),
        "key_part": F.pmod(F.xxhash64(*key), F.lit(key_parts)).cast("int"),
    })
    first = Window.partitionBy(*key).orderBy("log_date", row_digest(df.columns, df))
    batch = f"{shared_dir(spark)}/marketops-batch-{uuid.uuid4().hex}"
    try:
        dated.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").write.parquet(batch)
        rows = spark.read.parquet(batch)
        parts = [row.key_part for row in rows.select("key_part").distinct().collect()]  # at most key_parts
        if not parts:
            return
        try:
            log = spark.read.parquet(path).where(F.col("key_part").isin(parts)).select("key_part", *key)
        except Exception as missing:  # the first batch finds no log yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            log = None
        fresh = rows
        if log is not None:
            known = log.toDF("__part", *[f"__k{i}" for i in range(len(key))])
            same = F.col("key_part") == F.col("__part")
            for i, name in enumerate(key):
                same = same & F.col(name).eqNullSafe(F.col(f"__k{i}"))
            fresh = rows.join(known, same, "left_anti")
        fresh.write.mode("append").partitionBy("key_part").parquet(path)
    finally:
        delete_folder(spark, batch)
