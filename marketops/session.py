"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "marketops", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; the cluster's own settings win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only where that is unset (a local test) a fresh temporary folder is made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_SCRATCH: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to a table in the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors, and lets several consumers read the columns
    they need without computing the rows again. Runs a job.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/marketops-scratch-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _SCRATCH.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables ``materialize`` wrote, once their results are stored; the ``keep`` oldest stay."""
    while len(_SCRATCH) > keep:
        delete_folder(spark, _SCRATCH.pop())


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_tables() -> int:
    """How many tables ``materialize`` has written and not yet dropped."""
    return len(_SCRATCH)
