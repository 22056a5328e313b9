"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "reviewlens", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """UTC, adaptive execution with skew joins; the master and all else from the cluster's own settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (conf | (extra or {})).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the input has fewer splits than there are cores (one small file); else as they are.

    For passes that cost far more than a shuffle of so little input.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the one that the cluster names in spark.checkpoint.dir, one in the warehouse only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet in the checkpoint folder and read back; the shuffle files of the write go when it ends."""
    spark, cleanup = rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    out = spark.read.schema(rows.schema).parquet(path)
    out._stored_path = path
    return out


def unstored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later result reads."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(table._stored_path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
