"""Tables and files in the folder that all executors of the cluster share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) one inside the warehouse is set.  Lineage is cut by writing a
table there and reading it back, so a lost executor costs a re-read and nothing
else; the shuffle files of the write go as soon as the table is complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        at = sc._jsc.sc().getCheckpointDir()
        folder = at.get() if at.isDefined() else None
    if not folder:
        # the warehouse is shared, too
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later result reads."""
    for table in tables:
        path = getattr(table, "_shared_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
