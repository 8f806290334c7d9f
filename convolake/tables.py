"""Tables that cut a job's lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset, in local mode, a folder of our own."""
    sc = spark.sparkContext
    if not (path := sc.getConf().get("spark.checkpoint.dir")):
        if not (path := sc.getCheckpointDir()):
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="convolake-"))
            path = sc.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it can be removed when the application has ended."""
    return f"{shared_dir(spark)}/convolake-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, *watched: Column) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors redo no work before it.

    The frame's `saw` has the aggregates `watched` of what was written.
    """
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation() if watched else None
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # what the table was shuffled for is not read again
    try:
        (df.observe(seen, *watched) if watched else df).write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to, out.saw = path, seen.get if watched else {}
    return out


def drop(df: DataFrame) -> None:
    """Remove what cut() wrote, once nothing will read it again."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
