"""Tables written once in the folder that all executors share: lineage ends there, and a lost executor loses nothing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local sessions, which have no other executors, a folder is made and set where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="junctura-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/junctura-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back; sizes are then known to the planner."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._cut_path = path
    return got


def discard(*tables: DataFrame | None) -> None:
    """Remove what cut() wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
