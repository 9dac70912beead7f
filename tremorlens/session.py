"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# What every job of this package assumes about the session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tremorlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Without the setting a cluster is refused, because its executors would each
    write to a disk of their own; one JVM (``local[n]``) makes itself a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table in the shared folder, and figures over its rows taken while it is written.

    One job computes, writes and measures; what follows reads the table, so the loss of an executor costs no more than a stage of it.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    watched = df.observe(seen, *(c.alias(k) for k, c in measures.items())) if measures else df
    watched.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if measures else {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table in the shared folder in place of the plan that leads to it: computed once, and safe from the loss of executors."""
    return written(df)[0]
