"""Folders that the driver and all executors share, for what a step writes before a later one reads it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all of Spark is this one process, as in tests, it is a folder of this machine; else that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = getattr(spark.sparkContext, "_scratch_dir", None) or tempfile.mkdtemp(prefix="corpusloom-scratch-")
        spark.sparkContext._scratch_dir = shared
    return f"{shared}/scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a folder of its own and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that ``written`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
