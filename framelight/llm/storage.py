"""Shared, durable storage for intermediate tables.

Every table that cuts lineage goes to the folder the cluster names in
``spark.checkpoint.dir``, so it outlives any executor. A private folder is
made only where that setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a private one when none is configured."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="framelight-")
    spark.conf.set(_SETTING, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, dictionary_mb: int = 1) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; larger dictionaries suit columns of many distinct values that recur, 0 MB is none and takes less time."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    writer = writer.option("parquet.dictionary.page.size", dictionary_mb << 20) if dictionary_mb else writer.option("parquet.enable.dictionary", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)
