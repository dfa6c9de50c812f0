"""Tables that an operator writes on its way, in the folder the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table and read again: its lineage ends there, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assayer-{uuid.uuid4().hex}/{name}"
    # Spark removes a finished plan's shuffle files once the driver has collected the plan; without this they all add up. What a
    # caller still held when its table was written goes before the next one.
    _collect(spark)
    df.write.option("compression", "zstd").parquet(path)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)
