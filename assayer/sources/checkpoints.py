"""Tables that must stay as they are once made, in the folder the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="spark-"))
    return named


def checkpointed(df: DataFrame, collect: bool = False) -> DataFrame:
    """``df`` written below the shared folder and read from there; with ``collect`` the driver then collects its garbage, so that Spark removes the
    shuffle files of finished plans.

    It is a table and not ``checkpoint()``, as that keeps what the optimiser inferred of the plan, which grows with every round of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/assayer-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if collect:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
