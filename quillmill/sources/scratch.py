"""A folder of our own below the one that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """spark.checkpoint.dir as the session has it; set here only where it is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
        top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing refers to any more, once the driver has collected them."""
    gc.collect()
    spark._jvm.System.gc()
