"""Written intermediate tables.

A few steps need an input that is computed exactly once (row sequence numbers)
or a plan with short lineage (the call-tree rounds). Those are written as
parquet below the folder the cluster names in ``spark.checkpoint.dir``, which
all executors share, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sessionlogs-")


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A temporary folder is made only for a local master without the setting.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _local_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a fresh path and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
