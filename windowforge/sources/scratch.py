"""Tables that are written to be read again, in the folder that a session names for that."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="windowforge-")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a session on one machine may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read again: what follows reads the files, not the sources, and restarts from them when an executor is lost.

    The files stay below spark.checkpoint.dir, as checkpoints do.
    """
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
