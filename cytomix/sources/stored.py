"""Intermediate tables in the cluster's shared folder, and joins that broadcast only what is known to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a stored table of narrow rows that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 250_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back: short lineage, and lost executors cost no more than one step.

    Without that setting a local master gets a temporary folder; any other raises an error, as executors would not see each other's files.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cytomix-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a hint to broadcast it if it has most rows at most. Counting reads it once more, so use it on tables that sums have made small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
