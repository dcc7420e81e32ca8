"""Shared helpers: durable intermediate tables and ASCII word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets one of our own; any other has executors that would not see it, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cytomix-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage that outlives an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least two tasks a core, so that a few large input files do not idle the cluster."""
    n = df.sparkSession.sparkContext.defaultParallelism * 2
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


#: Rows, and items in their arrays, of a stored table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_ITEMS = 250_000, 8_000_000


def join_stored(df: DataFrame, stored: DataFrame, on: list[str], how: str = "inner", items: str | Column | None = None) -> DataFrame:
    """df joined to a stored table of narrow rows, which is broadcast only if its counted rows, and the items of the array column named (or what else items counts in a row), are few."""
    counted = F.lit(0) if items is None else F.sum(F.size(items) if isinstance(items, str) else items)
    size = stored.agg(F.count(F.lit(1)).alias("rows"), counted.alias("items")).head()
    few = size["rows"] <= BROADCAST_ROWS and (size["items"] or 0) <= BROADCAST_ITEMS
    return df.join(F.broadcast(stored) if few else stored, on, how)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def runs(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """text cut before white space into runs of about size bytes, so that the words of a long text need not be held at once."""
    at = 0
    while len(text) - at > size:
        cut = _BLANK.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]
