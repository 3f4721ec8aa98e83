"""Tables that are written once and read by several steps, and dense numbers for rows."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOCAL = "/tmp/checkpoints/tracklight"
PLACES = 33  # bits of the place within a partition in monotonically_increasing_id


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. One machine alone may do without the setting."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return LOCAL
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a folder when it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end: what is to last must be written elsewhere by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        for path in paths:
            delete(spark, path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and goes when the driver ends."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``materialize`` for steps that take what keeps a table as a parameter."""
    return materialize(df, "kept")


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in an order, from 0 without gaps: sorted by ranges, then moved by the rows of the ranges before."""
    placed = materialize(df.orderBy(*order).withColumn("_dense_id", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_dense_id", PLACES)
    parts = placed.groupBy(part.alias("_dense_part")).agg(F.count(F.lit(1)).alias("_dense_n"))
    parts = parts.select("_dense_part", (F.sum("_dense_n").over(W.orderBy("_dense_part")) - F.col("_dense_n")).alias("_dense_before"))  # a row per partition
    at = F.col("_dense_before") + F.col("_dense_id").bitwiseAND((1 << PLACES) - 1)
    return placed.join(parts, part == F.col("_dense_part")).withColumn(name, at).drop("_dense_id", "_dense_part", "_dense_before")
