"""Tables in the shared folder, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, which only local mode allows, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once for all that use it, and safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 1 on, in the order over all rows; only one number per partition meets in one task."""
    at = F.monotonically_increasing_id()
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")  # one row per partition
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_LOW_BITS) + 1).drop("_at", "_part", "_before")
