"""Helpers shared by the operators: shared folders, prefix sums without a hot
task, and word splitting for Arrow batches."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space of the word contracts (a word is `[^\x20\x09-\x0D]+`).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    The setting names the folder that driver and executors share.  Where it is
    unset (tests), the folder of the SparkContext's checkpoint directory is
    used, and without either this raises: a machine-local folder would lose
    rows on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{base.rstrip('/')}/llm/{kind}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    a lost executor costs a re-read and not a recomputation."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    return max(1, math.ceil(rows / per_bucket))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters);
    pure ASCII texts take the cheap way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def with_prefix(df: DataFrame, group: list[str], bucket: str, order: list[Column], amount: Column,
                out: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each row of its group, in the
    order (bucket, order).

    Two levels: inside a (group, bucket) a window, across the buckets of a
    group a running sum of one row per bucket.  A group that holds a third of
    all rows is spread over its buckets, so no task sees a whole group.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(
        before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return (rows.alias("r").join(starts.alias("s"), on)
            .select("r.*", (F.col("_inside") + F.col("_start")).cast("long").alias(out)).drop("_inside"))
