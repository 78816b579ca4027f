"""Lazy access to the driver's parquet tables.

Reads are plain ``spark.read.parquet``; Catalyst prunes columns and pushes
filters into each scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """``Tables(spark, sf_dir).lineitem`` → DataFrame of that parquet file."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores where its scan has fewer parts than these:
    one shuffle without a key, so a hot key is split too.  A scan with as many
    files or parts of files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.rdd.getNumPartitions() >= cores:
        return df
    return df.hint("rebalance")
