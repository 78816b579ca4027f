"""Aggregations, reports, per-document broadcasts, de-duplication and set
operations (A-01 … A-19, W-01, O-01 … O-06, U-01 … U-03).

Per-document values (max ERM, document sums, "any line …") are computed as
a group-by on the document key and joined back, rather than as a window:
the group-by combines map-side, so a document holding a third of all lines
never has to be materialised in one task, and AQE can split a skewed
partition of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape_pivot(df: DataFrame, row: str, col: str, amount: str) -> DataFrame:
    """A-01: sum and count of ``amount`` by row × column with 'Total' margins
    (long form; one CUBE pass)."""
    amt = F.coalesce(F.col(amount).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    g = df.cube(row, col).agg(F.sum(amt).alias("total_amount"), F.count(F.lit(1)).alias("n"),
                              F.grouping(row).alias("_gr"), F.grouping(col).alias("_gc"))
    return g.select(
        F.when(F.col("_gr") == 1, F.lit("Total")).otherwise(F.col(row)).alias(row),
        F.when(F.col("_gc") == 1, F.lit("Total")).otherwise(F.col(col)).alias(col),
        F.col("total_amount").cast("double").alias("total_amount"), "n")


def dedup_last(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """O-01: the whole row with the greatest ``order`` per key."""
    b = df.groupBy(key).agg(F.max(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_b"))
    return b.select(key, F.col(f"_b.{order}").alias(order), *[F.col(f"_b.{v}").alias(v) for v in values])


def dedup_first(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """O-02: the whole row with the smallest ``order`` per key."""
    b = df.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(v) for v in values])).alias("_b"))
    return b.select(key, F.col(f"_b.{order}").alias(order), *[F.col(f"_b.{v}").alias(v) for v in values])


def union_all(frames: list[DataFrame | None]) -> DataFrame:
    """U-01: union by name, skipping missing inputs; one input passes through."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no input frames")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def profile_columns(df: DataFrame, texts: list[str], numbers: list[str], shares: dict[str, float], accuracy: int = 100_000) -> DataFrame:
    """A-09: one row per column, by its type.

    Numbers: mean, standard deviation, least, quantiles and greatest value as
    numbers, in one pass; quantiles are values of the column with a rank error of
    at most rows / ``accuracy``, in bounded memory.  Texts: distinct values,
    least, greatest and most frequent one (ties: the least) from one count per
    (column, value), combined before the shuffle.
    """
    given = df.select(*texts, *numbers)
    aggs = []
    for c in numbers:
        x = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("nulls"),
                          F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("min_value"),
                          F.percentile_approx(x, list(shares.values()), accuracy).alias("q"), F.max(x).alias("max_value")).alias(c)]
    n = given.agg(*aggs).select(F.explode(F.array(*numbers)).alias("r")).select("r.*")
    n = n.select("*", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(shares)]).drop("q")
    long = given.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in texts])).alias("r"))
    by = long.select("r.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    most = F.min(F.when(known, F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))))
    t = by.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"), F.min("value").alias("min_text"), F.max("value").alias("max_text"),
        most.getField("v").alias("top"), (-most.getField("k")).alias("freq"))
    out = t.unionByName(n, allowMissingColumns=True)
    return out.withColumn("null_ratio", F.try_divide(F.col("nulls").cast("double"), (F.col("non_null") + F.col("nulls")).cast("double")))
