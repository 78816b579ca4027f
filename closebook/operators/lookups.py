"""Joins and lookups (J-01 … J-19).

Every lookup first reduces the side table to one row per key with a
group-by (partial aggregation runs map-side, so a hot key is combined before
the shuffle), then left-joins it: the line count is preserved by
construction.  Side tables that grow with the data are left to the planner
(sort-merge, or AQE's runtime broadcast once the reduced side is measured
small); only tables with a bound fixed by construction are hinted with
``broadcast_bounded``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_non_null(df: DataFrame, key: str, order: str, fields: Iterable[str]) -> DataFrame:
    """Per key, each field's value from the row with the greatest ``order``
    among rows where that field is not null ("last duplicate wins", nulls
    dropped before the lookup)."""
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))
            .getField("v").alias(f) for f in fields]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def map_fields(lines: DataFrame, source: DataFrame, key: str, mappings: list[tuple[str, str, bool]],
               order: str = "_ord") -> DataFrame:
    """J-04/J-06/J-15: copy fields of a keyed side table onto the lines.
    ``mappings`` = (source field, target column, fill_na); with
    ``fill_na=False`` an existing target keeps its value where unmatched."""
    srcs = list(dict.fromkeys(s for s, _, _ in mappings))
    side = last_non_null(source, key, order, srcs)
    side = side.select(key, *[F.col(s).alias(f"_m_{s}") for s in srcs])
    out = lines.join(side, key, "left")
    for src, tgt, fill_na in mappings:
        new = F.col(f"_m_{src}")
        if not fill_na and tgt in lines.columns:
            new = F.coalesce(new, F.col(tgt))
        out = out.withColumn(tgt, new)
    return out.drop(*[f"_m_{s}" for s in srcs])


def copy_pr_columns(lines: DataFrame, columns: Iterable[str], suffix: str = "_pr") -> DataFrame:
    """J-07: in a PR run each column that is there takes the value of its PR
    twin, null included."""
    return lines.withColumns({c: F.col(c + suffix) for c in columns if c in lines.columns})


PERIOD = r"^\d{4}(0[1-9]|1[0-2])$"


def asof_latest(lines: DataFrame, events: DataFrame, key: str, period_col: str, run_month: int,
                values: list[str], period_alias: str, order: str = "_ord") -> DataFrame:
    """J-02/J-03: per key the event with the latest period ≤ run month, of
    equal ones the last by ``order``, left-joined onto the lines.  A period is
    YYYYMM; anything else counts as 0."""
    txt = F.col(period_col).cast("string")
    p = F.coalesce(F.when(txt.rlike(PERIOD), txt.cast("int")), F.lit(0))
    ev = events.where(F.col(key).isNotNull()).withColumn("_p", p).where(F.col("_p") <= run_month)
    best = (ev.groupBy(key).agg(F.max(F.struct("_p", order, *values)).alias("_b"))
            .select(key, F.col("_b._p").cast("bigint").alias(period_alias),
                    *[F.col(f"_b.{v}").alias(v) for v in values]))
    return lines.join(best, key, "left")


def remark_with_fallback(lines: DataFrame, remarks: DataFrame, primary: str, fallback: str,
                         remark: str, target: str, flag: str,
                         fallback_to_primary: Column | None = None, order: str = "_ord") -> DataFrame:
    """J-08: remark by the primary line key, else by the fallback key; of
    several rows the last by ``order`` counts, also where its remark is null.
    ``flag`` tells whether the line is in the remark list at all (J-09).

    When the fallback key maps one-to-one onto the primary key
    (``fallback_to_primary``), each remark row is listed under both keys and
    one group-by holds the last remark of either: one shuffle of the remarks,
    one join, and the lines keep their partitioning on the primary key."""
    if fallback_to_primary is not None:
        keys = F.array(F.struct(F.col(primary).alias("k"), F.lit(True).alias("p")),
                       F.struct(fallback_to_primary.alias("k"), F.lit(False).alias("p")))
        row = F.struct(F.col(order).alias("o"), F.col(remark).alias("v"))
        by = (remarks.select(F.explode(keys).alias("_k"), row.alias("_row")).where(F.col("_k.k").isNotNull())
              .groupBy(F.col("_k.k").alias(primary))
              .agg(F.max(F.when(F.col("_k.p"), F.col("_row"))).alias("_r1"), F.max(F.when(~F.col("_k.p"), F.col("_row"))).alias("_r2")))
        return (lines.join(by, primary, "left")
                .withColumn(target, F.coalesce(F.col("_r1.v"), F.col("_r2.v")))
                .withColumn(flag, F.col("_r1").isNotNull() | F.col("_r2").isNotNull()).drop("_r1", "_r2"))
    last = F.max(F.struct(order, remark)).getField(remark)
    by_p = (remarks.where(F.col(primary).isNotNull()).groupBy(primary)
            .agg(last.alias("_r1"), F.lit(True).alias("_in1")))
    by_f = (remarks.where(F.col(fallback).isNotNull()).groupBy(fallback)
            .agg(last.alias("_r2"), F.lit(True).alias("_in2")))
    out = lines.join(by_p, primary, "left").join(by_f, fallback, "left")
    return (out.withColumn(target, F.coalesce("_r1", "_r2"))
               .withColumn(flag, F.coalesce(F.col("_in1"), F.col("_in2"), F.lit(False)))
               .drop("_r1", "_r2", "_in1", "_in2"))


def join_generic(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 suffix: str = "_aux") -> DataFrame:
    """J-01: join an auxiliary table; clashing non-key columns of the right
    side get ``suffix``."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    right = right.select(*[F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in right.columns])
    return left.join(right, on, how)


def dedup_lookup(ref: DataFrame, key: str, value: str, order: Column | None = None,
                 first: bool = True) -> DataFrame:
    """One value per key of a reference table (Q10: de-duplicate, then join by
    key — never assign by position)."""
    o = order if order is not None else F.col(value)
    agg = F.min if first else F.max
    return (ref.where(F.col(key).isNotNull())
            .groupBy(key).agg(agg(F.struct(o.alias("o"), F.col(value).alias("v"))).getField("v").alias(value)))
