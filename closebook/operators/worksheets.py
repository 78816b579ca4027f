"""Worksheets with headers as typed: line keys, aliases, formulas (J-15, P-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_line_key(df: DataFrame, key: str, document: str, line: str) -> DataFrame:
    """``df`` with the line key, built as document-line where it has none.  Both
    sides of a lookup carry the dash, so that keys of the two sheets agree."""
    return df if key in df.columns else df.withColumn(key, F.concat(F.col(document), F.lit("-"), F.col(line)))


def prepare_worksheet(df: DataFrame, filter_column: str, filter_value: str, standard: list[str], aliases: dict[str, list[str]],
                      formulas: dict[str, list[str]] | None = None) -> DataFrame:
    """P-10: headers to lower case with underscores; a standard column that is
    missing takes the first alias present, else the texts of its formula's
    columns end to end; rows by the filter where its column is there; of the
    standard columns those that exist, in order.  Two headers that fall
    together raise."""
    names = [c.lower().replace(" ", "_") for c in df.columns]
    for target, sources in aliases.items():
        found = next((s for s in sources if s in names), None)
        if target not in names and found:
            names[names.index(found)] = target
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"headers fall together: {', '.join(twice)}")
    df = df.toDF(*names)
    for target, parts in (formulas or {}).items():
        if target not in names and all(p in names for p in parts):
            df = df.withColumn(target, F.concat(*[F.col(f"`{p}`").cast("string") for p in parts]))
    if filter_column in names:
        df = df.where(F.col(f"`{filter_column}`") == filter_value)
    return df.select(*[c for c in standard if c in df.columns])


def lead_columns(df: DataFrame, lead: list[str]) -> DataFrame:
    """P-11: the leading columns that exist, in order, then the others."""
    first = [c for c in lead if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in first + [c for c in df.columns if c not in first]])
