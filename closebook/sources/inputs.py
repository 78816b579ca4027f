"""File sets of a run: required, optional and either-or inputs (S-15, S-23, P-09)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Input:
    """One input: where it is, how it is read, which columns it must have."""

    path: str
    format: str = "parquet"
    required: bool = False
    columns: tuple[str, ...] = ()
    not_empty: bool = False


def require_columns(df: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """P-09: ``df`` itself; raises, before any job, if it lacks columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df


def _open(spark: SparkSession, spec: Input) -> DataFrame | None:
    reader = spark.read.format(spec.format)
    if spec.format == "csv":
        reader = reader.option("header", True)
    try:
        return reader.load(spec.path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise  # a file that is there but can't be read is no missing input


def load_inputs(spark: SparkSession, specs: dict[str, Input], one_of: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """S-15, S-23: the inputs that exist, as plans that nothing has read yet.

    A missing required input raises, a missing optional one is left out, and
    of ``one_of`` at least one must be there.  Columns are checked for every
    input found; emptiness, by one row, only where the spec asks for it."""
    found = {}
    for name, spec in specs.items():
        df = _open(spark, spec)
        if df is None:
            if spec.required:
                raise FileNotFoundError(f"required input {name} is not at {spec.path}")
            continue
        found[name] = require_columns(df, spec.columns, name)
        if spec.not_empty and df.isEmpty():
            raise ValueError(f"{name} has no rows")
    if one_of and not any(n in found for n in one_of):
        raise FileNotFoundError(f"none of {', '.join(one_of)} is there; one is needed")
    return found
