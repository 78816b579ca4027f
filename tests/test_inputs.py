"""File sets: required, optional and either-or inputs, and the PR copy."""

import pytest

from closebook.operators.lookups import copy_pr_columns
from closebook.sources.inputs import Input, load_inputs

REGION = "/root/testdata/sf0.001/region.parquet"
NOWHERE = "/root/testdata/sf0.001/nowhere.parquet"


def test_missing_inputs(spark):
    got = load_inputs(spark, {"a": Input(REGION, required=True, columns=("r_name",), not_empty=True), "b": Input(NOWHERE)}, one_of=("a", "b"))
    assert list(got) == ["a"] and got["a"].count() == 5
    with pytest.raises(FileNotFoundError):
        load_inputs(spark, {"a": Input(NOWHERE, required=True)})
    with pytest.raises(FileNotFoundError):
        load_inputs(spark, {"a": Input(REGION), "po": Input(NOWHERE), "pr": Input(NOWHERE)}, one_of=("po", "pr"))


def test_columns_and_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="r_size"):
        load_inputs(spark, {"a": Input(REGION, columns=("r_name", "r_size"))})
    (tmp_path / "x.csv").write_text("k,v\n")
    path = str(tmp_path / "x.csv")
    assert load_inputs(spark, {"x": Input(path, "csv", columns=("k",))})["x"].columns == ["k", "v"]
    with pytest.raises(ValueError, match="no rows"):
        load_inputs(spark, {"x": Input(path, "csv", not_empty=True)})


def test_pr_columns_overwrite(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "r string, r_pr string")
    assert [tuple(x) for x in copy_pr_columns(df, ["r", "absent"]).collect()] == [(None, None), ("c", "c")]
