"""Lookups, the closing list and the profile on literal rows."""

import pytest

from closebook.operators import aggregates as AG
from closebook.operators.lookups import asof_latest, remark_with_fallback
from closebook.plans import q_lookups as Q

CLOSING = "po_number string, line_spec string, done string, new_pr string"


@pytest.mark.parametrize("spec, numbers", [("Line1~3、5", [1, 2, 3, 5]), ("Line1、abc", [1]), ("Line5~3", []), ("Line 7, 8", [7, 8]), ("Line1~2~3", []), ("ALL", []),
                                           ("1~3", []), ("Line", []), (None, []), ("Line99999999999999999999", []), ("Line1~2500", list(range(1, 2501)))])
def test_line_specs(spark, spec, numbers):
    df = spark.createDataFrame([("P", spec, "V", "R")], CLOSING)
    assert sorted(r.line_no for r in Q.expand_line_spec(df).collect()) == numbers


def test_closing_status_needs_a_new_request_and_reads_long_spans(spark):
    cl = spark.createDataFrame([("A", "ALL", "V", "R1"), ("A", "Line2~1000000000", "", "R1"), ("B", "ALL", "V", None), ("B", "Line1", "V", ""), ("C", "Line1", None, "R"),
                                ("D", "Linex、3", "V", "R"), ("E", "ALL", " ", "R")], CLOSING)
    lines = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", None), ("B", "1"), ("C", "1"), ("C", "2"), ("D", "3"), ("E", "9"), (None, "1")], "po_number string, line_number string")
    got = {(r.po_number, r.line_number): r.closing_status for r in Q.closing_status(lines, cl).collect()}
    assert got == {("A", "1"): "closed", ("A", "2"): "to_close", ("A", None): "closed", ("B", "1"): None, ("C", "1"): "to_close", ("C", "2"): None,
                   ("D", "3"): "closed", ("E", "9"): "to_close", (None, "1"): None}


def test_latest_invoice_by_period_then_row_order(spark):
    ev = spark.createDataFrame([("a", "202509", "z", 1), ("a", "202509", "b", 2), ("a", "202511", "x", 3), ("b", "bad", "m", 1), ("b", "2025091234", "n", 2), ("b", "202513", "o", 3),
                                ("c", "202512", "p", 1), (None, "202501", "q", 1)], "k string, period string, v string, _ord bigint")
    lines = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = {r.k: (r.gl, r.v) for r in asof_latest(lines, ev, "k", "period", 202510, ["v"], "gl").collect()}
    assert got == {"a": (202509, "b"), "b": (0, "o"), "c": (None, None), None: (None, None)}


def test_last_remark_counts_then_the_fallback_key(spark):
    rem = spark.createDataFrame([("P1", "R1", "z", 1), ("P1", "R1", "a", 2), ("P2", "R2", "x", 1), ("P2", "R2", None, 2), (None, "R3", "late", 1), (None, "R2", "by request", 3)],
                                "p string, r string, remark string, _ord bigint")
    lines = spark.createDataFrame([("P1", "R1"), ("P2", "R2"), ("P3", "R3"), ("P4", "R4"), (None, None)], "p string, r string")
    got = {x.p: (x.t, x.f) for x in remark_with_fallback(lines, rem, "p", "r", "remark", "t", "f").collect()}
    assert got == {"P1": ("a", True), "P2": ("by request", True), "P3": ("late", True), "P4": (None, False), None: (None, False)}


def test_profile_by_type(spark):
    df = spark.createDataFrame([("b", 10.0), ("b", 9.0), ("a", 100.0), ("a", None), (None, 2.0)], "t string, x double")
    got = {r.column: r for r in AG.profile_columns(df, ["t"], ["x"], {"q50": 0.5}).collect()}
    t, x = got["t"], got["x"]
    assert (t.non_null, t.nulls, t.distinct_values, t.top, t.freq, t.min_text, t.max_text, t.null_ratio) == (4, 1, 2, "a", 2, "a", "b", 0.2)
    assert (x.min_value, x.q50, x.max_value, x["mean"], x.nulls, x.top) == (2.0, 9.0, 100.0, 30.25, 1, None)
