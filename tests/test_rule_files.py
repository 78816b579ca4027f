"""Every rule of every rule file hits lines (but the one that another shadows
on purpose and the one for PR runs)."""

import pytest
from pyspark.sql import functions as F

from closebook.operators import rules as R
from closebook.plans import flows as FL
from closebook.plans import q_rules as Q
from closebook.sources.testdata import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    df = FL.enrich_po(Tables(spark, SF)).cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("name, silent", [("special_lines", {"request_only"}), ("receipt_month", {"late_asset"})])
def test_every_status_hits(lines, name, silent):
    rs = R.load_rules(name)
    hit = {r.status for r in R.apply_rules(lines, rs, FL.ctx_for()).select("status").distinct().collect()}
    assert hit - {None} == {r.status for r in rs.rules} - silent


@pytest.mark.parametrize("name, n, doc", [("two_stage_po", 18, "PO"), ("two_stage_pr", 13, "PR"), ("receipt_month_pr", 8, "PR"), ("procurement", 13, "PO")])
def test_every_rule_hits(lines, name, n, doc):
    rs = R.load_rules(name)
    assert len(rs.rules) == n
    ctx = FL.ctx_for(doc_type=doc)
    ctx.closing_month = Q.CLOSING_MONTH
    hit = {r[0] for r in R.apply_rules(lines, rs, ctx).select("status_rule").distinct().collect()}
    assert hit - {None} == {r.no for r in rs.rules}


def test_every_label_rule_matches_and_remarks_follow(lines):
    ctx = FL.ctx_for()
    out = R.apply_rules(lines, R.load_rules("receipt_month"), ctx).cache()
    one = R.load_rules("labels")
    final = {r[0] for r in R.apply_rules(out, one, ctx, remark_col="m").select("status_rule").distinct().collect()}
    for r in one.rules:  # a rule may be overwritten by later ones on all its lines, but has to match by itself
        alone = R.RuleSet("alone", [r], mode="last")
        reads = any(c.get("field") == "status" for c in r.checks)
        assert r.no in final or not reads and R.apply_rules(out, alone, ctx, remark_col="m").where(F.col("status_rule") == r.no).count()
    remarks = {r[0] for r in R.apply_rules(out, R.load_rules("label_remarks"), ctx, remark_col="m").select("m").distinct().collect()}
    assert remarks == {None, "plates", "plates, sales and IT"}


LABELS = {"meta": {"name": "l", "mode": "last"}, "rules": [
    {"priority": 1, "status": "ops", "remark": "r1", "note": "n1", "checks": [{"type": "starts_with", "field": "department", "value": "10"}]},
    {"priority": 2, "status": "other", "note": "n2", "checks": [{"type": "not_starts_with", "field": "department", "value": "10"}, {"type": "contains", "field": "d", "pattern": "x"}]},
    {"priority": 3, "status": "ops done", "remark": "r3", "note": "n3", "checks": [{"type": "contains", "field": "status", "pattern": "^ops"}, {"type": "equals", "field": "p", "value": "done"}]}]}
REMARKS = {"meta": {"name": "m", "mode": "last", "writes": "remark"}, "rules": [
    {"priority": 1, "remark": "a", "note": "na", "checks": [{"type": "contains", "field": "d", "pattern": "x"}]},
    {"priority": 2, "note": "nb", "checks": [{"type": "contains", "field": "d", "pattern": "xx"}]}]}


def test_labels_on_literal_rows(spark):
    rows = [(1, "101", "x", None, "given", "old"), (2, "101", None, "done", None, "old"), (3, None, "x", None, "ops", "old"), (4, "201", "xx", "done", "ops", "old"),
            (5, "201", "y", "done", None, "old"), (6, None, "y", "done", "ops", "old")]
    df = spark.createDataFrame(rows, "i int, department string, d string, p string, status string, remark string")
    ctx = R.Ctx(run_month=202510, columns={})
    df = R.apply_rules(df, R.load_rules(LABELS), ctx, remark_col="remark", set_col="status_set")
    got = {r.i: (r.status, r.remark, r.status_set) for r in df.collect()}
    assert got == {1: ("ops", "r1", "l"), 2: ("ops done", "r3", "l"), 3: ("other", None, "l"), 4: ("other", None, "l"), 5: (None, "old", None), 6: ("ops done", "r3", "l")}
    df = R.apply_rules(df, R.load_rules(REMARKS), ctx, remark_col="remark")
    got = {r.i: (r.status, r.remark, r.status_note) for r in df.collect()}
    assert got[1] == ("ops", "a", "na") and got[3] == ("other", "a", "na") and got[4] == ("other", None, "nb") and got[2] == ("ops done", "r3", "n3")


def test_reset_drops_given_statuses_and_null_is_not_equal(spark):
    rs = R.load_rules({"meta": {"name": "p", "reset": True, "null_not_equals": True},
                       "rules": [{"priority": 1, "status": "a", "note": "n", "checks": [{"type": "not_equals", "field": "p", "value": "done"}]}]})
    df = spark.createDataFrame([(1, None, "given"), (2, "done", "given"), (3, "x", None)], "i int, p string, status string")
    assert {r.i: r.status for r in R.apply_rules(df, rs, R.Ctx(run_month=1, columns={})).collect()} == {1: "a", 2: None, 3: "a"}


def test_chained_sets_keep_set_and_rule_apart(spark):
    sets = [R.load_rules({"meta": {"name": n}, "rules": [{"priority": 1, "status": n, "note": n, "checks": [{"type": "equals", "field": "p", "value": n}]}]}) for n in ("a", "b")]
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    for rs in sets:
        df = R.apply_rules(df, rs, R.Ctx(run_month=1, columns={}), set_col="status_set")
    assert {r.p: (r.status_set, r.status_rule, r.status) for r in df.collect()} == {"a": ("a", 1, "a"), "b": ("b", 1, "b"), "c": (None, None, None)}
