"""What goes through shuffles and files: lines carry results of checks, not the
texts; remarks are shuffled once; written lines are compressed."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from closebook.operators import documents as D
from closebook.operators import rules as R
from closebook.operators.lookups import remark_with_fallback
from closebook.plans import q_sources as S
from closebook.sources import adapter as A
from closebook.sources import io
from closebook.sources.testdata import Tables, spread

SF = "/root/testdata/sf0.001"


@pytest.fixture
def conf(spark):
    old = {}

    def put(**kv):
        for k, v in ((f"spark.sql.{k.replace('_', '.')}", v) for k, v in kv.items()):
            old.setdefault(k, spark.conf.get(k))
            spark.conf.set(k, v)
    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df, key: str) -> list[set]:
    """The columns of every shuffle by ``key``."""
    node, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName() == "Exchange" and f"hashpartitioning({key}" in p.outputPartitioning().toString():
            out = p.output()
            found.append({out.apply(i).name() for i in range(out.size())})
        for i in range(p.children().size()):
            walk(p.children().apply(i))
    walk(node)
    return found


@pytest.mark.parametrize("name", ["accrual_flag", "account_lookup", "shape_compare", "status_labels", "status_sct", "status_stage1"])
def test_lookups_carry_no_text_that_only_rules_read(spark, conf, name):
    conf(adaptive_enabled="false", autoBroadcastJoinThreshold="-1")
    [lines] = [c for c in shuffled(E.queries()[name](spark, SF), "po_line") if R.MARKS + "0" in c]
    assert not lines & {"item_description", "project", "closed_for_invoice"}


def test_marked_checks_decide_as_unmarked_ones(spark):
    df = spark.createDataFrame([("old gear", "BR1", 10, 10, 199805, 199801, 199812, True), (None, None, None, None, None, 100001, 100002, False), ("Gear", "BR2", 5, None, 199901, 199901, 199902, True),
                                ("x", "", 0, 0, 199806, None, None, None)],
                               "d string, p string, entry_qty bigint, received_qty bigint, erm int, period_start int, period_end int, period_ok boolean")
    checks = [{"type": "contains", "field": "d", "pattern": "gear"}, {"type": "not_contains", "field": "d", "pattern": "(?i)gear"}, {"type": "equals", "field": "entry_qty", "value": "10.0", "cast": "Float64"},
              {"type": "not_equals", "field": "p", "value": "BR1"}, {"type": "is_null", "field": "p"}, {"type": "qty_not_matched"}, {"type": "out_of_range"}, {"type": "desc_erm_gt_date"},
              {"type": "format_error"}, {"type": "erm_le_date"}, {"type": "contains", "field": "missing", "pattern": "x"}, {"type": "no_status"}]
    for combine in ("and", "or"):
        for nulls in (False, True):
            sets = [R.rules_from_dict({"meta": {"null_not_equals": nulls}, "rules": [{"status": f"s{i}", "combine": combine, "checks": [a, b]}]}) for i, a in enumerate(checks) for b in checks]
            ctx = R.Ctx(run_month=199806, columns=dict(df.dtypes))
            marked = R.mark_own_checks(df, sets, ctx)
            assert len(ctx.marks) == 10 and R.MARKS + "0" in marked.columns
            for rs in sets[::7]:
                plain = R.apply_rules(df, rs, R.Ctx(run_month=199806, columns=dict(df.dtypes)))
                assert R.apply_rules(marked, rs, ctx).select("d", "status", "status_rule").collect() == plain.select("d", "status", "status_rule").collect()


def test_more_checks_than_one_word_holds(spark):
    df = spark.createDataFrame([(str(i),) for i in range(130)], "d string")
    rs = R.rules_from_dict({"rules": [{"status": f"s{i}", "checks": [{"type": "equals", "field": "d", "value": str(i)}]} for i in range(130)]})
    ctx = R.Ctx(run_month=199806, columns={"d": "string"})
    marked = R.mark_own_checks(df, [rs], ctx)
    assert marked.columns == ["d", "_marks0", "_marks1", "_marks2"]
    assert all(r.status == f"s{r.d}" for r in R.apply_rules(marked, rs, ctx).collect())


def test_remarks_under_both_keys_are_shuffled_once(spark, conf):
    conf(adaptive_enabled="false", autoBroadcastJoinThreshold="-1")
    rem = spark.createDataFrame([("PO1", "PR1", "z", 1), ("PO1", "PR1", "a", 2), ("PO2", "PR2", "x", 1), ("PO2", "PR2", None, 2), (None, "PR3", "late", 1), (None, "PR2", "by request", 3),
                                 ("PO5", None, None, 1), (None, None, "lost", 1)], "p string, r string, remark string, _ord bigint")
    lines = spark.createDataFrame([("PO1", "PR1"), ("PO2", "PR2"), ("PO3", "PR3"), ("PO4", "PR4"), ("PO5", "PR5"), (None, None)], "p string, r string")
    out = remark_with_fallback(lines, rem, "p", "r", "remark", "t", "f", A.pr_to_po_line(F.col("r")))
    assert plan(out).count("Exchange hashpartitioning") == 2
    assert out.columns == ["p", "r", "t", "f"]
    got = {x.p: (x.t, x.f) for x in out.collect()}
    assert got == {"PO1": ("a", True), "PO2": ("by request", True), "PO3": ("late", True), "PO4": (None, False), "PO5": (None, True), None: (None, False)}


def test_a_scan_of_enough_parts_is_not_dealt(spark, conf, tmp_path):
    rows = spark.range(400_000).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert "Rebalance" in spread(Tables(spark, str(tmp_path)).lineitem)._jdf.queryExecution().optimizedPlan().toString()
    conf(files_maxPartitionBytes="64k", files_openCostInBytes="4k")
    assert "Rebalance" not in spread(Tables(spark, str(tmp_path)).lineitem)._jdf.queryExecution().optimizedPlan().toString()


def test_raw_lines_are_shuffled_as_small_numbers(spark, conf):
    conf(adaptive_enabled="false", autoBroadcastJoinThreshold="-1")
    for key in ("l_orderkey", "l_partkey"):
        [cols] = shuffled(A.po_raw(Tables(spark, SF)), key)
        assert not cols & {"l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "o_orderpriority", "o_orderstatus"}


def test_snapshots_and_the_landed_extract_are_compressed(spark):
    path = io.snapshot(spark.range(10), spark, "t", "PO", 199806, "test")
    assert io.resume(spark, path).count() == 10
    assert [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".zstd.parquet")]
    files = S.scan_csv(spark, SF).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_deposit_lines_may_be_told_by_a_column(spark):
    df = spark.createDataFrame([("a", "1", "Deposit x", 199901, "open"), ("b", "1", "x", 199801, "posted"), ("c", "1", None, None, None), ("d", "2", "deposit", 199801, "open"), ("e", None, "deposit", 199901, None)],
                               "po_line string, po_number string, item_description string, erm int, status string")
    told = df.withColumn("deposit", D.has(F.col("item_description"), "deposit")).drop("item_description")
    by_text = {r.po_line: r.deposit_status for r in D.deposit_status(df, 199806, "deposit").collect()}
    assert {r.po_line: r.deposit_status for r in D.deposit_status(told, 199806, F.col("deposit")).collect()} == by_text
    assert by_text == {"a": "incomplete_deposit", "b": "posted", "c": "incomplete_deposit", "d": "open", "e": None}
