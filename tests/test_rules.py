"""Rule compiler semantics on tiny frames (null/blank statuses, override,
last match, dropped checks, null-true not-equals)."""

from pyspark.sql import Row

from closebook.operators import rules as R

COLS = {"descr": "string", "gl_number": "string", "proc_remark": "string", "status": "string",
        "erm": "int", "period_start": "int", "period_end": "int", "period_ok": "boolean",
        "entry_qty": "bigint", "received_qty": "bigint"}


def frame(spark, rows):
    return spark.createDataFrame([Row(**{**{k: None for k in COLS}, **r}) for r in rows],
                                 schema=", ".join(f"{k} {v}" for k, v in COLS.items()))


def run(spark, rows, rules, mode="first", **meta):
    rs = R.rules_from_dict({"meta": {"mode": mode, **meta}, "rules": rules})
    df = frame(spark, rows)
    ctx = R.Ctx(run_month=199806, columns=COLS)
    out = R.apply_rules(df, rs, ctx).orderBy("descr").collect()
    return [(r["descr"], r["status"], r["status_rule"]) for r in out]


def test_first_match_only_open_rows(spark):
    rows = [{"descr": "a small ring"}, {"descr": "b ring", "status": "given"}, {"descr": "c other", "status": ""},
            {"descr": "d nan", "status": "nan"}]
    rules = [{"status": "ring", "checks": [{"type": "contains", "field": "descr", "pattern": "ring"}]},
             {"status": "small", "checks": [{"type": "contains", "field": "descr", "pattern": "small"}]},
             {"status": "rest", "checks": [{"type": "no_status"}]}]
    assert run(spark, rows, rules) == [("a small ring", "ring", 1), ("b ring", "given", None),
                                       ("c other", "rest", 3), ("d nan", "rest", 3)]


def test_override_rewrites_listed_status_only(spark):
    rows = [{"descr": "a small ring"}, {"descr": "b big ring"}, {"descr": "c small"}]
    rules = [{"status": "small", "checks": [{"type": "contains", "field": "descr", "pattern": "small"}]},
             {"status": "ring", "override": ["small"], "checks": [{"type": "contains", "field": "descr", "pattern": "ring"}]},
             {"status": "big", "checks": [{"type": "contains", "field": "descr", "pattern": "big"}]}]
    assert run(spark, rows, rules) == [("a small ring", "ring", 2), ("b big ring", "ring", 2), ("c small", "small", 1)]


def test_last_match_wins_and_status_reader_sees_earlier_writes(spark):
    rows = [{"descr": "a ring small"}, {"descr": "b ring"}]
    rules = [{"status": "ring", "checks": [{"type": "contains", "field": "descr", "pattern": "ring"}]},
             {"status": "small", "checks": [{"type": "contains", "field": "descr", "pattern": "small"}]},
             {"status": "ring2", "checks": [{"type": "equals", "field": "status", "value": "ring"}]}]
    assert run(spark, rows, rules, mode="last") == [("a ring small", "small", 2), ("b ring", "ring2", 3)]


def test_missing_column_drops_check_and_empty_rule_is_skipped(spark):
    rows = [{"descr": "x"}]
    rules = [{"status": "never", "checks": [{"type": "contains", "field": "nope", "pattern": "x"}]},
             {"status": "yes", "checks": [{"type": "contains", "field": "nope", "pattern": "x"},
                                          {"type": "contains", "field": "descr", "pattern": "x"}]}]
    assert run(spark, rows, rules) == [("x", "yes", 2)]


def test_not_equals_null_modes(spark):
    rows = [{"descr": "a", "proc_remark": None}, {"descr": "b", "proc_remark": "error"}, {"descr": "c", "proc_remark": "ok"}]
    rules = [{"status": "ne", "checks": [{"type": "not_equals", "field": "proc_remark", "value": "error"}]}]
    assert run(spark, rows, rules) == [("a", None, None), ("b", None, None), ("c", "ne", 1)]
    assert run(spark, rows, rules, null_not_equals=True) == [("a", "ne", 1), ("b", None, None), ("c", "ne", 1)]


def test_list_valued_reference_means_membership(spark):
    rows = [{"descr": "a", "gl_number": "199999"}, {"descr": "b", "gl_number": "520001"}, {"descr": "c"}]
    rules = [{"status": "not_fa", "checks": [{"type": "not_equals", "field": "gl_number", "value_key": "fa.spx"}]}]
    rs = {"meta": {"mode": "first"}, "refs": {"fa": {"spx": ["199999"]}}, "rules": rules}
    df = frame(spark, rows)
    out = R.apply_rules(df, R.rules_from_dict(rs), R.Ctx(run_month=199806, columns=COLS)).orderBy("descr").collect()
    assert [r["status"] for r in out] == [None, "not_fa", "not_fa"]


def test_erm_range_and_sentinel(spark):
    rows = [{"descr": "a", "erm": 199805, "period_start": 199801, "period_end": 199812, "period_ok": True},
            {"descr": "b", "erm": 199905, "period_start": 199801, "period_end": 199812, "period_ok": True},
            {"descr": "c", "erm": 199905, "period_start": 100001, "period_end": 100002, "period_ok": False}]
    rules = [{"status": "in", "checks": [{"type": "erm_in_range"}]},
             {"status": "out", "checks": [{"type": "out_of_range"}]},
             {"status": "bad", "checks": [{"type": "format_error"}]}]
    assert [s for _, s, _ in run(spark, rows, rules)] == ["in", "out", "bad"]


def test_sql_twin_matches_spark_on_fixture(spark):
    import duckdb

    rows = [{"descr": "a small ring", "proc_remark": "已完成", "erm": 199805, "entry_qty": 3, "received_qty": 3},
            {"descr": "b ring", "status": "given"}, {"descr": "c", "proc_remark": "error", "entry_qty": 1}]
    rs = R.rules_from_dict({"meta": {"mode": "first"}, "rules": [
        {"status": "done", "checks": [{"type": "remark_completed"}, {"type": "qty_matched"}]},
        {"status": "err", "checks": [{"type": "not_error"}], "override": ["given"]},
        {"status": "rest", "checks": [{"type": "qty_not_matched"}]}]})
    df = frame(spark, rows)
    ctx = R.Ctx(run_month=199806, columns=COLS)
    got = sorted((r["descr"], r["status"]) for r in R.apply_rules(df, rs, ctx).collect())
    con = duckdb.connect()
    con.register("fx", df.toPandas())
    sql = R.apply_rules_sql("SELECT * FROM fx", COLS, rs, R.Ctx(run_month=199806, columns=COLS))
    want = sorted((d, s) for d, s in con.execute(f"SELECT descr, status FROM ({sql}) x").fetchall())
    assert got == want == [("a small ring", "done"), ("b ring", "err"), ("c", "rest")]
