"""Document verdicts and account prediction on literal rows."""

import pytest

from closebook.operators import documents as D
from closebook.operators import predict as P
from closebook.plans import q_verdicts as Q
from closebook.sources import adapter as A
from closebook.sources.testdata import Tables

RUN = 202510
LINES = "po_number string, po_line string, gl_number string, item_description string, erm int, proc_remark string, status string, status_note string, accrue string"
RULES = D.AssetRules(asset_accounts=("171000",))


def run(spark, rows):
    """rows: (document, line, account, text, month, remark, status)."""
    df = spark.createDataFrame([(*r, "old", "N") for r in rows], LINES)
    return {r.po_line: (r.status, r.status_note, r.accrue) for r in D.asset_status(df, RULES, RUN).collect()}


def test_acceptance_month_and_remark_complete_a_document(spark):
    got = run(spark, [("A", "1", "171000", "設備訂金", 202508, "已完成", None), ("A", "2", "5", "設備驗收款", 202510, None, None),
                      ("A", "3", "5", "驗收 保固", 202612, None, None)])
    assert set(got.values()) == {("已完成(asset)", D.ASSET_NOTES["accepted"], "Y")}


@pytest.mark.parametrize("month, remark, verdict", [(202511, "已完成", "not_due"), (202509, None, "not_confirmed"), (202509, "未完成", "not_confirmed"),
                                                    (202511, None, "not_due")])
def test_incomplete_documents(spark, month, remark, verdict):
    got = run(spark, [("A", "1", "171000", "x", 202501, remark, None), ("A", "2", "5", "驗收款", month, None, "to_check")])
    assert set(got.values()) == {("未完成(asset)", D.ASSET_NOTES[verdict], "N")}


def test_latest_acceptance_month_decides_and_months_may_miss(spark):
    got = run(spark, [("A", "1", "5", "驗收款 1", 202509, "已完成", None), ("A", "2", "5", "驗收款 2", 202512, None, None),
                      ("B", "3", "5", "驗收款", None, "PR 已完成", None), ("C", "4", "5", "驗收款", None, None, "x")])
    assert got["1"][1] == got["2"][1] == D.ASSET_NOTES["not_due"]
    assert got["3"] == ("已完成(asset)", D.ASSET_NOTES["remark_only"], "Y")
    assert got["4"] == ("x", "old", "N")


def test_protected_lines_other_documents_and_null_numbers_stay(spark):
    got = run(spark, [("A", "1", "171000", "驗收", 202509, "已完成", "posted"), ("A", "2", "5", None, None, None, None),
                      ("B", "3", "5", "supplies", 202509, "已完成", "y"), (None, "4", "171000", "驗收", 202509, "已完成", None),
                      ("D", "5", None, None, 202509, "已完成", None)])
    assert got["1"] == ("posted", "old", "N") and got["2"][0] == "已完成(asset)"
    assert got["3"] == ("y", "old", "N") and got["4"] == got["5"] == (None, "old", "N")


def test_deposit_by_description_and_latest_month_of_the_document(spark):
    rows = [("A", "1", "Deposit for rooms", 202501, "open"), ("A", "2", "chairs", 202512, "posted"), ("A", "3", None, None, None),
            ("B", "4", "deposit", 202512, "posted"), ("B", "5", "x", 202512, "open"), ("C", "6", "deposit", 202510, "open")]
    df = spark.createDataFrame(rows, "po_number string, po_line string, item_description string, erm int, status string")
    got = {r.po_line: r.deposit_status for r in D.deposit_status(df, RUN, "deposit").collect()}
    assert got == {"1": "incomplete_deposit", "2": "posted", "3": "incomplete_deposit", "4": "posted", "5": "open", "6": "open"}


def test_deposit_status_changes_lines_of_the_table(spark):
    df = Q.deposit_status(spark, "/root/testdata/sf0.001")
    assert 0 < df.where("deposit_status = 'incomplete_deposit'").count() < df.count()


FIELDS = "department string, supplier string, product_code string, item_description string, entry_amount string"
TABLE = [
    P.AccountRule("1", "list and words", departments=("Sales", "IT"), keywords="office|rent"),
    P.AccountRule("2", "supplier", liability="9", supplier="S1"),
    P.AccountRule("3", "prefix, from, below", liability="8", department="10", min_amount=100, max_amount=200),
    P.AccountRule("4", "product", product_code="BR1", department="0"),
    P.AccountRule("5", "below", max_amount=50),
]


@pytest.mark.parametrize("row, rule", [
    (("Sales", "S1", "BR1", "OFFICE chairs", "10"), 1), (("IT", "x", "x", "Rent", None), 1), (("Sales", "S1", "BR1", None, "10"), 2),
    (("HR", "S1", None, "rent", None), 2), (("101 Ops", "x", "BR1", "x", "100"), 3), (("101 Ops", "x", "BR1", "x", "199.99"), 3),
    (("101 Ops", "x", "BR1", "x", "200"), 4), (("110 Ops", "x", "x", "x", "150"), None), ((None, None, "BR1", None, "bad"), 4),
    ((None, None, None, None, "49.9"), 5), ((None, None, None, None, "50"), None), ((None, None, None, None, "1,0"), None), ((None,) * 5, None)])
def test_first_rule_whose_conditions_hold(spark, row, rule):
    r = P.predict(spark.createDataFrame([row], FIELDS), TABLE).first()
    assert r.predicted_rule == rule
    want = (None, None, None) if rule is None else (TABLE[rule - 1].account, TABLE[rule - 1].liability, TABLE[rule - 1].note)
    assert (r.predicted_account, r.predicted_liability, r.matched_conditions) == want


def test_statistics_and_empty_inputs(spark):
    rows = [("Sales", "S1", "BR1", "office", "10")] * 2 + [("HR", "S1", "x", "x", None), ("HR", "x", "x", "x", "70")]
    got = {(r.metric, r.account): r.value for r in P.statistics(P.predict(spark.createDataFrame(rows, FIELDS), TABLE)).collect()}
    assert got == {("total", None): 4, ("matched", None): 3, ("unmatched", None): 1, ("match_rate", None): 75, ("account", "1"): 2, ("account", "2"): 1}
    none = {(r.metric, r.account): r.value for r in P.statistics(P.predict(spark.createDataFrame([], FIELDS), [])).collect()}
    assert none == {("total", None): 0, ("matched", None): 0, ("unmatched", None): 0, ("match_rate", None): 0}


@pytest.mark.parametrize("name, n", [("predict_account", 45), ("predict_liability", 18)])
def test_every_prediction_rule_hits(spark, name, n):
    rules = P.load_rules(name)
    assert len(rules) == n
    hit = {r[0] for r in P.predict(A.po_lines(Tables(spark, "/root/testdata/sf0.01")), rules).select("predicted_rule").distinct().collect()}
    assert hit - {None} == set(range(1, n + 1))
